"""Chunked windows give the plain window's answer whatever the chunk width, also for one dominant key."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from wayline.operators.components import components
from wayline.operators.ordered import position, previous, running_sum


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = [("hot", i, rnd.choice([None, i % 13])) for i in range(400)] + [(f"k{i % 40}", i, rnd.choice([None, i])) for i in range(400)]
    return spark.createDataFrame(data, "k string, o bigint, v bigint").cache()


@pytest.mark.parametrize("width", [3, 1000])
def test_same_as_plain_window(rows, width):
    w = W.partitionBy("k").orderBy("o")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = rows.select("k", "o", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("s"), (F.row_number().over(w) - 1).alias("i"),
                       F.last("v", ignorenulls=True).over(before).alias("p"))
    got = running_sum(rows, ["k"], "o", F.coalesce("v", F.lit(0)), "s", width)
    got = previous(position(got, ["k"], "o", "i", width), ["k"], "o", F.col("v"), "p", width)
    key = lambda d: sorted(map(tuple, d.select("k", "o", "s", "i", "p").collect()))
    assert key(got) == key(want)


def test_previous_without_keys(rows):
    d = rows.select("o", F.concat("k", F.col("o")).alias("x")).filter("x like 'hot%'")
    got = {r.o: r.p for r in previous(d, [], "o", F.col("x"), "p", 7).collect()}
    assert got[0] is None and got[1] == "hot0" and got[399] == "hot398"


def test_components_of_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 30), *range(100, 161), 999]], "id bigint")
    got = {r.id: r.component for r in components(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 30)} == {1} and {got[i] for i in range(100, 161)} == {100} and got[999] == 999


def test_components_do_not_depend_on_the_order_of_ids(spark):
    chain = [(i, i + 1) for i in range(1, 80)] + [(80, 0)]
    falling = [(i, i - 1) for i in range(280, 200, -1)]
    order = random.Random(3).sample(range(300, 400), 100)
    edges = chain + falling + list(zip(order, order[1:])) + [(500, 500), (501, None)]
    nodes = spark.createDataFrame([(i,) for i in [*range(81), *range(200, 281), *range(300, 400), 500, 501]], "id bigint")
    got = {r.id: r.component for r in components(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(81)} == {0} and {got[i] for i in range(200, 281)} == {200} and {got[i] for i in range(300, 400)} == {300}
    assert got[500] == 500 and got[501] == 501


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([(7,)], "id bigint")
    assert components(nodes, spark.createDataFrame([], "a bigint, b bigint")).collect()[0].component == 7
