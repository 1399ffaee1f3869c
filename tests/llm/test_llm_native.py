"""Exact de-duplication and quality rules against plain brute force and their SQL."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wayline.llm import catalog, exact_dedup, quality_rules

FOLDER = "/root/testdata/sf0.001"
TEXTS = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "ab" * 40), (6, "ab" * 40), (7, "ab" * 39 + "ba"), (7, "ab" * 39 + "ba"), (8, "ü" * 9), (9, "ü" * 9), (10, "b" * 9), (11, "x" * 81)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "p", 1, 2) for i, t in rows], "doc_id bigint, text string, sha string, pos string, name int, words int")


@pytest.mark.parametrize("hashed", [exact_dedup.block_hash, lambda b: F.lit(0).cast("bigint")])
def test_names_are_equal_exactly_for_equal_texts(spark, hashed):
    """A constant hash leaves the whole decision to the sort of the contents."""
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs(spark), 4, hashed).collect()))
    by = {}
    for i, t in TEXTS:
        by.setdefault(t or "", []).append(i)
    want, seen = [], set()
    for i, t in TEXTS:
        g = by[t or ""]
        first = (i, t) not in seen
        seen.add((i, t))
        want.append((i, max(g), len(g), i == max(g) and first, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    hit = {k + j for k in range(len(w) - 7) if wins[tuple(w[k:k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_quality_counts(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, a), (5, a + " " + a), (6, a + "\n\n" + a + "\nx\nx \nx"), (7, "z " * 3000), (8, "the # of| the " * 9), (9, a + " w3 w4 w5 w6 w7 w8 w9 w10 q " + a[:40])]
    got = {r.doc_id: r for r in quality_rules.quality(docs(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), i
        assert not (r.base_failed and r.kept)


def test_quality_of_nothing(spark):
    assert quality_rules.quality(docs(spark, [])).collect() == []


def test_rule_table_is_compiled_whole(spark):
    prose = "the cat of the house was in the garden and it is to be on that tree with a bird at noon"
    rows = [(1, prose), (2, prose.replace(" ", "!! ") + "!!"), (3, " ".join(f"zq{i}" for i in range(40))), (4, prose + " | # $ %")]
    got = {r.doc_id: r.kept for r in quality_rules.quality(docs(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


@pytest.mark.parametrize("name", ["op3_quality_rules", "op6_exact_dedup"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    df = catalog.queries()[name](spark, FOLDER)
    want = con.execute(f"select {', '.join(df.columns)} from ({catalog.oracles()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
