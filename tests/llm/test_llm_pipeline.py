"""Each stage of the corpus pipeline on its own input against brute force: null and empty rows, repeats, columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from wayline.llm import catalog, packing, toxicity
from test_llm_pairs import brute_lines, line_docs
from test_llm_tokens import check_packed

FOLDER = "/root/testdata/sf0.01"
CLASH = ["a.b", "_id", "_tk", "_own", "_row", "row_number", "row_number_", "copies", "tk", "place", "low", "first", "pos", "c0", "_c0", "_own.c0", "_drop", "_text"]


def table(spark, values):
    docs = spark.createDataFrame([(d, t, ["en", None][k % 2], f"src{k % 3}", len(t or ""), k) for k, (d, t) in enumerate(values)], "doc_id bigint, text string, lang string, source string, n_chars bigint, k bigint")
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.col("k").alias(c) for c in CLASH])


def stage(name):
    return dict(cp.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_nothing_in_nothing_out(spark, name):
    docs = table(spark, [(1, "x")]).limit(0)
    out = stage(name)(spark, docs, FOLDER)
    assert out.collect() == [] and (name == "best-fit packing" or out.columns == docs.columns)


def grams(t):
    w = (t or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_document_of_each_group_stays(spark):
    r = random.Random(9)
    values = [(None, None), (None, ""), (5, None), (5, None), (6, " \n"), (None, "alone without an id"), (None, "alone without an id")]
    for b in range(8):
        w = [f"w{r.randint(0, 900)}" for _ in range(r.randint(8, 80))]
        for _ in range(r.randint(1, 5)):
            v = list(w)
            if r.random() < 0.7:
                v[r.randrange(len(v))] = "changed"
            values.append((r.choice([r.randint(10, 99), None]), " ".join(v)))
    values += values[-3:]
    docs = table(spark, values)
    out = stage("n-gram Jaccard join")(spark, docs, FOLDER)
    assert out.columns == docs.columns
    got = out.select("doc_id", "text", F.col("`a.b`").alias("k")).collect()
    assert all(values[x.k] == (x.doc_id, x.text) for x in got)
    sets = [grams(t) for _, t in values]
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {g for g, s in zip(group, sets) if s}
    kept = [x for x in got if sets[x.k]]
    assert len(kept) == len(want) and {group[x.k] for x in kept} == want
    for x in kept:
        ids = [values[k][0] for k in range(len(values)) if group[k] == group[x.k]]
        assert x.doc_id == min((i for i in ids if i is not None), default=None)
    assert len(got) - len(kept) == sum(not s for s in sets)


def test_lines_go_once(spark):
    values = line_docs(3)
    docs = table(spark, values)
    want = brute_lines(values)
    got = {x.doc_id: x for x in stage("line dedup")(spark, docs, FOLDER).collect()}
    assert set(got) == {d for d, (n, gone) in want.items() if n == 0 or n > gone}
    for d, x in got.items():
        left = [y for y in (x.text or "").split("\n") if y.strip()]
        assert len(left) == want[d][0] - want[d][1] and x.n_chars == len(x.text or "") and values[x["a.b"]][0] == d


def test_mix_keeps_rows_within_the_budget(spark):
    values = [(k % 40 or None, " ".join([f"w{k}"] * (k % 7)) or None) for k in range(300)]
    docs = table(spark, values)
    out = stage("mixing sources")(spark, docs, FOLDER)
    assert out.columns == docs.columns
    got = [x.k for x in out.select(F.col("`a.b`").alias("k")).collect()]
    size = lambda ks: sum(len((values[k][1] or "").split()) for k in ks)
    assert len(got) == len(set(got)) and size(range(300)) * cp.SHARE - 7 * 6 <= size(got) <= size(range(300)) * cp.SHARE


def test_packed_pieces_are_whole(spark):
    from tokenizers import Tokenizer

    values = [(None, None), (None, "no id"), ((1 << 53) + 1, "big id"), (4, ""), (7, "w " * 3000)] + [(k, "ab cd " * (k % 90)) for k in range(100, 400)]
    got = stage("best-fit packing")(spark, table(spark, values), FOLDER).collect()
    used, least = check_packed(got, values, Tokenizer.from_file(catalog.tokenizer_path()), cp.SIZE)
    assert used <= least * 1.05 + 1 and packing.PIECES.startswith("doc_id")


def test_toxic_documents_go(spark):
    docs = catalog.table(spark, FOLDER, "documents").limit(400).withColumns({c: F.lit(1) for c in CLASH if "." not in c}).unionByName(
        table(spark, [(None, None), (None, "")]).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(1).alias(c) for c in CLASH if "." not in c]))
    labels = catalog.table(spark, FOLDER, "labels").filter(~toxicity.held_out())
    model = toxicity.fit(docs, labels)
    scored = toxicity.toxicity(docs, model)
    out = stage("toxicity")(spark, docs, FOLDER)
    assert out.columns == docs.columns
    want = sorted(str(x.doc_id) for x in scored.filter(F.col("score") < toxicity.DECIDED).collect())
    assert sorted(str(x.doc_id) for x in out.select("doc_id").collect()) == want and want.count("None") == 2
