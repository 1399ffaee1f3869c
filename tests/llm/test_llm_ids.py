"""Null and repeated ids lose no row and mix up no texts."""

import corpus_pipeline
from wayline.llm import exact_dedup, line_dedup, mixing, ngram_join, toxicity

BIG = (1 << 53) + 1
A = " ".join(f"a{i}" for i in range(40))
B = A.replace("a39", "z")
C = " ".join(f"c{i}" for i in range(40))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, values):
    return spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in values], SCHEMA)


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark, [(None, "x"), (None, "x"), (1, "x"), (None, "y" * 9), (2, "z"), (2, "x")]), 4).collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == ordered(
        [(None, 2, 4, None), (None, 2, 4, None), (1, 2, 4, False), (2, 2, 4, True), (None, None, 1, None), (2, 2, 1, True)])


def test_near_duplicates_and_what_the_pipeline_keeps(spark):
    got = ngram_join.near_duplicates(docs(spark, [(None, A), (None, B), (None, C), (BIG, C)])).collect()
    assert ordered((r.doc_id, r.class_id, r.n_links) for r in got) == ordered([(None, None, 1), (None, None, 1), (None, BIG, 1), (BIG, BIG, 1)])
    left = corpus_pipeline.drop_near_copies(spark, docs(spark, [(1, A), (2, B), (2, C)]), "").collect()
    assert ordered((r.doc_id, r.text) for r in left) == ordered([(1, A), (2, C)])
    for one in (7, None):
        assert len(corpus_pipeline.drop_near_copies(spark, docs(spark, [(one, A), (one, B)]), "").collect()) == 1
    assert corpus_pipeline.drop_near_copies(spark, docs(spark, [(None, None), (None, None), (3, ""), (3, None)]), "").count() == 4


def test_lines_mixing_and_scores(spark):
    rows = docs(spark, [(None, "same line\nown"), (None, "same line\nother"), (BIG, "same line\nlast")])
    assert sum(r.text.count("same line") for r in line_dedup.dedup_lines(rows).collect()) == 1
    assert {r.doc_id for r in line_dedup.line_report(rows).collect()} == {None, BIG}
    assert mixing.mixed(rows, 5.0, 2, {}, 5).count() == 6
    table = toxicity.train([[["scumbag"]]] * 5, [[["there", "when"]]] * 5)
    assert sorted(str(r.doc_id) for r in toxicity.toxicity(rows.coalesce(1), table).collect()) == sorted(["None", "None", str(BIG)])
