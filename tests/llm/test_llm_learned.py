"""Toxicity and language identification: held-out accuracy, edge cases and the path search against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import catalog, language_id, toxicity

FOLDER = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, " \n"), (4, "1234 --- !!"), (5, "the " * 5000), (6, "漢字 かな"), (6, "漢字 かな")]
SCHEMA = "doc_id bigint, text string, score string, spans int, worst string"


def edge(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, "s", 1, "w") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(8))
def test_best_path_is_the_best(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(0, 6, 5)
    score = r.normal(0, 3, (int(lengths.sum()), 3)).astype("float32")
    got = language_id.best_paths(np.arange(len(score)), lengths, score, 2.0)
    end = 0
    for n in lengths:
        s = score[end:end + n]
        value = lambda p: sum(float(s[i, k]) for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert value(got[end:end + n].tolist()) == pytest.approx(best, abs=1e-4)
        end += n


def test_two_hundred_languages():
    truth = np.array([199] * 5 + [128] * 4 + [0] * 3 + [150])
    score = np.full((len(truth), 200), -5.0, "float32")
    score[np.arange(len(truth)), truth] = 5.0
    got = language_id.best_paths(np.arange(len(truth)), np.array([12, 0, 1]), score, 2.0)
    assert got.tolist() == truth.tolist() and np.bincount(got).tolist() == np.bincount(truth).tolist()


def test_languages_held_out(spark):
    docs = catalog.table(spark, FOLDER, "documents")
    got = catalog.queries()["op10_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] > 0.97 and got[1] > 100


def test_language_edges_and_spans(spark):
    en, ru = "the house of the rising sun and the road to it", "дом на горе и дорога к нему в лесу"
    model = language_id.fit(spark.createDataFrame([("en", en), ("ru", ru), (None, "x"), ("en", None)], "lang string, text string"))
    got = {r.doc_id: r for r in language_id.label(edge(spark, [*EDGE, (7, f"{en} {ru}"), (8, en)]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5].lang_pred == got[8].lang_pred == "en"
    assert [(s.first, s.words, s.lang) for s in got[7].spans] == [(0, 11, "en"), (11, 9, "ru")]
    assert got[6].lang_pred in model.langs and 0 <= got[6].score <= 1
    empty = language_id.fit(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in language_id.label(edge(spark), empty).collect()} == {"und"}
    assert language_id.label(edge(spark, []), model).collect() == []


def test_copies_do_not_change_the_sample(spark):
    texts = [("en", f"the house number {x}{y} of road") for x in "abcdefghij" for y in "klmnopqrst"]
    once = spark.createDataFrame(texts + [("en", "zzz zzz")], "lang string, text string")
    often = spark.createDataFrame(texts + [("en", "zzz zzz")] * 3000, "lang string, text string")
    assert language_id.fit(once, 60).known == language_id.fit(often, 60).known
    assert language_id.fit(often, 500).known[0]["zzz"] == 2 and language_id.fit(often, 500).known[0]["the"] == 100


def test_scripts_narrow_the_candidates():
    m = language_id.Model({"en": {"the": 3}, "ru": {"дом": 3}})
    house, river, other = m.scores(["house", "река", "漢"], language_id.Grams(m)).tolist()
    assert house[1] == -50 and river[0] == -50 and other == [0.0, 0.0]


def plain_kernel(a, b):
    """Sum over pairs of equal subsequences of three signs, from the definition."""
    def all_of(w):
        c = toxicity.codes([w])[0].tolist()
        return [((c[i], c[j], c[k]), toxicity.DECAY ** (k - i - 2)) for i, j, k in itertools.combinations(range(len(c)), 3) if k - i < toxicity.SPAN]
    dot = lambda x, y: sum(u * v for s, u in x for t, v in y if s == t)
    x, y = all_of(a), all_of(b)
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_equals_its_definition():
    words = ["idiot", "i-d-i-o-t", "trash", "anana", "a", "ünï"]
    got = toxicity._kernel(words, words[:3])
    for i, a in enumerate(words):
        for j, b in enumerate(words[:3]):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), rel=1e-5)


@pytest.fixture(scope="module")
def table():
    r = random.Random(4)
    word = lambda: "".join(r.choice(["th", "er", "an", "on", "re", "ed", "wh"]) for _ in range(r.randint(1, 4)))
    doc = lambda bad: " ".join([word() for _ in range(20)] + ["."] + [bad] * bool(bad) + [word() for _ in range(20)])
    bad = ["scumbag", "idiotic", "moronic"]
    return toxicity.train([toxicity.sentences(doc(r.choice(bad))) for _ in range(80)], [toxicity.sentences(doc("")) for _ in range(200)])


def test_gaps_and_inserted_characters(table):
    score = lambda t: next(iter(toxicity._scored([t], toxicity.Margins(), table)))[0]
    assert min(score(f"ther an {w} whed") for w in ("scumbag", "SCUMBAG!!", "s-c-u-m-b-a-g", "id_iotic", "m o r o n i c")) >= 0.7
    assert max(score(t) for t in ("", "ther an whed on", "reanoner whthan", "")) < 0.7


def test_wide_gaps(table):
    score = lambda t: next(iter(toxicity._scored([t], toxicity.Margins(), table)))[0]
    for gap in ("-", "--", "---", "*.*", "12", "  ", " \t ", "   "):
        assert min(score(f"ther an {gap.join(w)} whed") for w in ("scumbag", "idiotic", "moronic")) >= 0.7, gap
    assert max(score(f"ther an {gap.join('reanon')} whed") for gap in ("-", "---", "  ")) < 0.7


def test_toxicity_edges(spark, table):
    got = {r.doc_id: r.score for r in toxicity.toxicity(edge(spark), table).collect()}
    assert got[1] == got[2] == got[3] == 0 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.toxicity(edge(spark, []), table).collect() == []
    assert {r.score for r in toxicity.toxicity(edge(spark), None).collect()} == {0.0}
    assert toxicity.train([], [[["a"]]]) is None
    kept = toxicity.kept(edge(spark, [*EDGE, (9, "an idiotic moronic scumbag")]), table)
    assert kept.columns == edge(spark).columns and 9 not in {r.doc_id for r in kept.collect()} and kept.count() == len(EDGE)


def test_toxicity_held_out(spark):
    labels = catalog.table(spark, FOLDER, "labels")
    got = catalog.queries()["op4_toxicity"](spark, FOLDER).join(labels, "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r.n for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, 1), 0) <= 0.02 * n[0, 0] and n.get((1, 1), 0) >= 0.5 * (n.get((1, 0), 0) + n.get((1, 1), 0))
