"""Near duplicates, line de-duplication, mixing and licence scans against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import catalog, license_scan, line_dedup, mixing, ngram_join, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tk string, size int, cid string"


def rows(spark, values):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 7}", 1, "t", 2, "c") for i, t in values], SCHEMA)


def near(seed, n_base=6, copies=7):
    r = random.Random(seed)
    out = [(900, None), (901, ""), (902, " \n "), (903, "two words"), (904, "two words"), (905, "x"), (906, "a b c d e"), (906, "a b c d e")]
    for b in range(n_base):
        base = [f"w{r.randint(0, 4000)}" for _ in range(r.randint(6, 90))]
        for c in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = f"e{r.randint(0, 99)}"
            out.append((b * 20 + c, " ".join(w)))
    return out


def brute_links(values):
    grams = []
    for _, t in values:
        w = (t or "").encode().split()
        grams.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links, root = [0] * len(values), list(range(len(values)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both and both >= 0.8 * len(grams[i] | grams[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    low = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(values):
        low[top(i)] = min(low[top(i)], d)
    return sorted((d, low[top(i)], links[i]) for i, (d, _) in enumerate(values))


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3)])
def test_near_duplicates_equal_all_pairs(spark, seed, block):
    values = near(seed)
    got = ngram_join.near_duplicates(rows(spark, values), block=block).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute_links(values)


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(rows(spark, [])).collect() == []


def test_pruning_floor():
    floor = [ngram_join.least_matches(n, 0.8, 1e-6) for n in (16, 32, 64, 96)]
    assert floor == sorted(floor) and 0 < floor[0] < 16 and floor[-1] < 0.8 * 96
    assert ngram_join.least_matches(16, 0.8, 0.5) > floor[0]


def test_overlaps_in_slices():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, n).astype("uint64")) for n in (1, 20, 40, 50)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert ngram_join.overlaps(sets, 7).tolist() == want


def brute_lines(values, least=8):
    dist = lambda a, b: line_dedup.one_edit(a, b)
    seen, out = [], {}
    for d, t in sorted(set(values), key=lambda x: x[0]):
        n = drop = 0
        for line in (t or "").split("\n"):
            w = line.split(" ")
            w = [x for x in w if x]
            if not w:
                continue
            n += 1
            drop += any(line == o or (len(w) >= least and len(v) >= least and dist(v, w)) for o, v in seen)
            seen.append((line, w))
        out[d] = (n, drop)
    return out


def line_docs(seed):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 50)}" for _ in range(r.randint(1, 14))] for _ in range(12)]
    out = [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "only line"), (1004, "only line")]
    for d in range(30):
        lines = []
        for _ in range(r.randint(1, 6)):
            w = list(r.choice(base))
            k = r.random()
            if k < 0.25:
                w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
            elif k < 0.4:
                w.insert(r.randint(0, len(w)), "ins")
            elif k < 0.5 and len(w) > 1:
                w.pop(r.randrange(len(w)))
            lines.append(" ".join(w))
        out.append((d, "\n".join(lines + [""] * (d % 2))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    values = line_docs(seed)
    want = brute_lines(values)
    docs = rows(spark, [*values, values[7]])
    got = {r.doc_id: (r.n_lines, r.n_equal + r.n_near) for r in line_dedup.line_report(docs).collect()}
    assert got == want
    texts = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert set(texts) == {d for d, (n, x) in want.items() if n == 0 or n > x}
    for d, t in values:
        if d in texts:
            left = [x for x in (texts[d].text or "").split("\n") if x.strip()]
            assert len(left) == want[d][0] - want[d][1] and texts[d].tk == "t" and (texts[d].text is None) == (t is None)


def test_lines_of_nothing(spark):
    assert line_dedup.line_report(rows(spark, [])).collect() == [] and line_dedup.dedup_lines(rows(spark, [])).collect() == []


def test_one_edit():
    a = "a b c d".split()
    assert all(line_dedup.one_edit(a, x.split()) and line_dedup.one_edit(x.split(), a) for x in ("a b c d", "a b c", "b c d", "a x c d", "a b x c d", "a b c d x"))
    assert not any(line_dedup.one_edit(a, x.split()) for x in ("b a c d", "a b", "a x x d", "x a b c", "a b c d e f"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_within_equals_the_edit_distance(seed):
    r = random.Random(seed)
    for _ in range(300):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 12))] for _ in "ab")
        for most in range(5):
            assert line_dedup.within(a, b, most) == (distance(a, b) <= most)


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3)])
def test_growing_bound_misses_no_line(spark, seed, block):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 30)}" for _ in range(r.randint(18, 90))] for _ in range(8)] + [[f"{x}{r.randint(0, 10 ** 6)}" for x in "abcde"] for _ in range(4)]
    values = []
    for d in range(60):
        w = list(r.choice(base))
        if len(w) > 8:
            for _ in range(r.choice([0, 1, 2, 3, 6, 9, 12])):
                k = r.randrange(len(w))
                w[k:k + r.randint(0, 1)] = [f"n{r.randint(0, 9)}"] * r.randint(0, 1)
        line = " ".join(w)
        if len(w) <= 8:
            for _ in range(r.choice([0, 1, 2])):
                k = r.randrange(len(line))
                line = line[:k] + r.choice(["", "z"]) + line[k + r.randint(0, 1):]
        values.append((d, line))

    def alike(x, y):
        a, b = x.split(), y.split()
        if min(len(a), len(b)) >= 8:
            return distance(a, b) <= max(1, min(len(a), len(b)) // 10)
        return x == y or max(len(a), len(b)) < 8 and min(len(x), len(y)) >= 30 and distance(x, y) <= 1

    want = {d for d, x in values if any(alike(x, y) for _, y in values[:d])}
    one = {d for d, x in values if any(x == y or line_dedup.one_edit(x.split(), y.split()) for _, y in values[:d])}
    _, drop = line_dedup.duplicate_lines(rows(spark, values), block=block)
    assert {x.doc_id for x in drop.collect()} == want and len(want - one) > 5


@pytest.mark.parametrize("size", [2, 10_000])
def test_partners_are_found_in_one_shuffle(spark, size):
    r = random.Random(size)
    lines = [(r.randint(0, 9), r.randint(-3, 3), p) for p in range(30)]
    values = [(*x, r.randint(0, 5), r.randint(-1, 3)) for x in lines for _ in range(8)]
    values += values[:20]
    df = spark.createDataFrame(values, "doc_id bigint, tk bigint, pos int, v bigint, gap int").repartition(3)
    want = set()
    for *x, v, gap in values:
        near = [tuple(y) for *y, w, g in values if w == v and (gap < 0 or g in (gap, -1))]
        if min(near) < tuple(x):
            want.add((*x, *min(near)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = line_dedup._partners(df)
        assert {tuple(x) for x in found.collect()} == want and len(want) > 50
        assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 2  # one of the test's own
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_staged_tables_of_lines_go_as_soon_as_they_were_read(spark, monkeypatch):
    made, gone = [], []
    monkeypatch.setattr(line_dedup, "stage", lambda d, f=line_dedup.stage: made.append(d.columns) or f(d))
    monkeypatch.setattr(line_dedup, "drop", lambda *t, f=line_dedup.drop: gone.extend(x.columns for x in t) or f(*t))
    docs = rows(spark, [(i, f"one two three four five six seven eight {i % 4}\n\nsame") for i in range(9)])
    assert sorted((x.doc_id, x.n_lines, x.n_equal, x.n_near) for x in line_dedup.line_report(docs).collect()) == [(0, 2, 0, 0), *((i, 2, 1, 1) for i in (1, 2, 3)), *((i, 2, 2, 0) for i in range(4, 9))]
    lines = ["doc_id", "tk", "pos", "low", "high"]
    assert lines in made and lines in gone and not any("gap" in x for x in made)


def test_words_of_lines_far_from_all_others_are_not_sent(spark, monkeypatch):
    schemas, wide = [], [f"w{k}" for k in range(24)]
    monkeypatch.setattr(line_dedup, "_units", lambda d, *a, f=line_dedup._units: schemas.append((d.columns, d.count())) or f(d, *a))
    values = [(i, " ".join(["these", "four", "words", "open", *(f"x{i}y{k}" for k in range(20))])) for i in range(30)] + [(50, " ".join(wide)), (51, " ".join([*wide[:5], "z", *wide[6:11], "z", *wide[12:]]))]
    _, gone = line_dedup.duplicate_lines(rows(spark, values))
    assert {r.doc_id for r in gone.collect()} == {51}
    slim, whole = schemas[:2]
    assert "words" not in slim[0] and slim[1] > 6 and "words" in whole[0] and whole[1] <= 4


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    text = "alpha beta\n\n gamma\talpha  \n" * 40 + "beta"
    whole = line_dedup.hashed_words(text.encode())
    monkeypatch.setattr(line_dedup, "STRETCH", 7)
    parts = line_dedup.hashed_words(text.encode())
    assert all((a == b).all() for a, b in zip(whole, parts))
    words_ = [(k, w) for k, line in enumerate(text.split("\n")) for w in line.split()]
    assert whole[1].tolist() == [k for k, _ in words_] and len(set(whole[0].tolist())) == 3
    assert {w: int(h) for (_, w), h in zip(words_, whole[0])} == {w: int(line_dedup.hashed_words(w.encode())[0][0]) for w in ("alpha", "beta", "gamma")}
    assert [len(x) for x in line_dedup.hashed_words(b"")] == [0, 0]


@pytest.mark.parametrize("n", range(17, 24))
def test_one_word_more_is_near_at_any_length(spark, n):
    line = [f"w{i}" for i in range(n)]
    values = [(1, " ".join(line)), (2, " ".join([*line[:n // 2], "more", *line[n // 2:]])), (3, " ".join(line[1:])), (4, " ".join(line[::-1]))]
    _, drop = line_dedup.duplicate_lines(rows(spark, values))
    assert {r.doc_id for r in drop.collect()} == {2, 3}


def test_emitted_runs_are_shared_whatever_the_edits():
    r = np.random.default_rng(5)
    for n in [*range(20, 70), 200, 1500]:
        for _ in range(4):
            a = r.integers(0, 1 << 62, n).astype("uint64")
            b = a.tolist()
            for _ in range(line_dedup.bound(n) - int(r.integers(0, 2))):
                k = int(r.integers(0, len(b)))
                b[k:k + int(r.integers(0, 2))] = r.integers(0, 1 << 62, int(r.integers(0, 2))).astype("uint64").tolist()
            b = np.array(b, "uint64")
            if min(len(a), len(b)) >= 20 and line_dedup.within(a.tolist(), b.tolist(), line_dedup.bound(min(len(a), len(b)))):
                found, line = line_dedup.runs_of(np.concatenate([a, b]), np.array([len(a), len(b)]))
                assert set(found[line == 0].tolist()) & set(found[line == 1].tolist()), n


def test_parts_of_hot_groups_are_known_without_a_search(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHOWN", 2)
    values = [(i, f"the same ten words stand at the head of a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i} k{i}") for i in range(40)] + [(99, " ".join(f"x{i}" for i in range(30)))]
    got = line_dedup.parts_shared(line_dedup._keyed(rows(spark, values)).coalesce(2)).distinct().groupBy("key").count().collect()
    assert max(r["count"] for r in got) == 40 and min(r["count"] for r in got) > 1


def test_groups_cross_batches():
    import pandas as pd

    parts = [pd.DataFrame({"k": k, "x": range(len(k))}) for k in ([1, 1, 2], [], [2, 2], [2, 3])]
    assert [(g["k"].iloc[0], len(g)) for g in words.groups(parts, ["k"])] == [(1, 2), (2, 4), (3, 1)]


def brute_share(total, nodes):
    """{name: (cap, weight)} -> tokens, by raising one rate until the budget is used."""
    given, left, active = {}, total, dict(nodes)
    while active:
        rate = left / sum(w for _, w in active.values())
        short = {k for k, (c, w) in active.items() if c <= w * rate}
        if not short:
            return given | {k: int(w * rate) for k, (c, w) in active.items()}
        for k in short:
            given[k] = active.pop(k)[0]
            left -= given[k]
    return given


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "1", 5), ("b", "x", "1", 1000), ("b", "z", "9", 0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    got = {(r.domain, r.lang, r.source): r.given for r in mixing.budgets(df, 200, 1, {"domain": {"a": 1, "b": 1}}).collect()}
    a = brute_share(200, {"a": (115, 1), "b": (1000, 1)})
    ax = brute_share(a["a"], {"x": (110, 1), "y": (5, 1)})
    assert got["a", "x", "1"] == 10 and got["a", "x", "2"] == ax["x"] - 10 == 85 and got["a", "y", "1"] == 5 and got["b", "x", "1"] == 100 and got["b", "z", "9"] == 0


@pytest.mark.parametrize("buckets,share,epochs", [(1, 0.5, 1), (64, 0.7, 2), (64, 5.0, 2)])
def test_each_leaf_takes_whole_epochs_and_a_prefix(spark, buckets, share, epochs):
    r = random.Random(3)
    values = [(i, " ".join(["w"] * r.randint(0, 9)) or None) for i in range(150)]
    docs = rows(spark, values + values[:2])
    got = mixing.mix(docs, share, epochs, {}, 5, buckets=buckets).collect()
    assert len(got) == 152
    leaf = defaultdict(list)
    for x in got:
        leaf[x.domain, x.lang, x.source].append(x)
    total = sum(x.n_tokens for x in got)
    used = sum(x.n_tokens * x.copies for x in got)
    assert used <= min(total * share, total * epochs) and used > min(total * share, total * epochs) - 10 * len(leaf)
    for v in leaf.values():
        assert max(x.copies for x in v) - min(x.copies for x in v) <= 1 and max(x.copies for x in v) <= epochs
    again = mixing.mix(docs, share, epochs, {}, 5, buckets=7).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(rows(spark, []), share, epochs, {}, 5).collect() == []
    assert mixing.mixed(docs, share, epochs, {}, 5).columns == docs.columns


def test_licences(spark):
    mit = "Released under the MIT Licence"
    values = [(1, None), (2, ""), (3, mit), (4, f"prose\n{mit.upper()} !!\nmore"), (5, f"Copyright (c) 2020 Some One\n{mit}."), (6, f"This is {mit}"), (7, "all rights\nreserved"), (8, mit), (8, mit)]
    got = sorted(map(tuple, license_scan.scan(rows(spark, values)).collect()))
    assert got == [(3, "MIT", 1, True), (4, "MIT", 1, False), (5, "MIT", 1, True), (7, "proprietary", 0, True), (8, "MIT", 2, True)]
    assert license_scan.scan(rows(spark, [])).collect() == []


def test_whole_and_wrapped_licences(spark):
    import textwrap

    from wayline.llm.license_texts import TEXTS

    text = dict(TEXTS)
    mit, apache = text["MIT"], text["Apache-2.0"]
    wrap = lambda t, n: textwrap.fill(" ".join(t.split()), n, break_long_words=False)
    values = [(1, f"MIT License\n\nCopyright (c) 2020 Some One\n\n{wrap(next(t for k, t in TEXTS if k == 'MIT'), 70)}\n"), (2, f"prose here\n{wrap(apache, 40)}\nmore prose"),
              (3, "some prose\nReleased under\nthe MIT License.\nmore"), (4, "x " + wrap(mit, 60)), (5, wrap(text["GPL-3.0-or-later"], 50)), (6, "prose\n" + mit.replace("\n", " ")), (None, wrap(mit, 33))]
    got = {(x.doc_id, x.license): (x.n_lines, x.whole_text) for x in license_scan.scan(rows(spark, values)).collect()}
    assert got == {(1, "MIT"): (1, True), (2, "Apache-2.0"): (1, False), (3, "MIT"): (1, False), (5, "GPL-3.0-or-later"): (0, True), (6, "MIT"): (1, False), (None, "MIT"): (0, True)}


def brute_licences(values, known, texts):
    """All runs of lines, each brought to words and compared with every known text."""
    table = [(name, license_scan.canonical(t)[0], least) for least, rows_ in ((1, texts), (2, known)) for name, t in rows_]
    lines_only = [(name, w) for name, w, least in table if least == 2]
    out = {}
    for d, t in values:
        lines = [x for x in (license_scan.canonical(line)[0] for line in (t or "").split("\n")) if x]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run, whole = sum(lines[i:j], []), (i, j) == (0, len(lines))
                names = {name for name, w, least in table if w == run and j - i >= least}
                names |= {name for name, w in lines_only if w == run and j - i == 1}
                for name in names:
                    n, x = out.get((d, name), (0, False))
                    out[d, name] = n + (not whole or j - i == 1), x or whole
    return out


def test_licences_equal_brute_force(spark):
    r = random.Random(11)
    known = [("A", "one two three"), ("B", "one two three four five"), ("C", "one"), ("D", "one two x")]
    values = [(i, "\n".join(" ".join(r.choice(["one", "two", "three", "four", "five", "x"]) for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 9)))) for i in range(120)]
    got = {(x.doc_id, x.license): (x.n_lines, x.whole_text) for x in license_scan.scan(rows(spark, values), known).collect() if x.license in "ABCD"}
    assert got == brute_licences(values, known, []) and len(got) > 15


def test_a_million_short_lines_are_scanned_in_seconds(spark):
    import time

    text = "\n".join(f"w{i % 977}" for i in range(1_000_000)) + "\nReleased under\nthe MIT License."
    start = time.time()
    got = license_scan.run_licenses(rows(spark, [(1, text)]), license_scan.known_runs()).collect()
    assert [tuple(x) for x in got] == [(1, "MIT", False)] and time.time() - start < 60


def plain_mix(values, share, epochs, seed_order):
    """Copies per row of one leaf by plain counting: whole epochs, then the longest prefix in the given order."""
    total = sum(n for _, n in values)
    budget = min(int(total * share), total * epochs)
    full = min(epochs, budget // total) if total else 0
    rest, out = budget - full * total, {}
    for k in seed_order:
        n = dict(values)[k]
        rest -= n
        out[k] = full + (full < epochs and rest >= 0)
    return out


@pytest.mark.parametrize("share,epochs", [(0.4, 1), (1.3, 2), (9.0, 3)])
def test_mix_of_one_leaf_equals_plain_counting(spark, share, epochs):
    r = random.Random(4)
    values = [(i, " ".join([f"w{i}"] * r.randint(1, 9))) for i in range(200)]
    got = {x.doc_id: x for x in mixing.mix(rows(spark, values).withColumn("source", F.lit("s")), share, epochs, {}, 5, domain=F.lit("d")).collect()}
    total = sum(x.n_tokens for x in got.values())
    full = min(epochs, int(total * share) // total)
    key = {x.doc_id: hashlib.md5(f"5:{full}:{x.doc_id}:{x.text_key}:-1".encode()).hexdigest() for x in got.values()}
    want = plain_mix([(d, x.n_tokens) for d, x in got.items()], share, epochs, sorted(got, key=key.get))
    assert {d: x.copies for d, x in got.items()} == want


def test_repeated_rows_are_spread_and_stay_within_the_budget(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).cast("bigint").alias("doc_id"), F.lit("four words of text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("row"), F.lit("x").alias("copies"))
    got = mixing.mix(docs, 0.5, 1, {}, 3).collect()
    assert sum(x.copies for x in got) == 10_000 and len(got) == 20_000
    out = mixing.mixed(docs, 0.5, 1, {}, 3)
    assert out.columns == docs.columns and out.count() == 10_000 and out.select("row").distinct().count() == 10_000


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = catalog.table(spark, "/root/testdata/sf0.001", "documents")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.join(docs, "doc_id", "left_anti").isEmpty() and not out.isEmpty()
