"""Near duplicates: all pairs of texts whose sets of word n-grams have a Jaccard similarity of at least the threshold.

Texts with equal n-gram sets form one class and take part once. Classes meet in buckets of min-hash bands; inside a bucket their
min-hash values are compared a few at a time, and a pair is dropped as soon as the posterior probability that its similarity reaches the
threshold (uniform prior, binomial matches) falls below ``TOLERANCE``. What is left is decided exactly on the n-gram sets of the texts.

A bucket is cut into blocks by members and by n-grams, and every pair of blocks is a task unit of bounded size; a pair of classes is looked
at in the first band they share only. Units return a count of links per class and the edges of a spanning forest, never the pairs, so a
bucket of many near copies makes no row per pair. Bands miss a pair of similarity 0.8 with probability (1 - 0.8^4)^24 < 4e-6, pruning with
about ``TOLERANCE``.

Per row of the input: ``doc_id``, ``class_id`` (smallest id of its connected group), ``copy_id`` (smallest id with the same n-grams) and
``n_links`` (other rows it is linked with). Texts without a word, nulls among them, stand alone with no link. Texts of fewer than ``n``
words count as one n-gram. Repeated rows are copies of each other.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wayline.llm.words import WordHashes, groups, mix, shingles, split, text_key, tidy
from wayline.operators.components import stars
from wayline.operators.stage import stage

NGRAM, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 24, 4, 16, 1e-6
BLOCK, BLOCK_GRAMS = 256, 1 << 20
HASHES = BANDS * ROWS
_SKETCH = "doc_id string, tk bigint, low bigint, high bigint, n int, signature binary, bands array<bigint>"


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash values, one row of ``HASHES`` for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), HASHES), "uint32")
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(_numbers(HASHES, 1) | np.uint64(1), _numbers(HASHES, 2))):
            out[:, k] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    v = signature.reshape(len(signature), BANDS, ROWS).astype("uint64")
    h = np.broadcast_to(_numbers(BANDS, 3), v.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, r])
    return h


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among ``n`` values that leave a posterior of at least ``tolerance`` for the threshold."""
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of n-grams."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(x).sum(dtype="uint64").view("int64")) for x in (s + np.uint64(17), s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _place():
    """Order of the rows: null ids last, then by hash of the text. As a struct it is a key that equals itself where the id is null."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")


def _own_text(rows: DataFrame, n: int) -> DataFrame:
    """One text per class, found by id and hash of the text and told by its n-grams."""

    def run(batches):
        known = WordHashes()
        for b in batches:
            on = [_key(np.unique(shingles(known.of(split(t)), n))) == (low, high) for t, low, high in zip(b["text"], b["low"], b["high"])]
            yield b.loc[on, ["cid", "size", "text"]]

    return rows.select("cid", "size", "text", "low", "high").mapInPandas(tidy(run), "cid bigint, size bigint, text string").dropDuplicates(["cid"])


def sketch(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        known = WordHashes()
        for b in batches:
            texts, ids = b["text"].tolist(), b["doc_id"]
            for at in range(0, len(texts), 256):
                sets = [np.unique(shingles(known.of(split(t)), n)) for t in texts[at:at + 256]]
                out = pd.DataFrame({"doc_id": ids.iloc[at:at + 256].to_numpy(), "tk": b["tk"].iloc[at:at + 256].to_numpy(), "low": 0, "high": 0, "n": [len(s) for s in sets], "signature": None, "bands": None})
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    sig = signatures([sets[i] for i in full])
                    keys = np.array([_key(s) if len(s) else (0, 0) for s in sets], "int64")
                    out["low"], out["high"] = keys[:, 0], keys[:, 1]
                    sigs, bands = [None] * len(sets), [None] * len(sets)
                    for i, s, h in zip(full, sig, band_hashes(sig).view("int64")):
                        sigs[i], bands[i] = s.tobytes(), h
                    out["signature"], out["bands"] = sigs, bands
                yield out

    # An id as text stays exact beside a null id.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key().alias("tk"), "text")
    return rows.mapInPandas(tidy(run), _SKETCH).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, floor: dict[int, int]):
    """Pairs that no step drops and that meet in no earlier band."""
    matches = np.zeros(len(left), "int64")
    for at in range(0, HASHES, STEP):
        matches += (sig[left, at:at + STEP] == sig[right, at:at + STEP]).sum(1)
        on = matches >= floor[at + STEP]
        left, right, matches = left[on], right[on], matches[on]
    if not len(left):
        return left, right
    same = (sig[left] == sig[right]).reshape(len(left), BANDS, ROWS).all(2)
    on = same.argmax(1) == band
    return left[on], right[on]


def _block_pairs(block: np.ndarray, i: int, j: int):
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    left, right = np.repeat(a, len(b)), np.tile(b, len(a))
    if i == j:
        on = left < right
        left, right = left[on], right[on]
    return left, right


def candidates(units: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Per unit and class with a surviving pair: the partners on its right side."""
    floor = {k: least_matches(k, threshold, tolerance) for k in range(STEP, HASHES + 1, STEP)}

    def run(batches):
        for g in groups(batches, ["h", "i", "j"]):
            i, j, cid = int(g["i"].iloc[0]), int(g["j"].iloc[0]), g["cid"].to_numpy()
            if len(g) < 2:
                continue
            sig = np.frombuffer(b"".join(g["signature"]), "uint32").reshape(-1, HASHES)
            left, right = _block_pairs(g["block"].to_numpy(), i, j)
            left, right = _survivors(sig, left, right, int(g["band"].iloc[0]), floor)
            if len(left):
                at = np.unique(np.concatenate([left, right]))
                yield pd.DataFrame({"h": g["h"].iloc[0], "i": i, "j": j, "cid": cid[at], "partners": [cid[right[left == x]] for x in at]})

    return units.mapInPandas(tidy(run), "h bigint, i int, j int, cid bigint, partners array<bigint>")


def overlaps(sets: list[np.ndarray], wide: int = 8192) -> np.ndarray:
    """Sizes of all intersections, a slice of the n-grams at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(place[-1]) + 1, wide):
        a, b = np.searchsorted(place, [lo, lo + wide])
        m = np.zeros((len(sets), wide), "float32")
        m[owner[a:b], place[a:b] - lo] = 1
        out += m @ m.T
    return out


def _forest(n: int, left, right):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        x, y = top(a), top(b)
        if x != y:
            root[y] = x
            yield a, b


def verify(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """Per unit and class: weighted number of links, and the edges of a forest over them (``to``, null for none)."""

    def run(batches):
        known = WordHashes()
        for g in groups(batches, ["h", "i", "j"]):
            cid, size = g["cid"].to_numpy(), g["size"].to_numpy()
            at = {c: k for k, c in enumerate(cid.tolist())}
            left = np.repeat(np.arange(len(g)), [len(p) for p in g["partners"]])
            right = np.array([at[c] for p in g["partners"] for c in p], "int64")
            sets = [np.unique(shingles(known.of(split(t)), n)) for t in g["text"]]
            both = overlaps(sets)[left, right]
            count = np.array([len(s) for s in sets])
            on = both >= threshold * (count[left] + count[right] - both) - 1e-9
            left, right = left[on], right[on]
            links = np.bincount(left, size[right], len(g)) + np.bincount(right, size[left], len(g))
            edges = list(_forest(len(g), left, right))
            linked = np.flatnonzero(links)
            yield pd.DataFrame({"cid": [*cid[linked], *(cid[a] for a, _ in edges)], "links": [*links[linked].astype("int64"), *[0] * len(edges)],
                                "to": pd.array([*[None] * len(linked), *(cid[b] for _, b in edges)], "Int64")})

    return rows.mapInPandas(tidy(run), "cid bigint, links bigint, to bigint")


def near_texts(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` with ``tk``, the hash of the text, and ``first``, the smallest (id, ``tk``) of the connected group."""
    sketches = stage(sketch(docs, n))
    classes = stage(sketches.filter("n > 0").groupBy("low", "high").agg(
        F.min("doc_id").alias("rep"), F.min(_place()).alias("place"), F.count("*").alias("size"), F.max("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id()))
    keyed = classes.select("cid", "n", F.posexplode("bands").alias("band", "h"))
    crowded = (keyed.groupBy("h").agg(F.count("*").alias("members"), F.sum("n").alias("grams")).filter("members > 1")
               .select("h", F.greatest(F.ceil(F.col("members") / F.lit(block)), F.ceil(F.col("grams") / F.lit(BLOCK_GRAMS))).cast("int").alias("blocks")))
    members = stage(keyed.join(crowded, "h").select("cid", "band", "h", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block")))
    units = (members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cid", "band", "h", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
             .join(classes.select("cid", "signature"), "cid").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "cid"))
    found = stage(candidates(units, threshold, tolerance))
    wanted = stage(found.select("cid").distinct().join(classes.select("cid", "place", "size", "low", "high"), "cid"))
    # What is wanted grows with the input: never a broadcast.
    texts = stage(_own_text(docs.withColumn("tk", text_key()).select(_place().alias("place"), "text").join(wanted.hint("merge"), "place"), n))
    units = found.join(texts, "cid").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "cid")
    checked = stage(verify(units, n, threshold))
    links = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    tops = stars(checked.filter(F.col("to").isNotNull()).select(F.col("cid").alias("a"), F.col("to").alias("b")))
    named = (classes.select("cid", "low", "high", "rep", "place", "size").join(tops.select(F.col("a").alias("cid"), F.col("b").alias("top")), "cid", "left")
             .join(links, "cid", "left").withColumn("top", F.coalesce("top", "cid")))
    named = stage(named)
    first = named.groupBy("top").agg(F.min("rep").alias("class_id"), F.min("place").alias("first"))
    known = stage(named.join(first, "top").select("low", "high", "class_id", "first", F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    rows = sketches.filter("n > 0").select("doc_id", "tk", "low", "high").join(known, ["low", "high"]).select("doc_id", "tk", "class_id", "copy_id", "n_links", "first")
    alone = sketches.filter("n = 0").select("doc_id", "tk", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("bigint").alias("n_links"), _place().alias("first"))
    return rows.unionByName(alone)


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    return near_texts(docs, n, threshold, tolerance, block).select("doc_id", "class_id", "copy_id", "n_links")


def drop_near(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each connected group of near duplicates: the one with the smallest id (null last), then text hash. Rows without a word are
    no copies of each other. The caller's columns, whatever their names, are carried in a struct of their own."""
    found = near_texts(docs.select("doc_id", "text"), n, threshold, tolerance, block)
    first = F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.tk").alias("tk"))
    gone = stage(found.filter(~first.eqNullSafe(F.struct("doc_id", "tk"))).select(F.struct("doc_id").alias("_id"), F.col("tk").alias("_tk")).distinct())
    # A row without a word is kept apart by its number.
    own = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"), F.struct("doc_id").alias("_id"), text_key().alias("_tk"), own.alias("_own"))
    kept = rows.join(gone, ["_id", "_tk"], "left_anti").dropDuplicates(["_id", "_tk", "_own"])
    return kept.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
