"""Best-fit packing of tokenized documents by exact complements.

Documents become pieces of at most ``size`` tokens; only the first piece of a document can be shorter. What matters for packing is how
many pieces there are of each length, a table of at most ``size`` rows. On it, from the longest down, the gap beside a length is looked
up among the available single lengths, sums of two and sums of three; a combination that fills the gap exactly is used as often as the
counts allow, and what finds none is placed by best fit in descending order. The result is a plan of templates with repetitions, whose
number depends on the lengths and not on the documents, so it may travel with the tasks. Pieces then get their rank within their length
(counts per length and hash bucket, a running sum over buckets, a row number inside one bucket), which names the sequence and the place.

A null text counts as empty: one piece with the end token. Rows that repeat an id are packed like any others, and null ids stay null.
"""

import os
import zlib
from array import array
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from wayline.llm.byte_bpe import Kept
from wayline.llm.words import tidy
from wayline.operators.stage import stage

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Token ids, little-endian in four bytes each, of whole texts; stretches are encoded by the tokenizers library and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = Kept(self._library)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Stretches that are not kept yet are encoded in one call for all texts."""
        split = [t.split(" ") for t in texts]
        new = [x for x in set().union(*split) if x not in self.kept and x and not x[0].isspace() and not x[-1].isspace()]
        for x, e in zip(new, self.tokenizer.encode_batch_fast([" " + x for x in new], add_special_tokens=False)):
            self.kept[x] = array("I", e.ids).tobytes()
        return [self._joined(t, s) for t, s in zip(texts, split)]

    def _joined(self, text: str, split: list[str]) -> bytes:
        lead, *rest = split
        if lead[-1:].isspace() or any(s in text for s in self.specials):
            return self._library(text)
        try:
            return (self._library(lead) if lead else b"") + b"".join(map(self.kept.__getitem__, rest))
        except TypeError:
            return self._library(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, the token ids of each piece."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        e = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, rows = b.slice(at, 512), []
                for row, ids in enumerate(e.encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or min(size, n), n + 1, size)]
                    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[4 * lo:4 * hi]
                        rows.append((row, k, lo, hi - lo, zlib.crc32(own), np.frombuffer(own, "<u4").astype("int32") if with_ids else None))
                row, *cols = zip(*rows)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
                # Ids are taken as they are: a null among them must not turn the others into fractions.
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), PIECES + (", ids array<int>" if with_ids else ""))


def _fill(have: np.ndarray, gap: int, own: int) -> tuple[int, ...] | None:
    """The lengths, longest first, that fill ``gap`` beside one piece of length ``own`` with one, two or three pieces that are there."""
    left = have.copy()
    left[own] -= 1
    there = left > 0
    if there[gap]:
        return (gap,)
    pair = there[1:gap] & there[1:gap][::-1]
    if gap % 2 == 0 and left[gap // 2] < 2:
        pair[gap // 2 - 1] = False
    if pair.any():
        a = int(np.flatnonzero(pair)[-1]) + 1
        return a, gap - a
    for a in (np.flatnonzero(there[1:gap - 1])[::-1] + 1).tolist():
        rest = gap - a
        pair = there[1:rest] & there[1:rest][::-1]
        if not pair.any():
            continue
        for b in (np.flatnonzero(pair)[::-1] + 1).tolist():
            use = Counter((a, b, rest - b))
            if all(left[x] >= k for x, k in use.items()):
                return a, b, rest - b
    return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Templates of lengths and how often each is used; every piece is used once."""
    have = np.zeros(size + 1, "int64")
    for length, n in counts.items():
        have[length] += n
    out = []
    if have[size]:
        out.append(((size,), int(have[size])))
        have[size] = 0
    loose = np.zeros(size + 1, "int64")
    for own in range(size - 1, 0, -1):
        while have[own]:
            fill = _fill(have, size - own, own)
            if fill is None:
                loose[own], have[own] = have[own], 0
                break
            use = Counter((own, *fill))
            times = min(int(have[x]) // k for x, k in use.items())
            out.append(((own, *fill), times))
            for x, k in use.items():
                have[x] -= k * times
    open_bins: dict[tuple[int, ...], int] = {}
    for own in range(size, 0, -1):
        n = int(loose[own])
        while n:
            fit = min((b for b in open_bins if size - sum(b) >= own), key=lambda b: (size - sum(b), b), default=None)
            if fit is None:
                each = size // own
                if n // each:
                    open_bins[(own,) * each] = open_bins.get((own,) * each, 0) + n // each
                if n % each:
                    open_bins[(own,) * (n % each)] = open_bins.get((own,) * (n % each), 0) + 1
                break
            times = min(n, open_bins[fit])
            open_bins[fit] -= times
            if not open_bins[fit]:
                del open_bins[fit]
            open_bins[(*fit, own)] = open_bins.get((*fit, own), 0) + times
            n -= times
    return out + sorted(open_bins.items(), reverse=True)


def places(templates: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each run of places, in order of rank."""
    used: Counter = Counter()
    rows: dict[int, list] = {}
    base = 0
    for lengths, times in templates:
        at = 0
        for x in lengths:
            rows.setdefault(x, []).append((used[x], base, at))
            used[x] += times
            at += x
        base += times
    return {x: tuple(np.array(c, "int64") for c in zip(*r)) for x, r in rows.items()}


def pack(parts: DataFrame, size: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; they are staged first, as the plan and the ranks read them too."""
    spark = parts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stage(parts.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(buckets))))
    by = stage(parts.groupBy("length", "_bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    where = places(plan(counts, size))
    before = by.select("length", "_bucket", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "_row"))
    ranked = (parts.withColumn("_in", inside).join(before, ["length", "_bucket"])
              .withColumn("_rank", F.col("_in") + F.col("_before") - 1).select(*[c for c in parts.columns if c not in ("_row", "_bucket")], "_rank"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            seq, off = np.zeros(b.num_rows, "int64"), np.zeros(b.num_rows, "int64")
            lengths, ranks = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            for x in np.unique(lengths):
                first, base, at = where[int(x)]
                mine = np.flatnonzero(lengths == x)
                k = np.searchsorted(first, ranks[mine], "right") - 1
                seq[mine], off[mine] = base[k] + ranks[mine] - first[k], at[k]
            kept = {c: b.column(c) for c in b.schema.names if c != "_rank"}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(seq), "offset": pa.array(off)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(tidy(run), f"{schema}, sequence_id bigint, `offset` bigint")
