"""Licence scans by canonical digests.

A text is brought to one spelling (case, punctuation, white space, copyright lines and equivalent spellings do not count) and its digest is
joined with the digests of known licence texts. The whole document and each of its lines are texts of their own, so both a file that is
a licence and a notice inside other prose are found; a text matches only as a whole. Runs of consecutive lines are texts too, however they are
wrapped: a run that starts with a line and with the first words of a known text, ends with a line and has as many words as that text is digested, and its digest
goes into the same join. Only digests decide, the known ones are a table of the caller's fixed list, and each document is read whole and never shuffled.
The work of a text follows its lines; only lines with the opening of a known text cost more. Null and empty texts match nothing. Rows that repeat an id
are reported together.
"""

import hashlib

import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline.llm.license_texts import DIGESTS, OPENINGS, TEXTS
from wayline.llm.words import tidy

# Notices and the licence they stand for.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("proprietary", "All rights reserved."),
]
# Words that count as the same.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"),
             ("favour", "favor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("whilst", "while")]
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")
# In a wrapped text a line may start with the word, so a year, a sign or a blank to fill in has to follow it.
COPYRIGHT = r"(?i)^[^\p{L}\p{N}(©]*(?:copyright\s*(?:\(c\)|©|\d{4}|<|\[)|\(c\)\s|©)"
_HOLDER = regex.compile(COPYRIGHT)


def words_of(line: Column) -> Column:
    """Lower-case words with single spaces; a copyright line has none."""
    return F.when(line.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")))


def spelled(words: Column) -> Column:
    """Equivalent spellings brought to one."""
    t = F.concat(F.lit(" "), words, F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def joined(lines: Column) -> Column:
    """Canonical words of a text from those of its lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    d = spark.createDataFrame(list(known), "license string, notice string")
    d = d.select("license", F.transform(F.split("notice", "\n"), words_of).alias("lines")).select("license", spelled(joined(F.col("lines"))).alias("c"))
    return d.filter("c <> ''").select("license", F.sha2("c", 256).alias("digest"), F.length("c").alias("size")).distinct()


def canonical(text: str) -> tuple[list[str], list[int]]:
    """Canonical words of a text, and the number of words before each line that has one."""
    words, starts = [], []
    for line in text.lower().split("\n"):
        w = [] if _HOLDER.match(line) else _NOT_WORD.sub(" ", line).split()
        if w:
            starts.append(len(words))
            words += w
    one = {a: b for a, b in SPELLINGS if " " not in a}
    two = {tuple(a.split()): b.split() for a, b in SPELLINGS if " " in a}
    found = set(words)
    if not found.isdisjoint(one):
        words = [one.get(w, w) for w in words]
        found = set(words)
    if not found.isdisjoint(a for a, _ in two):
        moved, out, i = {}, [], 0
        while i < len(words):
            moved[i] = len(out)
            pair = two.get(tuple(words[i:i + 2]))
            out += pair or words[i:i + 1]
            i += 2 if pair else 1
        words, starts = out, [moved[x] for x in starts if x in moved]
    return words, starts


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


#: Words by which a run is first recognised.
OPENING = 3


def known_runs(known=KNOWN, texts=TEXTS, digests=DIGESTS, openings=OPENINGS) -> list[tuple[str, str, int, str, int]]:
    """Licence, digest, number of words, first words, and the fewest lines a run of it has (single lines of notices are found by the join of lines)."""
    out = {}
    for least, table in ((1, texts), (2, known)):
        for name, text in table:
            words, _ = canonical(text)
            if words:
                out[digest(words)] = name, digest(words), len(words), " ".join(words[:OPENING]), least
    return [*out.values(), *((name, value, n, openings[name], 1) for name, n, value in digests)]


def runs(docs: DataFrame, known: list[tuple[str, str, int, str, int]]) -> DataFrame:
    """``doc_id``, ``digest``, ``whole`` and ``n`` (lines) of each run of lines that begins like a known text and is as long."""
    sizes: dict[str, set[int]] = {}
    for _, _, n, opening, _ in known:
        sizes.setdefault(opening, set()).add(n)
    heads = sorted({len(x.split()) for x in sizes})

    def run(batches):
        import pyarrow as pa

        for b in batches:
            row, found = [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                words, starts = canonical(text)
                line = None
                for k, at in enumerate(starts):
                    for head in heads:
                        for n in sizes.get(" ".join(words[at:at + head]), ()):
                            line = line or {x: k for k, x in enumerate([*starts, len(words)])}
                            end = line.get(at + n)
                            if end is not None:
                                row.append(r)
                                found.append((digest(words[at:at + n]), k == 0 and end == len(starts), end - k))
            cols = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int32())))], names=["doc_id", "digest", "whole", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("text is not null").select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, digest string, whole boolean, n int")


def run_licenses(docs: DataFrame, known: list[tuple[str, str, int, str, int]]) -> DataFrame:
    """The runs whose digest is a known one: ``doc_id``, ``license``, ``whole``. A whole text of a single line is also a line."""
    table = docs.sparkSession.createDataFrame([(name, value, least) for name, value, _, _, least in known], "license string, digest string, least int")
    d = runs(docs, known).join(F.broadcast(table), "digest").filter("n >= least")  # as many rows as the fixed list
    kinds = F.when(~F.col("whole"), F.array(F.lit(False))).when(F.col("n") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    return d.select("doc_id", "license", F.explode(kinds).alias("whole"))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """Per document and licence found: ``license``, ``n_lines`` (lines, or runs of lines inside the text) that state it, ``whole_text``."""
    digests = known_digests(docs.sparkSession, known)
    # A spelling shortens a text by less than half, so words more than twice as long as every known text can match none.
    longest = 2 * (digests.agg(F.max("size")).first()[0] or 0)
    lines = docs.filter("text is not null").select("doc_id", F.split("text", "\n").alias("raw")).select("doc_id", F.transform("raw", words_of).alias("lines"))
    size = F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x))
    whole = F.when(size <= longest, F.array(F.struct(F.lit(True).alias("whole"), joined(F.col("lines")).alias("c")))).otherwise(F.array().cast("array<struct<whole:boolean,c:string>>"))
    short = F.transform(F.filter("lines", lambda x: (x != "") & (F.length(x) <= longest)), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("c")))
    parts = lines.select("doc_id", F.explode(F.concat(whole, short)).alias("p")).select("doc_id", "p.whole", spelled(F.col("p.c")).alias("c")).filter("c <> ''")
    found = parts.select("doc_id", "whole", F.sha2("c", 256).alias("digest")).join(F.broadcast(digests.select("license", "digest")), "digest")  # as many rows as the fixed list
    found = found.select("doc_id", "license", "whole").unionByName(run_licenses(docs, known_runs(known)))
    return found.groupBy("doc_id", "license").agg(F.sum((~F.col("whole")).cast("bigint")).alias("n_lines"), F.max("whole").alias("whole_text"))
