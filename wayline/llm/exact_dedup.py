"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and numbered, so a block's number is its name:
equal blocks, and only those, share one. Adjacent names of a document are then paired and the distinct pairs sorted and numbered in
turn, until every document is left with one name. No name depends on a fingerprint being free of collisions: the sort compares
length, then a 64-bit hash, then the characters themselves where these two agree.

Only numbers move. The characters of a block travel once, to the aggregate that finds the smallest and the largest content among
blocks of equal length and hash; where both are equal the content is one. Otherwise the rows of the smallest content are named and
the rest goes through the same step again. A text held by a third of all rows is combined before that shuffle, and all joins are
between exchanged tables that the runtime may split.

Null texts count as empty; a row with a null id counts in its group, is returned, and cannot be the one that stays. Rows that repeat an id and a text are counted, each is returned, and the first of them can be the one that stays.
"""

from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators.stage import stage

BLOCK = 1 << 14


def block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def _cut(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _numbered(keys: DataFrame, by: list[str], start) -> DataFrame:
    """Integer names in sort order within each partition of the distinct keys."""
    return keys.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id() + F.lit(start))


def _block_names(blocks: DataFrame):
    """Names by (length, hash), and names by place for the blocks whose length and hash belong to several contents."""
    start, shared, odd, round_names = 0, None, None, None
    while True:
        found = blocks.groupBy("len", "hash").agg(F.min("block").alias("low"), F.max("block").alias("high"))
        names = stage(_numbered(found.select("len", "hash", F.when(F.col("low") != F.col("high"), F.col("low")).alias("low")), ["len", "hash"], start))
        mixed = names.filter(F.col("low").isNotNull())
        if shared is None:
            shared = names.select("len", "hash", "name", F.col("low").isNotNull().alias("mixed"))
        else:
            single = blocks.join(names.filter(F.col("low").isNull()), ["len", "hash"]).select("doc_id", "sha", "pos", "name")
            odd = odd.unionByName(single)
        if mixed.isEmpty():
            return shared, odd
        again = blocks.join(mixed, ["len", "hash"])
        now = again.filter("block = low").select("doc_id", "sha", "pos", "name")
        odd = now if odd is None else odd.unionByName(now)
        start = names.agg(F.max("name")).first()[0] + 1
        blocks = stage(again.filter("block <> low").select("doc_id", "sha", "pos", "len", "hash", "block"))


def identities(docs: DataFrame, size: int = BLOCK, hashed=block_hash) -> DataFrame:
    """``doc_id``, ``text_sha256``, ``n_rows`` (rows alike in both), and the identity (``n_blocks``, ``name``) of the text."""
    # An id in a struct is a key that equals itself where it is null, in joins too.
    rows = (docs.select(F.struct("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
            .select("doc_id", F.sha2("t", 256).alias("sha"), F.explode(F.transform(_cut(F.col("t"), size), lambda b, i: F.struct(i.alias("pos"), b.alias("block")))).alias("x"))
            .select("doc_id", "sha", "x.pos", F.length("x.block").alias("len"), hashed(F.col("x.block")).alias("hash"), "x.block"))
    shared, odd = _block_names(rows)
    light = stage(rows.groupBy("doc_id", "sha", "pos", "len", "hash").agg(F.count("*").alias("n_rows")))
    named = light.join(shared, ["len", "hash"]).select("doc_id", "sha", "pos", "n_rows", "name", "mixed")
    if odd is not None:
        own = odd.select("doc_id", "sha", "pos", F.col("name").alias("own")).distinct()
        named = named.join(own, ["doc_id", "sha", "pos"], "left").withColumn("name", F.when(F.col("mixed"), F.col("own")).otherwise(F.col("name")))
    named = stage(named.select("doc_id", "sha", "pos", "n_rows", "name"))
    width = named.groupBy("doc_id", "sha").agg(F.count("*").alias("n_blocks"))
    ready = stage(named.join(width, ["doc_id", "sha"]))
    done = ready.filter("n_blocks = 1").select("doc_id", "sha", "n_rows", "n_blocks", "name")
    level = ready.filter("n_blocks > 1")
    while not level.isEmpty():
        half = F.col("pos").bitwiseAND(1) == 0
        pairs = stage(level.groupBy("doc_id", "sha", "n_blocks", F.shiftright("pos", 1).alias("pos"))
                      .agg(F.max("n_rows").alias("n_rows"), F.max(F.when(half, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1)).alias("right")))
        names = stage(_numbered(pairs.select("left", "right").distinct(), ["left", "right"], 0))
        level = stage(pairs.join(names, ["left", "right"]).select("doc_id", "sha", "pos", "n_rows", "n_blocks", "name"))
        more = stage(level.groupBy("doc_id", "sha").agg(F.max("pos").alias("last")).filter("last > 0").select("doc_id", "sha"))
        done = done.unionByName(level.join(more, ["doc_id", "sha"], "left_anti").select("doc_id", "sha", "n_rows", "n_blocks", "name"))
        level = level.join(more, ["doc_id", "sha"], "left_semi")
    return done.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("sha").alias("text_sha256"), "n_rows", "n_blocks", "name")


def exact_dedup(docs: DataFrame, size: int = BLOCK, hashed=block_hash) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``keep_id`` (the largest id with this text), ``group_size``, ``kept``, ``text_sha256``."""
    ids = stage(identities(docs, size, hashed))
    groups = ids.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    rows = ids.join(stage(groups), ["n_blocks", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("bigint"), F.when(F.col("doc_id").isNotNull(), (F.col("doc_id") == F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
