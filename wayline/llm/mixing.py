"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A budget of tokens runs down the tree: at each node the children share it by their weights, and a
child that cannot use its share (its subtree holds fewer tokens, times the epochs allowed) gives the rest to its siblings. As a node is
given no more than its subtree can use, a shortage is made good among siblings first and only then among the siblings of an ancestor. Each
leaf then takes whole epochs and, of the next one, the longest prefix in a seeded order whose tokens fit.

The prefix of a leaf is found by buckets of its order: token sums per bucket, a running sum over the buckets, and a running sum over rows
only inside the one bucket in which the budget ends; a leaf with a third of all rows is spread over ``BUCKETS`` times as many groups.

Weights are relative whole numbers; a child that is not listed has the weight ``OTHER``. Null texts hold no token, null languages and sources are
children of their own (``other``). Rows without tokens cost nothing and follow their place in the order. The order is a hash of the seed, the id and the
text; rows that repeat both, however many, are rows of their own, which the number of the row keeps apart, so they too are spread over buckets and each
has its own number of copies.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.operators.stage import stage

BUCKETS, OTHER = 4096, 1
LEAF = ["domain", "lang", "source"]


def shared(nodes: DataFrame, parent: list[str], child: list[str]) -> DataFrame:
    """Splits ``budget`` of each parent among its children (``cap``, ``weight``): adds ``given``."""
    use = F.col("cap") / F.col("weight")
    order = W.partitionBy(*parent).orderBy(use, *child)
    d = (nodes.withColumn("_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("_rate", (F.col("budget") - F.col("_before")) / F.col("_rest"))
         .withColumn("_short", F.col("cap") <= F.col("weight") * F.col("_rate")))
    # Children that fall short stand first; the rest share what is left at the rate of the first of them.
    rate = F.max(F.when(~F.col("_short"), F.col("_rate"))).over(W.partitionBy(*parent))
    return (d.withColumn("_first", rate).withColumn("given", F.when(F.col("_short"), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("weight") * F.col("_first")))).cast("bigint"))
            .drop("_before", "_rest", "_rate", "_short", "_first"))


def weight_of(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(OTHER)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("bigint")


def budgets(leaves: DataFrame, total: int, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """``leaves`` (``domain``, ``lang``, ``source``, ``tokens``) with the tokens ``given`` to each."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    d = shared(domains.withColumn("weight", weight_of("domain", weights.get("domain", {}))).withColumn("budget", F.lit(total).cast("bigint")), [], ["domain"])
    d = d.select("domain", F.col("given").alias("budget"))
    n = shared(langs.withColumn("weight", weight_of("lang", weights.get("lang", {}))).join(d, "domain"), ["domain"], ["lang"])
    n = n.select("domain", "lang", F.col("given").alias("budget"))
    out = shared(leaves.withColumn("weight", weight_of("source", weights.get("source", {}))).join(n, ["domain", "lang"]), ["domain", "lang"], ["source"])
    return out.select(*LEAF, "tokens", "given")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_group(source: str = "source") -> Column:
    """Domain of a source: its trailing number by fours, where no other domain is given."""
    return F.coalesce(F.concat(F.lit("d"), F.pmod(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(4)).cast("string")), F.lit("other"))


def mix(docs: DataFrame, share: float, epochs: int, weights: dict[str, dict[str, int]], seed: int, domain: Column | None = None, tokens: Column | None = None, buckets: int = BUCKETS, row: Column | None = None) -> DataFrame:
    """Per row: ``doc_id``, its leaf, ``n_tokens`` and ``copies``; the budget is ``share`` of all tokens. ``text_key`` tells repeated ids apart, ``row`` (a number
    unlike in all rows, made here if none is given) rows that repeat both."""
    rows = docs.select("doc_id", (source_group() if domain is None else domain).alias("domain"), F.coalesce("lang", F.lit("other")).alias("lang"), F.coalesce("source", F.lit("other")).alias("source"),
                       (word_count() if tokens is None else tokens).alias("n_tokens"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), (F.monotonically_increasing_id() if row is None else row).alias("row"))
    rows = stage(rows)
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    given = stage(budgets(leaves, total, epochs, weights).withColumn("full", F.when(F.col("tokens") > 0, F.least(F.lit(epochs), F.floor(F.col("given") / F.col("tokens")))).otherwise(0).cast("bigint"))
                  .withColumn("rest", F.col("given") - F.col("full") * F.col("tokens")).select(*LEAF, "full", "rest"))
    # A leaf that has had every epoch takes no part of a further one.
    same = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.struct("doc_id").alias("_id"), "text_key", F.lit(True).alias("_same"))
    rows = rows.join(given, LEAF).withColumn("_id", F.struct("doc_id")).join(same, ["_id", "text_key"], "left")  # a key that equals itself where the id is null
    own = F.when(F.col("_same"), F.col("row")).otherwise(F.lit(-1))
    rows = rows.withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), "full", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_key", own)))
    rows = rows.withColumn("bucket", (F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)).cast("int"))
    sums = rows.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(W.partitionBy(*LEAF).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.withColumn("before", before), [*LEAF, "bucket"])
    whole, cut = F.col("before") + F.col("sum") <= F.col("rest"), F.col("before") <= F.col("rest")
    more = F.col("full") < epochs
    easy = rows.filter(whole | ~cut).withColumn("more", whole)
    last = rows.filter(~whole & cut).withColumn("more", F.col("before") + F.sum("n_tokens").over(
        W.partitionBy(*LEAF, "bucket").orderBy("order", "doc_id", "text_key", "row").rowsBetween(W.unboundedPreceding, 0)) <= F.col("rest"))
    return easy.unionByName(last).select("doc_id", "text_key", "row", *LEAF, "n_tokens", (F.col("full") + F.when(F.col("more") & more, 1).otherwise(0)).cast("bigint").alias("copies"))


def mixed(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows of ``docs``, each as often as it was selected, with the columns of ``docs``."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    rows = stage(docs.withColumn(name, F.monotonically_increasing_id()))
    picked = mix(rows, *args, row=F.col(name), **kwargs).filter("copies > 0").select(F.col("row").alias("_picked"), "copies")
    own = rows.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_own"), F.col(name).alias("_picked"))
    many = own.join(picked, "_picked").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return many.select(*[F.col(f"_own.c{i}").alias(c) for i, c in enumerate(docs.columns)])
