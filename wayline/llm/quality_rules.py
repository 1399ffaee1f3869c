"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs without ASCII white space. Repeated eight-word windows are found inside each text from the sorted hashes of its windows,
in time proportional to n log n, and only for texts where a window occurs twice. Nothing is shuffled and each text is read whole.
A null text counts as empty; a text without words fails the base rules, its ratios are null and count as passed.
"""

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30

# Frequent function words of the languages the rules are made for.
STOP_WORDS = """
the of and to in is a that was for on with as at by be this are from or an it he
der die das und in zu den von mit ist des auf für im dem nicht ein eine als auch
le la les de des et en un une que qui dans pour est au sur par plus
el la los las de en y que del se por con para una no es lo al su
""".split()

#: measure, smallest and largest value that passes; None means no bound.
RULES = [
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.1),
    ("shouts_per_word", None, 0.3),
    ("stop_word_share", 0.05, None),
    ("dup_line_share", None, 0.3),
]


def _share(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom)


def _sorted(windows: Column) -> Column:
    """(hash, start) in order for texts where a window occurs twice, nothing for all others."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(F.slice(pairs, 1, 0))


def _repeated(pairs: Column) -> Column:
    """Starts, in order, of the windows whose hash stands beside an equal one."""
    return F.array_sort(F.filter(F.transform(pairs, lambda x, k: F.when(
        (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))


def _covered(starts: Column) -> Column:
    """Words inside the windows that begin at ``starts``."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["sum"] + i + WINDOW - F.greatest(i, acc["end"])).alias("sum"), (i + WINDOW).alias("end")),
        lambda acc: acc["sum"])


def verdict(rules=RULES) -> Column:
    """One condition that holds where every measure lies within its bounds."""
    out = F.lit(True)
    for name, low, high in rules:
        for bound, ok in ((low, F.col(name) >= low if low is not None else None), (high, F.col(name) <= high if high is not None else None)):
            if bound is not None:
                out = out & F.coalesce(ok, F.lit(True))
    return out


def quality(docs: DataFrame, rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """Counts, measures, ``base_failed`` and ``kept`` of each row of ``docs`` (``doc_id``, ``text``)."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", t.alias("t")).select(
        "doc_id", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"[!?]")).cast("bigint").alias("n_shouts"))
    d = d.select(
        "doc_id", "n_symbols", "n_shouts", F.size("words").cast("bigint").alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size(F.filter("words", lambda w: w.isin(sorted(set(stop_words))))).alias("n_stop"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"))
    # Each array is a column of its own before a lambda looks into it: an inlined one would be built again for every element.
    d = d.withColumn("pairs", _sorted(F.col("windows"))).drop("windows")
    d = d.withColumn("n_repeat_words", _covered(_repeated(F.col("pairs"))).cast("bigint")).drop("pairs")
    d = d.select(
        "*", _share(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"), _share(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _share(F.col("n_shouts"), F.col("n_words")).alias("shouts_per_word"), _share(F.col("n_stop"), F.col("n_words")).alias("stop_word_share"),
        _share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"))
    return d.withColumn("kept", ~F.col("base_failed") & verdict(rules))
