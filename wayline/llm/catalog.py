"""Registered queries of the corpus operators and the SQL that checks those which SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.llm import exact_dedup, language_id, license_scan, line_dedup, merkle, mixing, ngram_join, packing, prefix_trie, quality_rules, retrieval_packing, token_counts as counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)


@query("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op6(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op3_quality_rules", rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, t, words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  CASE WHEN len(words) >= 8 THEN list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' ')) ELSE [] END AS wins FROM w),
p AS (SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM l),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT l.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '[!?]')) AS BIGINT) AS n_shouts,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: list_contains([{", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))}], x))) AS n_stop
  FROM l LEFT JOIN c ON c.doc_id = l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words
  AND n_symbols / CAST(n_words AS DOUBLE) <= 0.1 AND n_shouts / CAST(n_words AS DOUBLE) <= 0.3 AND n_stop / CAST(n_words AS DOUBLE) >= 0.05
  AND n_dup_lines / CAST(n_lines AS DOUBLE) <= 0.3 AS kept
FROM m""")
def op3(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_token_counts")
def op5(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), 512)


@query("op9_best_fit_packing")
def op9(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), 2, 1024), 1024)


@query("op10_language_id")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.label(docs, model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return toxicity.toxicity(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "worst")


@query("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_line_dedup")
def op2(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


#: Weights of the registered mix: relative whole numbers per level of the tree.
WEIGHTS = {"domain": {"d0": 40, "d1": 20, "d2": 20, "d3": 20}, "lang": {"en": 40, "de": 20, "fr": 20, "es": 20}, "source": {"src0": 3}}


@query("op7_mix_sources")
def op7(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), 0.6, 2, WEIGHTS, 17).drop("text_key", "row")


@query("op8_license_scan")
def op8(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


#: The checksum of a number's digits, bit by bit, as DuckDB has no function for it.
CRC32 = """(list_reduce(list_transform(range(8 * strlen(CAST({0} AS VARCHAR))), lambda i:
  (ascii(CAST({0} AS VARCHAR)[i // 8 + 1]) >> CAST(i % 8 AS INT)) & 1), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295))"""


@query("op11_prefix_trie", f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list({{'r': role, 't': text}} ORDER BY pos) AS turns FROM own GROUP BY c),
h AS (SELECT c, turns, c - c % 5 AS base, {CRC32.format("c")} AS crc FROM lists),
full_ AS (SELECT h.c, CASE WHEN h.c = h.base THEN h.turns ELSE coalesce(b.turns, [])[:CAST(xor(h.crc, 4294967295) % 9 AS INT)] || h.turns[CAST(xor(h.crc, 4294967295) % 9 AS INT) + 1:] END AS turns
  FROM h LEFT JOIN lists b ON b.c = h.base),
pre AS (SELECT c, len(turns) AS n, d, turns[:d] AS key FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM full_)),
node AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(any_value(key[d].t)) END AS saved,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM pre GROUP BY d, key),
kids AS (SELECT d - 1 AS d, key[:d - 1] AS key, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (d, key)),
sums AS (SELECT d, key, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM (SELECT unnest(range(0, w.d + 1)) AS d, w.d AS own, w.key AS full_key, k, saved FROM whole w) x, LATERAL (SELECT x.full_key[:x.d] AS key) GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.k AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN sums s USING (d, key) LEFT JOIN node p ON w.d > 0 AND p.d = w.d - 1 AND p.key = w.key[:w.d - 1]""")
def op11(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _leaf(**changed: str) -> str:
    return "sha256(" + " || ".join(_field(changed.get(c, c)) for c in merkle.FIELDS) + ")"


_UP = "list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))"
_FOLD = """CASE WHEN xor(pos, 1) >= len(nodes) THEN sha256(node) WHEN pos % 2 = 1 THEN sha256(nodes[xor(pos, 1) + 1] || node) ELSE sha256(node || nodes[xor(pos, 1) + 1]) END"""


@query("op12_merkle_manifest", f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf()} AS leaf,
  CASE WHEN xor({CRC32.format("doc_id")}, 4294967295) % 7 = 0 THEN {_leaf(n_chars="(n_chars + 1)")} END AS claimed FROM documents),
r AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
lv AS (SELECT g, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM r GROUP BY g UNION ALL SELECT g, lvl + 1, {_UP} FROM lv WHERE len(nodes) > 1),
sub AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM lv WHERE len(nodes) = 1),
tl AS (SELECT 0 AS lvl, list(subroot ORDER BY pos) AS nodes FROM sub UNION ALL SELECT lvl + 1, {_UP} FROM tl WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root FROM tl WHERE len(nodes) = 1),
f AS (SELECT id, g, 0 AS lvl, pos, coalesce(claimed, leaf) AS node, '' AS proof FROM r
  UNION ALL SELECT id, f.g, f.lvl + 1, pos // 2, {_FOLD}, proof || coalesce(nodes[xor(pos, 1) + 1], '') FROM f JOIN lv ON lv.g = f.g AND lv.lvl = f.lvl WHERE len(nodes) > 1),
top AS (SELECT f.id, f.node, f.proof, s.pos FROM f JOIN lv ON lv.g = f.g AND lv.lvl = f.lvl AND len(lv.nodes) = 1 JOIN sub s ON s.g = f.g),
t AS (SELECT id, 0 AS lvl, pos, node, proof FROM top
  UNION ALL SELECT id, t.lvl + 1, pos // 2, {_FOLD}, proof || coalesce(nodes[xor(pos, 1) + 1], '') FROM t JOIN tl ON tl.lvl = t.lvl WHERE len(nodes) > 1)
SELECT r.doc_id, r.leaf, sub.subroot, root.root, sha256(t.proof) AS proof_sha256, t.node AS folded_root, t.node = root.root AS verified
FROM r JOIN sub ON sub.g = r.g JOIN t ON t.id = r.id JOIN tl ON tl.lvl = t.lvl AND len(tl.nodes) = 1, root""")
def op12(spark, sf_dir):
    return merkle.tampered_check(table(spark, sf_dir, "documents"))


@query("op13_retrieval_packing")
def op13(spark, sf_dir):
    return retrieval_packing.retrieval_pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1, 2048)
