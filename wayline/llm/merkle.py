"""A manifest of hash trees over a table, with a witness for each row that proves it against one root.

A leaf is the SHA-256 of a row's fields. Per group (of documents: the language) leaves stand in order; while a group has more than one node,
each two in a row become their hash and a last one alone becomes its own, up to the group's subroot. Subroots, in the order of groups, are
folded likewise up to the root.

Witnesses grow while leaves are appended. A task takes one aligned block of at most ``BLOCK`` leaves and appends them one by one. The
frontier holds the open subtrees, widest first; each leaf below them has a partial witness. When the right sibling of an open subtree is
complete, the witnesses below the left one get the right one's root and those below the right one the left one's. The roots of blocks are
nodes in a row again and are appended in the next round in the same way, until each group has one; then subroots likewise. A witness is the
block's own part followed by that of its root. Blocks are of one size, so a group of any length is spread over tasks, and the number of
rounds is its length's logarithm to the base of ``BLOCK``.

Rows are ordered by id (null first), equal ids by leaf; rows alike in all fields are leaves of their own, with any order among them. An empty
text is a value, a null one is not. A table without rows has no root and gives no rows.
"""

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from wayline.llm.ranks import scan, whole_groups
from wayline.llm.words import tidy
from wayline.operators.stage import stage

#: Leaves that one frontier takes; a power of two.
BLOCK = 4096
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def joined(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


class Frontier:
    """Open subtrees of an append-only tree and the witnesses of all leaves appended so far."""

    def __init__(self):
        self.open: list[tuple[int, bytes, int]] = []  # level, root, first leaf; levels fall
        self.paths: list[bytearray] = []

    def _complete(self, level: int, node: bytes, first: int) -> tuple[int, bytes, int]:
        """Joins a complete subtree with the open sibling on its left as long as there is one."""
        while self.open and self.open[-1][0] == level:
            _, left, start = self.open.pop()
            for path in self.paths[start:first]:
                path += node
            for path in self.paths[first:]:
                path += left
            level, node, first = level + 1, joined(left, node), start
        return level, node, first

    def append(self, leaf: bytes) -> None:
        self.paths.append(bytearray())
        self.open.append(self._complete(0, leaf, len(self.paths) - 1))

    def close(self, levels: int) -> bytes:
        """The root at ``levels``; the last open subtree, without a sibling, is hashed alone until it meets one."""
        level, node, first = self.open.pop()
        while True:
            level, node, first = self._complete(level, node, first)
            if level == levels:
                return node
            level, node = level + 1, joined(node)


def levels_of(n: int) -> int:
    return max(n - 1, 0).bit_length()


def _with_group(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Rows (``g``, ``at``) with the one row of their group. A group may hold most rows, so the few are copied to each stretch of places."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("_part", F.pmod(F.shiftright("at", 10), F.lit(parts)).cast("int")).join(few, ["g", "_part"]).drop("_part")


def _appended(nodes: DataFrame, block: int) -> DataFrame:
    """One round: ``path`` (the witness within the block) for each node, and a row with a null ``at`` for each block's root.

    ``nodes``: ``g``, ``at``, ``n`` (nodes of the group), ``digest`` and what else is to be kept.
    """
    bits = levels_of(block)
    rows = nodes.withColumn("block", F.shiftright("at", bits))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        import pyarrow as pa

        for t in whole_groups(batches, ["g", "block"]):
            frontier = Frontier()
            for leaf in t.column("digest").to_pylist():
                frontier.append(leaf)
            n = t.column("n")[0].as_py()
            root = frontier.close(min(bits, levels_of(n)))
            yield from t.append_column("path", pa.array(map(bytes, frontier.paths), pa.binary())).to_batches()
            last = dict.fromkeys(t.column_names) | {"g": t.column("g")[0].as_py(), "block": t.column("block")[0].as_py(), "digest": root, "path": None}
            yield pa.RecordBatch.from_pylist([last], t.schema.append(pa.field("path", pa.binary())))

    dealt = rows.repartition("g", "block").sortWithinPartitions("g", "block", "at")
    return stage(dealt.mapInArrow(tidy(run), f"{schema}, path binary"))


def trees(nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Nodes (``g``, ``at``, ``digest`` and what else they carry) with ``n`` and their whole ``path``, and per group ``g``, ``root``, ``n``."""
    sizes = stage(nodes.groupBy("g").agg(F.count("*").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    rounds = [_appended(_with_group(nodes, sizes), block)]
    length = F.col("n")
    while most > block:
        most = -(-most // block)
        length = F.ceil(length / F.lit(block)).cast("bigint")
        up = rounds[-1].filter("at is null").select("g", F.col("block").alias("at"), "digest")
        up = _with_group(up, sizes.select("g", length.alias("n")))
        rounds.append(_appended(up, block))
    roots = rounds[-1].filter("at is null").select("g", F.col("digest").alias("root")).join(sizes, "g")
    whole = rounds[-1].filter("at is not null")
    for low in reversed(rounds[:-1]):
        above = whole.select("g", F.col("at").alias("block"), F.col("path").alias("_up"))
        whole = low.filter("at is not null").join(above, ["g", "block"]).withColumn("path", F.concat("path", "_up")).drop("_up")
    return whole.drop("block"), roots


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(docs: DataFrame, changed: dict[str, Column] | None = None, fields: list[str] | None = None) -> Column:
    use = {c: docs[f"`{c}`"] for c in fields or FIELDS} | (changed or {})
    return F.unhex(F.sha2(F.concat(*[field(c) for c in use.values()]), 256))


def manifest(docs: DataFrame, group: str = "lang", claimed: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Per row: ``doc_id``, ``g`` (the group as text, marked if there is one), ``at``, ``n``, ``leaf``, ``claimed`` (null where none is given), ``path``
    (siblings of 32 bytes each, from the leaf up to the subroot), ``subroot``, and of the group ``g_at``, ``g_n``, ``g_path`` up to ``root``."""
    name = F.coalesce(F.concat(F.lit("="), docs[f"`{group}`"].cast("string")), F.lit(""))  # null first
    rows = docs.select(docs["`doc_id`"], name.alias("g"), leaf(docs).alias("digest"), (F.lit(None).cast("binary") if claimed is None else claimed).alias("claimed"))
    whole, roots = trees(scan(rows, ["g"], ["doc_id", "digest"]), block)
    tops = roots.select(F.lit(0).alias("g"), F.col("g").alias("name"), F.col("root").alias("digest"))
    top, root = trees(scan(tops, ["g"], ["name"]), block)
    top = top.join(root.select("g", "root"), "g").select(
        F.col("name").alias("g"), F.col("digest").alias("subroot"), F.col("at").alias("g_at"), F.col("n").alias("g_n"), F.col("path").alias("g_path"), "root")
    return _with_group(whole.withColumnRenamed("digest", "leaf"), stage(top))


def folded(node: bytes, at: int, n: int, path: bytes) -> bytes:
    """The root that a node at place ``at`` of ``n`` and its witness lead to."""
    used = 0
    while n > 1:
        if at ^ 1 < n:
            sibling = path[used:used + 32]
            used += 32
            node = joined(sibling, node) if at & 1 else joined(node, sibling)
        else:
            node = joined(node)
        at, n = at >> 1, (n + 1) >> 1
    return node


def verify(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` checked: the claimed leaf, or else the true one, folded along its witness."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            proofs, roots = [], []
            for own, claim, at, n, path, g_at, g_n, g_path in zip(*(b.column(c).to_pylist() for c in ("leaf", "claimed", "at", "n", "path", "g_at", "g_n", "g_path"))):
                proofs.append(hashlib.sha256((path + g_path).hex().encode()).hexdigest())
                roots.append(folded(folded(claim or own, at, n, path), g_at, g_n, g_path).hex())
            hexed = {c: pa.array([x.hex() for x in b.column(c).to_pylist()], pa.string()) for c in ("leaf", "subroot", "root")}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **hexed, "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(tidy(run), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_check(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The digest of the registered query: where 7 divides the checksum of the id, the claimed row has one character more than it has."""
    chosen = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    claim = F.when(chosen, leaf(docs, {"n_chars": docs["n_chars"] + 1}))
    return verify(manifest(docs, claimed=claim, block=block))
