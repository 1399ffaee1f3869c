"""The prefix trie of conversations: one node per distinct sequence of first turns, with totals of its subtree.

Turns are placed by distributed ranks (``ranks.scan``), so one conversation may hold any share of the rows. A prefix is named by its depth and
the exclusive or of two 64-bit hashes of each of its turns with its place, which tasks fold over their stretch and hand on; a node is a group of equal
names, aggregated before the shuffle.

Totals of subtrees go from nodes to their parents by time-forward processing. Within a shard nodes are sorted externally by falling depth, and a
priority queue holds what children have sent, ordered by the place of the parent in that same order; a node takes its messages from the front
of the queue, adds its own and sends the sum on. The queue writes sorted runs to the task's scratch space beyond ``HELD`` messages.

Shards are cut by the number of conversations through a node. Nodes with one are done without a queue: they hold one path. The nodes with up to ``BRANCH``,
below one with more, form shards with at most ``BRANCH`` paths each; the totals of shard roots, summed per parent, are messages to the next
round, in which nodes have up to ``BRANCH`` squared, and so on up to the root. A round has at most ``1 / BRANCH`` of the leaves of the one
before, so no shard grows with a popular opening turn.

Null roles and texts are empty, turns are ordered with null first (ties by role, then the hashes), rows alike are turns of their own, and rows
without ``conv_id`` belong to no conversation. Without conversations there is no root.
"""

import hashlib
import heapq
import pickle
import tempfile

from pyspark.sql import DataFrame, functions as F

from wayline.llm.ranks import runs, scan
from wayline.llm.words import tidy
from wayline.operators.stage import stage

BRANCH, HELD, CHUNK = 4096, 500_000, 4096
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Messages (place, value, ...) in order of place; beyond ``held`` they are sorted and written out, and read back in turn."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.fronts = held, [], []

    @staticmethod
    def _read(file):
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def push(self, message: tuple) -> None:
        if len(self.heap) >= self.held:
            self._spill()
        heapq.heappush(self.heap, message)

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        self.heap.sort()
        for lo in range(0, len(self.heap), 4096):
            pickle.dump(self.heap[lo:lo + 4096], file, protocol=5)
        file.seek(0)
        self.heap = []
        self._front(self._read(file))

    def _front(self, run) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.fronts, (head, len(self.fronts), id(run), run))

    def take(self, place: tuple):
        """Messages to ``place``; those before it are gone."""
        while True:
            use_run = self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0])
            if not use_run and not self.heap:
                return
            head = self.fronts[0][0] if use_run else self.heap[0]
            if head[0] > place:
                return
            if use_run:
                self._front(heapq.heappop(self.fronts)[-1])
            else:
                heapq.heappop(self.heap)
            if head[0] == place:
                yield head


def own_turns(conversations: DataFrame) -> DataFrame:
    """``c``, two hashes of role and text, ``n_bytes`` of the text and ``at``, the place of the turn in its conversation."""
    said = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(F.lit(1), *said).alias("a"),
        F.xxhash64(F.lit(2), *said).alias("b"), F.octet_length(said[1]).cast("bigint").alias("n_bytes"))
    return stage(scan(rows, ["c"], ["turn", "role", "a", "b"]).select("c", "a", "b", "n_bytes", "at"))


def rebuilt(own: DataFrame, family: int = 5, shared: int = 9) -> DataFrame:
    """The turns (``depth`` from 1) of conversations that open like the first of their ``family``: its first h turns, then their own after
    their first h, h being the checksum of the id modulo ``shared``. Each conversation also has a row of depth 0 and knows its length ``len``."""
    convs = own.groupBy("c").agg(F.count("*").alias("n")).withColumn("base", F.col("c") - F.col("c") % family).withColumn("h", F.crc32(F.col("c").cast("string")) % shared)
    convs = stage(convs.join(convs.select(F.col("c").alias("base"), F.col("n").alias("there")), "base", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0)))))
    convs = convs.withColumn("h", F.when(F.col("c") == F.col("base"), 0).otherwise(F.col("h"))).withColumn("given", F.when(F.col("c") == F.col("base"), 0).otherwise(F.col("given")))
    convs = convs.withColumn("len", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    later = own.join(convs, "c").filter("at >= h").select("c", (F.col("at") - F.col("h") + F.col("given") + 1).alias("depth"), "a", "b", "n_bytes", "len")
    opening = own.filter((F.col("at") < shared) & (F.col("c") % family == 0)).withColumnRenamed("c", "base")
    first = convs.join(opening, "base").filter("at < given").select("c", (F.col("at") + 1).alias("depth"), "a", "b", "n_bytes", "len")
    tops = convs.select("c", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("n_bytes"), "len")
    return later.unionByName(first).unionByName(tops)


def paths(turns: DataFrame) -> DataFrame:
    """Each turn with the name ``k1``, ``k2`` of the prefix that it ends and ``p1``, ``p2`` of the one before; staged."""
    placed = turns.select("c", "depth", "len", "n_bytes", *[F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64("depth", x)).alias(x) for x in ("a", "b")])
    named = scan(placed.withColumns({"k1": F.col("a"), "k2": F.col("b")}), ["c"], ["depth"], ("k1", "k2"))
    return stage(named.select("c", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("a")).alias("p1"), F.col("k2").bitwiseXOR(F.col("b")).alias("p2"), "n_bytes", (F.col("depth") == F.col("len")).alias("ends")))


def nodes(named: DataFrame) -> DataFrame:
    """``conv_id`` (the smallest member), ``n_convs`` and what else a node knows without its subtree; ``up`` are the members of its parent."""
    own = stage(named.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.count(F.when(F.col("ends"), 1)).alias("n_ends"), F.max(F.when(F.col("ends"), F.col("c"))).alias("end")))
    above = own.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("up"))
    return stage(own.join(above, ["depth", "p1", "p2"], "left").withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")))


def ends_of(named: DataFrame, known: DataFrame) -> DataFrame:
    """``ends_sha256`` of nodes where several conversations end. The ids are ranked over all tasks and joined in chunks; a hash is a sequence
    by nature, so one task reads the chunks of a node, which are ``CHUNK`` times fewer rows, one after another."""
    rows = named.filter("ends").join(known.filter("n_ends > 1").select(*NODE), NODE).select(*NODE, "c")
    chunks = (scan(rows, NODE, ["c"]).groupBy(*NODE, F.expr(f"at div {CHUNK}").alias("chunk"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids")))

    def run(batches):
        import pyarrow as pa

        key = digest = None

        def out():
            return pa.RecordBatch.from_pylist([dict(zip(NODE, key)) | {"ends_sha256": digest.hexdigest()}])

        for new, b in runs(batches, NODE):
            if new:
                if key is not None:
                    yield out()
                key, digest = tuple(b.column(c)[0].as_py() for c in NODE), None
            for x in b.column("ids").to_pylist():
                if digest is None:
                    digest = hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(x.encode())
        if key is not None:
            yield out()

    dealt = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return dealt.mapInArrow(tidy(run), "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _forward(limit: int, held: int, columns: list[str]):
    """Time-forward processing of one task's shards, which come in the order of (shard, falling depth, name)."""

    def run(batches):
        import pyarrow as pa

        queue = SpillingQueue(held)
        for new, b in runs(batches, ["shard"]):
            if new:
                queue = SpillingQueue(held)
            cols = [b.column(c).to_pylist() for c in ("depth", "k1", "k2", "p1", "p2", "up", "saved", "n_children", "n_leaves", "sent")]
            done: tuple[list, list, list] = [], [], []
            for depth, k1, k2, p1, p2, up, saved, children, leaves, sent in zip(*cols):
                saved += sent
                for m in queue.take((-depth, k1, k2)):
                    children, leaves, saved = children + 1, leaves + m[1], saved + m[2]
                leaves = leaves or 1
                if up is not None and up <= limit:
                    queue.push(((1 - depth, p1, p2), leaves, saved))
                for c, x in zip(done, (children, leaves, saved)):
                    c.append(x)
            made = {c: pa.array(x, pa.int64()) for c, x in zip(("n_children", "n_leaves", "saved"), done)}
            yield pa.RecordBatch.from_pydict({c: made[c] if c in made else b.column(c) for c in columns})

    return run


def totals(named: DataFrame, known: DataFrame, branch: int = BRANCH, held: int = HELD) -> DataFrame:
    """``known`` with ``n_children``, ``n_leaves`` and ``saved`` of the whole subtree."""
    alone = known.filter("n_convs = 1").withColumn("n_children", 1 - F.col("n_ends")).withColumn("n_leaves", F.lit(1).cast("bigint"))
    most = known.agg(F.max("n_convs")).first()[0] or 0
    columns, done, low, limit = alone.columns, [alone], 1, branch
    kinds = {f.name: f.dataType.simpleString() for f in alone.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    while low < most:
        here = known.filter((F.col("n_convs") > low) & (F.col("n_convs") <= limit))
        sent = [d.filter((F.col("up") > low) & (F.col("up") <= limit) & (F.col("n_convs") <= low)) for d in done]
        message = sent[0]
        for m in sent[1:]:
            message = message.unionByName(m)
        message = message.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("sent"))
        if limit < most:
            roots = here.filter(F.col("up") > limit).select(*NODE, F.xxhash64(*NODE).alias("shard"))  # equal hashes only share a task
            rows = here.join(named.join(roots, NODE).select(F.col("c").alias("conv_id"), "shard"), "conv_id")
        else:
            rows = here.withColumn("shard", F.lit(0).cast("bigint"))
        rows = rows.join(message, NODE, "left").fillna(0, ["n_children", "n_leaves", "sent"])
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "k1", "k2")
        done.append(stage(rows.mapInArrow(tidy(_forward(limit, held, columns)), schema)))
        low, limit = limit, limit * branch
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def trie(conversations: DataFrame, branch: int = BRANCH, held: int = HELD) -> DataFrame:
    """One row per node of the rebuilt conversations."""
    named = paths(rebuilt(own_turns(conversations)))
    known = nodes(named)
    out = totals(named, known, branch, held).join(ends_of(named, known), NODE, "left")
    ends = F.when(F.col("n_ends") == 0, EMPTY).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.col("ends_sha256"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends.alias("ends_sha256"))
