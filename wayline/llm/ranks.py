"""Places and running folds of rows in ordered groups of any size.

Rows are sorted over all tasks by group and order, so a group may span any number of tasks. Each task counts and folds its own stretch; what a
group brings along from the tasks before is one row per task (its first group, its last row), gathered and handed on by the driver.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wayline.llm.words import tidy
from wayline.operators.stage import stage


def runs(batches, keys: list[str]):
    """(new, stretch) for each stretch of rows with equal ``keys`` in a stream of Arrow batches; ``new`` is false where it goes on from the last batch."""
    import pyarrow.compute as pc

    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cut = np.zeros(n, bool)
        for c in keys:
            col = b.column(c)
            cut[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(cut).tolist(), n]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(b.column(c)[lo].as_py() for c in keys) if lo == 0 else None
            yield lo > 0 or key != last, b.slice(lo, hi - lo)
        last = tuple(b.column(c)[n - 1].as_py() for c in keys)


def whole_groups(batches, keys: list[str]):
    """An Arrow table per group of ``keys`` in a sorted stream; for groups of bounded size."""
    import pyarrow as pa

    held: list = []
    for new, b in runs(batches, keys):
        if new and held:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _local(group: list[str], folded: list[str]):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, count, carried = None, 0, {c: 0 for c in folded}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in group:
                col = b.column(c)
                new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            key = tuple(b.column(c)[0].as_py() for c in group)
            new[0] = key != last
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            at = np.arange(n) - np.maximum(start, 0) + np.where(start < 0, count, 0)
            out = {c: b.column(c) for c in b.schema.names}
            for c in folded:
                run_ = np.bitwise_xor.accumulate(b.column(c).to_numpy())
                before = np.concatenate([[0], run_])[np.maximum(start, 0)]
                total = run_ ^ np.where(start < 0, carried[c], before)
                out[c], carried[c] = pa.array(total, pa.int64()), int(total[-1])
            last, count = tuple(b.column(c)[n - 1].as_py() for c in group), int(at[-1]) + 1
            yield pa.RecordBatch.from_pydict(out | {"at": pa.array(at, pa.int64()), "_part": pa.array(np.full(n, part), pa.int32())})

    return run


def scan(df: DataFrame, group: list[str], order: list[str], folded: tuple[str, ...] = ()) -> DataFrame:
    """``df``, staged, with ``at``: the place of a row in its group by ``order``, from 0; columns of ``folded`` (bigint) become the exclusive or
    over the group up to and with the row. Columns of ``group`` and ``folded`` hold no nulls; nulls of ``order`` come first, ties in any order."""
    rows = df.withColumn("_tie", F.monotonically_increasing_id())  # rows that tie may be many: they too are dealt over tasks
    rows = rows.repartitionByRange(*group, *order, "_tie").sortWithinPartitions(*group, *order, "_tie").drop("_tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = stage(rows.mapInArrow(tidy(_local(group, list(folded))), f"{schema}, at bigint, _part int"))
    ends = local.groupBy("_part").agg(F.min(F.struct(*group)).alias("first"), F.max(F.struct(*group, "at", *folded)).alias("last")).orderBy("_part")
    carried, held = [], None
    for r in ends.collect():  # one row per task
        first, last = tuple(r["first"]), tuple(r["last"])
        own = last[len(group):]
        own = (own[0] + 1, *own[1:])
        if held and held[0] == first:
            carried.append((r["_part"], *first, *held[1]))
        if held and held[0] == last[:len(group)]:
            own = (held[1][0] + own[0], *(a ^ b for a, b in zip(held[1][1:], own[1:])))
        held = (last[:len(group)], own)
    if not carried:
        return local.drop("_part")
    kinds = {f.name: f.dataType.simpleString() for f in local.schema}
    more = local.sparkSession.createDataFrame(carried, ", ".join(["_part int", *(f"`{c}` {kinds[c]}" for c in group), "_n bigint", *(f"`_x_{c}` bigint" for c in folded)]))
    out = local.join(F.broadcast(more), ["_part", *group], "left")  # at most a row per task
    return out.select(*[F.col(c).bitwiseXOR(F.coalesce(f"_x_{c}", F.lit(0))).alias(c) if c in folded else F.col(f"`{c}`") for c in df.columns],
                      (F.col("at") + F.coalesce("_n", F.lit(0))).alias("at"))
