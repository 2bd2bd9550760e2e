"""Running budgets, ranks and schedules."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> None:
    """Cuts go to spark.checkpoint.dir. Only in local mode a folder is made where it is unset: executors elsewhere don't
    see the driver's disk, and the job fails at once instead."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], ordinal: str | None = None) -> DataFrame:
    """Global running sums (inclusive) without one task that holds all rows.

    Rows are dealt by range of the order, which must be total, and cut in the shared folder so that a row's range is
    fixed. Ranges' totals, one row each, are summed in order and added to the running sums within a range.
    """
    shared_folder(df)
    names = df.columns
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    for name, c in sums.items():
        ranged = ranged.withColumn(f"__{name}", c)
    ranged = ranged.checkpoint(eager=True)
    totals = ranged.groupBy("__part").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums], F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range, not for each row of the table
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums], F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__o_rows"))
    w = Window.partitionBy("__part").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(offsets), "__part")
    cols = [(F.sum(f"__{n}").over(run) + F.col(f"__o_{n}")).alias(n) for n in sums]
    if ordinal:
        cols.append((F.row_number().over(w) + F.col("__o_rows")).cast("long").alias(ordinal))
    return out.select(*names, *cols)


def take_within_budget(df: DataFrame, order: list[Column], cost: Column, budget: float) -> DataFrame:
    """Rows in order up to the first that would overflow the budget; costs must not be negative."""
    return prefix_sums(df, order, {"running_cost": cost}).where(F.col("running_cost") <= budget)


def take_until_spent(df: DataFrame, order: list[Column], cost: Column, budget: float, spent: float = 0) -> DataFrame:
    """Rows in order while what was spent before them is under the budget: the last may overshoot."""
    return prefix_sums(df.withColumn("__own", cost), order, {"running_cost": F.col("__own")}).where(F.lit(spent) + F.col("running_cost") - F.col("__own") < budget).drop("__own")


def fill_within_budget(df: DataFrame, group: list[str], order: list[str], ident: str, cost: str, budget: int) -> DataFrame:
    """For each group, rows in order (then by id) with those skipped that no longer fit.

    Rows dearer than the budget can never fit and are dropped before. A group is read in order as a stream, of which only
    the sum is in memory; groups are what is distributed. Null costs don't fit; null group keys are a group.
    """
    import pyarrow as pa

    src = df.where(F.col(cost) <= budget).select(*group, F.col(ident).cast("long").alias(ident), F.col(cost).cast("long").alias("__cost"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    dealt = src.repartition(*group).sortWithinPartitions(*group, *[f"__o{i}" for i in range(len(order))], ident).select(*group, ident, "__cost")
    k = len(group)

    def run(batches):
        key, spent = None, 0
        for b in batches:
            keep = []
            for *g, c in zip(*(b.column(i).to_pylist() for i in (*range(k), k + 1)), strict=True):
                if g != key:
                    key, spent = g, 0
                keep.append(spent + c <= budget)
                spent += c * keep[-1]
            yield b.filter(pa.array(keep, pa.bool_())).select(list(range(k + 1)))

    return dealt.mapInArrow(run, dealt.drop("__cost").schema)


def carry_forward(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """The last value that isn't null at or before each row of a global order, without one task that holds all rows:
    rows are dealt by range and cut; what goes over from one range to the next is one value for each range."""
    shared_folder(df)
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn(out, F.last(value, ignorenulls=True).over(w))
    seq = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ends = ranged.withColumn("__i", seq).where(F.col(value).isNotNull()).groupBy("__part").agg(F.max_by(value, "__i").alias("__end"))
    parts = ranged.select("__part").distinct().join(ends, "__part", "left")
    # one row for each range, not for each row of the table
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    return own.join(F.broadcast(parts), "__part").withColumn(out, F.coalesce(out, "__before")).drop("__part", "__before")


def length_batches(df: DataFrame, ident: str, length: str, limit: str, prompt: str, budget: int, prompts: int) -> DataFrame:
    """(limit, batch, id): batches of rows of one limit under a padded-token budget.

    Rows go by length, then id. Rows of one prompt next to each other form a block, cut where one more row would take the
    block over the budget (rows x (length + limit)), is more than twice as long as its first, or the block is as large as
    the budget allows for the length of the prompt's first row. A batch takes the next block unless then its padded rows
    exceed the budget, it has more than `prompts` prompts, or its width is more than twice its first row. A row that
    exceeds the budget is a batch of its own. Null lengths and limits are left out.

    A fold in order: rows of a limit are a stream in one task, of which a block and a batch are in memory.
    """
    import pyarrow as pa

    src = df.select(F.col(limit).cast("long").alias("limit"), F.col(length).cast("long").alias("n"), F.col(ident).cast("long").alias("id"), F.col(prompt).cast("long").alias("p"))
    dealt = src.where("limit is not null and n is not null").repartition("limit").sortWithinPartitions("limit", "n", "id")

    def blocks(rows):
        block, at, room = [], None, 0
        for r in rows:
            here = (r[0], r[3])
            if here != at:
                room = max(1, budget // max(1, r[0] + r[1]))
            if block and (here != at or len(block) == room or (len(block) + 1) * (r[0] + r[1]) > budget or r[1] > 2 * block[0][1]):
                yield block
                block = []
            at = here
            block.append(r)
        if block:
            yield block

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        number, first, size, seen, limit, out = -1, 0, 0, set(), None, []
        for block in blocks(rows):
            top, width = block[0][0], block[-1][1]
            if top != limit or len(seen | {block[0][3]}) > prompts or (size + len(block)) * (width + top) > budget or width > 2 * first:
                number = 0 if top != limit else number + 1
                limit, first, size, seen = top, block[0][1], 0, set()
            size += len(block)
            seen.add(block[0][3])
            out += [(top, number, r[2]) for r in block]
            if len(out) > 8192:
                yield pa.RecordBatch.from_pylist([dict(zip(("limit", "batch", "id"), o, strict=True)) for o in out], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("limit", "batch", "id"), o, strict=True)) for o in out], schema=kinds)

    kinds = pa.schema([(n, pa.int64()) for n in ("limit", "batch", "id")])
    return dealt.mapInArrow(run, "limit long, batch long, id long")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the least by `order`, as a mergeable aggregate."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("__b"))
    return best.select(*key, *[F.col(f"__b.{c}").alias(c) for c in (*order, *rest)])


def interleave(df: DataFrame, group: list[str], order: list[Column], seed: Column) -> DataFrame:
    """Round robin over groups: first rows of all groups, then second ones; groups in the order of `seed`."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).withColumn("place", seed)


def cap_share(df: DataFrame, kind: Column, order: list[Column], numerator: int, denominator: int) -> DataFrame:
    """Rows of one kind are kept up to a share of the result, exactly: k of n with k * denominator <= numerator * n."""
    flagged = df.withColumn("__kind", kind.cast("int"))
    other = flagged.agg(F.sum(1 - F.col("__kind")).alias("__other"))
    ranked = flagged.withColumn("__rank", F.row_number().over(Window.partitionBy("__kind").orderBy(*order)))
    most = F.floor(F.lit(numerator) * F.col("__other") / F.lit(denominator - numerator))
    return ranked.crossJoin(F.broadcast(other)).where((F.col("__kind") == 0) | (F.col("__rank") <= most)).drop("__kind", "__rank", "__other")


def average_ranks(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*group)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2.0)


def ordinal_ranks(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Ranks from 1, ties by the order given."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def leave_one_out(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The mean of a group's other values; null where there are none."""
    w = Window.partitionBy(*group)
    return df.withColumn(out, F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1))


def token_schedule(df: DataFrame, order: list[Column], tokens: Column, per_step: int) -> DataFrame:
    """Steps of a fixed number of tokens; rows may lie across steps and every token is used once.
    One row for each (row, step): the step, and the tokens of the row that fall into it as [start, stop)."""
    run = prefix_sums(df.withColumn("__n", tokens), order, {"__end": F.col("__n")}).where("__n > 0")
    lo = F.col("__end") - F.col("__n")
    steps = run.withColumn("step", F.explode(F.sequence(F.floor(lo / per_step), F.floor((F.col("__end") - 1) / per_step))))
    return (
        steps.withColumn("start", F.greatest(F.col("step") * per_step, lo) - lo)
        .withColumn("stop", F.least((F.col("step") + 1) * per_step, F.col("__end")) - lo).drop("__n", "__end")
    )


def probe_positions(df: DataFrame, group: list[str], order: list[Column], count: int) -> DataFrame:
    """Rows at places ceil(i * n / count) of each group, i from 1: spread over its quantiles."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("__at", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    spots = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.ceil(i * F.col("__n") / F.lit(count)))
    return ranked.where(F.array_contains(spots, F.col("__at").cast("long"))).withColumn("position", F.col("__at") - 1).drop("__at", "__n")


def gap_midpoints(df: DataFrame, group: list[str], at: str) -> DataFrame:
    """The middle of each gap between visited positions: one bisection step for all groups."""
    nxt = F.lead(at).over(Window.partitionBy(*group).orderBy(at))
    return df.select(*group, F.col(at).alias("left"), nxt.alias("right")).where("right - left > 1").withColumn("midpoint", F.floor((F.col("left") + F.col("right")) / 2))


def energy_cutoff(df: DataFrame, group: list[str], value: str, order: list[Column], share: float = 0.9) -> DataFrame:
    """For each group, how many of the ordered values it takes to reach a share of their sum."""
    w = Window.partitionBy(*group)
    run = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.select(*group, (run < share * F.sum(value).over(w)).cast("long").alias("__under")).groupBy(*group).agg((F.sum("__under") + 1).alias("components"))


def trajectory(df: DataFrame, key: list[str], order: str, value: str, cap: float) -> DataFrame:
    """First, last, least and largest value, rises, falls and the share at the cap, by key."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    steps = df.select(*key, order, value, F.signum(F.col(value) - before).alias("__d"))
    return steps.groupBy(*key).agg(
        F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.sum((F.col("__d") > 0).cast("long")).alias("rises"), F.sum((F.col("__d") < 0).cast("long")).alias("falls"),
        F.avg((F.col(value) >= cap).cast("double")).alias("at_cap"))


def order_statistic(df: DataFrame, group: list[str], value: str, place: Column, out: str) -> DataFrame:
    """The value at a 1-based place of each group's sorted values; `place` may use the count column `n`."""
    w = Window.partitionBy(*group)
    ranked = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("__r") == F.greatest(place, F.lit(1))).select(*group, F.col(value).alias(out), "n")
