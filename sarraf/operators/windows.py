"""Window helpers: runs of consecutive steps, latest rows, ranks, running sums, top k, capacity bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_runs(rows: DataFrame, keys: list[str], step: str, totals: list[str] = (), evidence: list[str] = ()) -> DataFrame:
    """One row per run of consecutive steps: keys, `first_step`, `last_step`, `steps`, totals, evidence of the last step.

    `rows` has at most one row per keys and step. The run is the step less its rank among the
    steps of the keys; all is done in one window and one aggregation over the same keys.
    """
    order = Window.partitionBy(*keys).orderBy(step)
    numbered = rows.withColumn("_run", F.col(step) - F.row_number().over(order))
    last = F.max_by(F.struct(*evidence), F.col(step)).alias("_last") if evidence else F.lit(None).alias("_last")
    runs = numbered.groupBy(*keys, "_run").agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("steps"), *[F.sum(t).alias(t) for t in totals], last)
    return runs.select(*keys, "first_step", "last_step", "steps", *totals, *[F.col(f"_last.{e}").alias(e) for e in evidence])


def latest_row(rows: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """The row of each key that is greatest in the `latest` columns, one after another, then in the others; nulls are least.

    A maximum, so each task keeps one row a key before the shuffle, however many a key has.
    """
    others = [c for c in rows.columns if c not in keys and c not in latest]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*latest, *others)).alias("_top"))
    return top.select(*[F.col(c) if c in keys else F.col("_top")[c].alias(c) for c in rows.columns])


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; the filter on the rank lets Spark cut groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def running_sum(value: Column, keys: list[str], order: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def capacity_bands(rows: DataFrame, order: list[Column], score: str, bands: list[tuple[str, int | None, float]], rest: str, consumes: Column | None = None) -> DataFrame:
    """`rows` with `place` and `band`: the first bands take so many rows (None: any number) of at least a score each.

    `order` starts with the score, downwards. A row for which `consumes` is false is banded like
    any other but takes no slot. What a band leaves free goes to the next ones. The band of a
    row follows from how many slots are taken before it, counted over range partitions.
    """
    taken = F.lit(1) if consumes is None else F.coalesce(consumes, F.lit(False)).cast("int")
    ranked = global_running(rows.withColumn("_taken", taken), order, {"place": F.lit(1), "_upto": F.col("_taken")})
    ranked = ranked.withColumn("_before", F.col("_upto") - F.col("_taken"))
    able = ranked.agg(*[F.coalesce(F.sum(F.when(F.col(score) >= least, F.col("_taken"))), F.lit(0)).alias(f"b{i}") for i, (_, _, least) in enumerate(bands)]).first()
    full, conditions = 0, []
    for i, (name, size, least) in enumerate(bands):
        fits = F.col(score) >= least
        conditions.append((name, fits if size is None else fits & (F.col("_before") - full < size)))
        left = max(able[f"b{i}"] - full, 0)
        full += left if size is None else min(size, left)
    band = F.lit(rest)
    for name, fits in reversed(conditions):
        band = F.when(fits, name).otherwise(band)
    return ranked.withColumn("band", band).drop("_taken", "_upto", "_before")


def rank_within(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 in the order of each group, without a task ever holding a group."""
    placed = global_rank(rows, [F.col(group), *order], "_place")
    starts = placed.groupBy(group).agg(F.min("_place").alias("_start")).withColumnRenamed(group, "_group")
    return placed.join(starts, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_place") - F.col("_start") + 1).drop("_place", "_start", "_group")


def global_running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`rows` with running sums in a total order, counted over range partitions."""
    from sarraf.session import cut

    parts = cut(rows.orderBy(*order).withColumns({**{n: c for n, c in sums.items()}, "_m": F.monotonically_increasing_id()})).withColumn("_p", F.shiftright("_m", 33))
    totals = parts.groupBy("_p").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("_p", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parts.join(F.broadcast(offsets), "_p")  # offsets: one row a partition
    return joined.withColumns({n: F.sum(n).over(inside) + F.col(f"_o_{n}") for n in sums}).drop("_p", "_m", *[f"_o_{n}" for n in sums])


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 in a total order, without sorting in one task."""
    from sarraf.session import cut

    parts = cut(rows.orderBy(*order).withColumns({"_m": F.monotonically_increasing_id()}))
    part = F.shiftright("_m", 33)
    sizes = parts.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    joined = parts.withColumn("_p", part).join(F.broadcast(offsets), "_p")  # offsets: one row a partition
    return joined.withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_p", "_o")
