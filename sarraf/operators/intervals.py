"""Continuous periods and gaps of overlapping, nested and gapped intervals (problem 3).

Starts and ends of an entity are ranked independently of each other. Behind rank i
there is a gap exactly if the start of rank i+1 lies beyond the end of rank i; a
period reaches from the start behind one gap to the end before the next.

Equal days share one row that counts the starts and ends on it, so an entity has at
most one row per calendar day however many intervals it has: the counts are
pre-aggregated before the shuffle and no task receives an unbounded group.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = dt.date(9999, 12, 31)


def valid_intervals(df: DataFrame, key: Column, start: str, end: str, *others: Column) -> DataFrame:
    """Rows `_k`, `_from`, `_to` and the given columns, of the valid intervals only.

    A null end is open (9999-12-31). A row with null key or start, or an end before
    its start, is no valid interval and is left out.
    """
    rows = df.select(key.alias("_k"), F.col(start).cast("date").alias("_from"), F.coalesce(F.col(end).cast("date"), F.lit(OPEN_END)).alias("_to"), *others)
    return rows.where(F.col("_k").isNotNull() & F.col("_from").isNotNull() & (F.col("_to") >= F.col("_from")))


def coalesce_intervals(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """One row per continuous period: keys, `from_day`, `to_day`, `deepest`, `next_day`.

    `deepest` is the largest number of different intervals sharing a day of the period,
    `next_day` the first covered day behind the gap that follows, null for the last
    period. Adjoining days continue a period.

    Intervals with the same two dates count once. Rows with null dates, or an end before
    the start, are left out; null keys form an entity of their own. An empty table gives
    no rows. Other columns, whatever their names, are ignored.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = intervals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(start).alias("_s"), F.col(end).alias("_e"))
    rows = rows.where(F.col("_s") <= F.col("_e")).distinct()
    ends = rows.select(*names, F.inline(F.array(
        F.struct(F.col("_s").alias("_d"), F.lit(1).alias("_n_s"), F.lit(0).alias("_n_e")),
        F.struct(F.col("_e").alias("_d"), F.lit(0).alias("_n_s"), F.lit(1).alias("_n_e")),
    )))
    days = ends.groupBy(*names, "_d").agg(F.sum("_n_s").alias("_n_s"), F.sum("_n_e").alias("_n_e"))
    order = Window.partitionBy(*names).orderBy("_d")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = days.select(
        *names, "_d",
        F.sum("_n_s").over(upto).alias("_rank_s"),  # the last rank of the starts up to this day
        F.sum("_n_e").over(upto).alias("_rank_e"),
        F.col("_n_e"),
        F.lead("_d").over(order).alias("_next"),
    )
    # Where both ranks agree all that started has ended, so the next day is the next-ranked start.
    ranked = ranked.withColumn("_gap", (F.col("_rank_s") == F.col("_rank_e")) & F.coalesce(F.datediff("_next", "_d") > 1, F.lit(False)))
    ranked = ranked.withColumn("_depth", F.col("_rank_s") - F.col("_rank_e") + F.col("_n_e"))
    ranked = ranked.withColumn("_period", F.sum(F.col("_gap").cast("int")).over(upto) - F.col("_gap").cast("int"))
    periods = ranked.groupBy(*names, "_period").agg(
        F.min("_d").alias("from_day"), F.max("_d").alias("to_day"), F.max("_depth").cast("int").alias("deepest"), F.max(F.when(F.col("_gap"), F.col("_next"))).alias("next_day")
    )
    return periods.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "from_day", "to_day", "deepest", "next_day")


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows keys, `kind` (`period`, `merged` or `gap`), `from_day`, `to_day`.

    `merged` is a period in which at least two different intervals share a day. Cases of
    nulls, repeats and empty tables are those of `coalesce_intervals`.
    """
    kinds = F.array(
        F.struct(F.when(F.col("deepest") > 1, "merged").otherwise("period").alias("kind"), F.col("from_day").alias("f"), F.col("to_day").alias("t")),
        F.struct(F.lit("gap").alias("kind"), F.date_add("to_day", 1).alias("f"), F.date_sub("next_day", 1).alias("t")),
    )
    rows = coalesce_intervals(intervals, keys, start, end).select(*keys, F.inline(kinds))
    return rows.where(F.col("t").isNotNull()).select(*keys, "kind", F.col("f").alias("from_day"), F.col("t").alias("to_day"))
