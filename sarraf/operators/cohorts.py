"""Peer groups: robust statistics per level of a ladder of groupings, and the choice of a rung."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarraf.operators.distribution import percentiles
from sarraf.session import cut


def long_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, `metric`, `value` (double) of every value that is neither null nor NaN."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return rows.select(*keys, F.inline(pairs)).where("value is not null and not isnan(value)")


def median_and_mad(rows: DataFrame, keys: list[str], value: str = "value", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """keys, `n`, `median`, `mad`, `low`, `high`: the deviation is taken in a second pass from the joined median."""
    first = cut(percentiles(rows, keys, value, {"median": 0.5, "low": low, "high": high}))
    away = rows.join(first.select(*keys, "median"), keys).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    away = percentiles(away, keys, "_away", {"mad": 0.5}).drop("n")
    return first.join(away, keys)


def ladder_stats(rows: DataFrame, ladder: list[list[str]], metrics: list[str]) -> DataFrame:
    """`level`, `cohort`, `metric` and the robust statistics, for every grouping of the ladder, finest first."""
    whole = [reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in grouping], F.lit(True)) for grouping in ladder]
    rungs = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(i).alias("level"), F.concat_ws("|", *g).alias("cohort"))) for i, (ok, g) in enumerate(zip(whole, ladder), 1)]))
    values = cut(long_metrics(rows.select("*", F.inline(rungs)), ["level", "cohort"], metrics))  # all rungs in one pass
    return median_and_mad(values, ["level", "cohort", "metric"])


def choose_rung(rows: DataFrame, key: str, ladder: list[list[str]], metric: str, stats: DataFrame, least: int) -> DataFrame:
    """`key`, `value`, `level`, `n`, `median`, `mad` of the first rung with `least` members, else of the widest."""
    rungs = F.array(*[F.struct(F.lit(i).alias("level"), F.concat_ws("|", *g).alias("cohort")) for i, g in enumerate(ladder, 1)])
    one = rows.select(key, F.col(metric).cast("double").alias("value"), F.inline(rungs)).where("value is not null and not isnan(value)")
    joined = one.join(stats.where(F.col("metric") == metric).drop("metric"), ["level", "cohort"])
    big = F.col("n") >= least
    order = Window.partitionBy(key).orderBy(big.desc(), F.when(big, F.col("level")).otherwise(-F.col("level")))
    return joined.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, "value", "level", "n", "median", "mad")


def robust_z(value: str, median: str, mad: str, n: str, least: int = 8, floor: float = 0.02) -> Column:
    """0.6745 (x - median) / MAD, the MAD not below a share of the median; null for small groups."""
    spread = F.greatest(F.col(mad), F.abs(F.col(median)) * floor)
    return F.when((F.col(n) >= least) & (spread > 0), F.lit(0.6745) * (F.col(value) - F.col(median)) / spread)
