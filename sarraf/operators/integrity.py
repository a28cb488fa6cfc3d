"""Checks of a lake, each a query of what is wrong: schema, keys, links, intervals, arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_faults(rows: DataFrame, declared: T.StructType) -> list[str]:
    """Columns that are missing, extra, out of order or of another type."""
    have, want = [(f.name, f.dataType) for f in rows.schema], [(f.name, f.dataType) for f in declared]
    faults = [f"missing {n}" for n, _ in want if n not in dict(have)] + [f"extra {n}" for n, _ in have if n not in dict(want)]
    faults += [f"{n} is {t.simpleString()}" for n, t in have if n in dict(want) and dict(want)[n] != t]
    return faults or ([] if [n for n, _ in have] == [n for n, _ in want] else ["columns out of order"])


def orphans(links: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """`link`, `orphans`: rows of the first table whose value the second does not have, for each link."""
    parts = []
    for name, child, column, parent, key in links:
        values = child.select(F.col(column).alias("_v")).where("_v is not null")
        counted = values.groupBy("_v").agg(F.count("*").alias("_n"))  # before the join, so hot values cost one row
        lost = counted.join(parent.select(F.col(key).alias("_v")), "_v", "left_anti")
        parts.append(lost.agg(F.lit(name).alias("link"), F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans")))
    return reduce(DataFrame.unionByName, parts)


def interval_faults(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """`key`, `start`, `fault` (`backwards`, `overlap`, `gap`) of intervals that should follow each other without a gap."""
    r = rows.select(F.col(key), F.col(start).alias("_f"), F.coalesce(end, F.to_date(F.lit("9999-12-31"))).alias("_t")).where("_f is not null")
    r = r.withColumn("_next", F.lead("_f").over(Window.partitionBy(key).orderBy("_f", "_t")))
    fault = F.when(F.col("_t") < F.col("_f"), "backwards").when(F.col("_next") <= F.col("_t"), "overlap").when(F.datediff("_next", "_t") > 1, "gap")
    return r.select(key, F.col("_f").alias("start"), fault.alias("fault")).where("fault is not null")


def failed(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """`check`, `failed`: how many rows fail each identity; unknown counts as failed. One pass for all."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failed")) for n in checks])))


def outside(rows: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """`field`, `outside`: how many values are outside their enumeration; null is no value. One pass for all."""
    counts = rows.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)).alias(c) for c, values in allowed.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("outside")) for c in allowed])))
