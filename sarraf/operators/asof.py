"""As-of join: each left row takes the last right row of its key not after its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, values: list[str], tile_days: int = 365, tolerance_days: int | None = None) -> DataFrame:
    """`left` with the `values` of the last matching right row, null where there is none.

    Both sides are cut into time tiles; into each tile a row carries the last values of the
    tiles before it. So a key's rows are spread over its tiles, and one window per (key, tile)
    finds the match without any join. Of right rows with one key and time the one with the
    greatest values counts. Rows of `left` with null key or time are kept with nulls.
    """
    names = left.columns
    whole = F.col(on).isNotNull() & F.col(left_time).isNotNull()
    passing = left.where(~whole)  # never in a window, however many there are
    left, nothing = left.where(whole), right.select(*values).schema
    tile = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / tile_days)
    found = F.struct(F.col(right_time).alias("t"), *[F.col(v) for v in values])
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    l_rows = left.select(F.col(on).alias("_k"), tile(left_time).alias("_tile"), F.col(left_time).cast("timestamp").alias("_t"), F.lit(1).alias("_side"), kept.alias("_row"))
    usable = right.where(F.col(on).isNotNull() & F.col(right_time).isNotNull())
    r_rows = usable.select(F.col(on).alias("_k"), tile(right_time).alias("_tile"), F.col(right_time).cast("timestamp").alias("_t"), F.lit(0).alias("_side"), found.alias("_found"))
    r_rows = r_rows.groupBy("_k", "_tile", "_t", "_side").agg(F.max("_found").alias("_found"))
    tiles = l_rows.select("_k", "_tile").distinct().unionByName(r_rows.groupBy("_k", "_tile").agg(F.max_by("_found", "_t").alias("_found")), allowMissingColumns=True)
    tiles = tiles.groupBy("_k", "_tile").agg(F.max("_found").alias("_found"))
    before = Window.partitionBy("_k").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = tiles.select("_k", "_tile", F.lit(None).cast("timestamp").alias("_t"), F.lit(-1).alias("_side"), F.last("_found", ignorenulls=True).over(before).alias("_found")).where("_found is not null")
    rows = l_rows.unionByName(r_rows, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    upto = Window.partitionBy("_k", "_tile").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = rows.select("_side", "_k", "_t", "_row", F.last("_found", ignorenulls=True).over(upto).alias("_found")).where("_side = 1")
    fits = F.col("_found").isNotNull()
    if tolerance_days is not None:
        fits = fits & (F.datediff("_t", "_found.t") <= tolerance_days)
    found = matched.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)], *[F.when(fits, F.col(f"_found.{v}")).alias(v) for v in values])
    return found.union(passing.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(nothing[v].dataType).alias(v) for v in values]))
