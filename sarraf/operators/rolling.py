"""Trailing totals per entity and step of time, steps without rows included (problem 6).

Values are pre-aggregated per entity and step, gathered per entity and time tile
together with the halo of preceding steps that the windows of the tile reach back to,
packed from sparse lists into dense numpy blocks (entities by steps) and multiplied by a
banded 0/1 operator, one band per window length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers up to this size are exact in the floating-point matrix product.
_EXACT = 2**53


def band(tile: int, halo: int, window: int) -> np.ndarray:
    """The operator of a trailing window: column t sums the `window` steps that end in step t of the tile."""
    source = np.arange(halo + tile)[:, None] - halo
    target = np.arange(tile)[None, :]
    return ((source <= target) & (source > target - window)).astype(np.float64)


def _block_sums(dense: np.ndarray, bands: list[np.ndarray]) -> list[np.ndarray]:
    if np.abs(dense).sum(axis=1, dtype=np.float64).max(initial=0) < _EXACT:
        floats = dense.astype(np.float64)
        return [np.rint(floats @ b).astype(np.int64) for b in bands]
    return [dense @ b.astype(np.int64) for b in bands]


def rolling_totals(
    rows: DataFrame,
    key: str,
    step: str,
    value: str,
    windows: list[int],
    tile: int = 24,
    first: int | None = None,
    last: int | None = None,
    beyond: int = 0,
) -> DataFrame:
    """`key`, `step`, `nth` and a column `total_<w>` (whole numbers) for each window length.

    `step` counts whole time steps (days or months), `value` is a whole number (cents,
    counts); rows of one entity and step add up, a null value counts as zero. Each entity
    has a row for every step from its first to its last step (plus `beyond`), held within
    `first`..`last` where these are given; `nth` is 1 in its first step. Rows with null key
    or step are left out; an empty table gives no rows; other columns are ignored.

    A hot entity is reduced to one row per step before the shuffle, and its tiles are
    spread over tasks: a gathered list never exceeds tile + halo values.
    """
    halo = max(windows) - 1
    given = rows.select(F.col(key).alias("_k"), F.col(step).cast("int").alias("_t"), F.col(value).cast("long").alias("_v")).where("_k is not null and _t is not null")
    steps = given.groupBy("_k", "_t").agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("_v"))
    lo, hi = F.min("_t"), F.max("_t") + beyond
    if first is not None:
        lo = F.greatest(lo, F.lit(first))
    if last is not None:
        hi = F.least(hi, F.lit(last))
    spans = given.groupBy("_k").agg(lo.alias("_lo"), hi.alias("_hi")).where("_lo <= _hi")
    tiles = spans.select("_k", F.explode(F.sequence(F.floor(F.col("_lo") / tile).cast("int"), F.floor(F.col("_hi") / tile).cast("int"))).alias("_tile"), "_lo", "_hi")
    own = F.floor(F.col("_t") / tile).cast("int")
    reach = F.floor((F.col("_t") + halo) / tile).cast("int")
    cells = steps.select("_k", F.explode(F.sequence(own, reach)).alias("_tile"), "_t", "_v")
    cells = cells.unionByName(tiles, allowMissingColumns=True)
    packed = cells.groupBy("_k", "_tile").agg(
        F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_t", "_v"))).alias("_cells")
    ).where("_lo is not null")
    packed = packed.select("_k", "_tile", "_lo", "_hi", F.col("_cells._t").alias("_ts"), F.col("_cells._v").alias("_vs"))
    bands = [band(tile, halo, w) for w in windows]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            start = batch.column(1).to_numpy().astype(np.int64) * tile
            lists, values = batch.column(4), batch.column(5)
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(n), sizes)
            dense = np.zeros((n, halo + tile), dtype=np.int64)
            dense[at, lists.flatten().to_numpy() - start[at] + halo] = values.flatten().to_numpy()
            sums = _block_sums(dense, bands)
            t = start[:, None] + np.arange(tile)
            low, high = batch.column(2).to_numpy()[:, None], batch.column(3).to_numpy()[:, None]
            entity, offset = np.nonzero((t >= low) & (t <= high))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(entity)), pa.array(t[entity, offset].astype(np.int32)), pa.array((t - low + 1)[entity, offset].astype(np.int32)), *[pa.array(s[entity, offset]) for s in sums]],
                names=["_k", "_t", "nth", *[f"total_{w}" for w in windows]],
            )

    kind = packed.schema["_k"].dataType
    schema = T.StructType([T.StructField("_k", kind), T.StructField("_t", T.IntegerType()), T.StructField("nth", T.IntegerType()), *[T.StructField(f"total_{w}", T.LongType()) for w in windows]])
    return packed.mapInArrow(blocks, schema).withColumnsRenamed({"_k": key, "_t": step})


def rolling_mean(total: Column, window: int) -> Column:
    """The average over a trailing window, steps without rows counting as zero."""
    return total / F.lit(window)
