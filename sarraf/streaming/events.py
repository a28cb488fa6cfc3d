"""Streaming counterparts: windows with watermarks, sessions, monthly increments, change detection with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sarraf.sources.store import write_by_period


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream of the declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, time: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per time window, tumbling or sliding; with `late`, rows later than that are dropped and state is freed."""
    if late:
        events = events.withWatermark(time, late)
    span = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: rows no farther apart than `gap`."""
    if late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def monthly_increments(stream: DataFrame, path: str, checkpoint: str, build):
    """A file stream that rebuilds only the months it touches: `build(batch, months)` gives their rows, which replace the old."""

    def step(batch: DataFrame, _: int) -> None:
        months = batch.select("period").distinct()
        write_by_period(build(batch, months), path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def changes(stream: DataFrame, key: str, order: str, value: str, forget_after: str | None = None) -> DataFrame:
    """`key`, `order`, `old`, `new`, `late` whenever a key's value differs from the last one seen, kept as state per key.

    The rows of a key in one batch are put in order together, however they arrive. A row not
    after the last one seen is late: it changes no state and comes out with `late` true and
    `old` null, so nothing is lost. Null and NaN are one value, equal to themselves. With
    `forget_after` (such as `30 days`) the state of a key without rows for that long is dropped.
    """
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField(order, T.LongType()), T.StructField("old", T.DoubleType()), T.StructField("new", T.DoubleType()), T.StructField("late", T.BooleanType())])
    state = T.StructType([T.StructField("last", T.DoubleType()), T.StructField("at", T.LongType())])
    names = out.fieldNames()

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last, at = held.get if held.exists else (None, None)
        last, found = None if pd.isna(last) else last, []
        for o, v in pd.concat(list(frames)).sort_values([order, value], kind="stable")[[order, value]].itertuples(index=False):
            v = None if pd.isna(v) else float(v)
            if at is not None and o <= at:
                found.append((k[0], o, None, v, True))
                continue
            if at is not None and v != last:
                found.append((k[0], o, last, v, False))
            last, at = v, int(o)
        held.update((last, at))
        if forget_after:
            held.setTimeoutDuration(int(pd.Timedelta(forget_after).total_seconds() * 1000))
        yield pd.DataFrame(found, columns=names).astype({"old": "float64", "new": "float64", "late": "bool"})

    rows = stream.select(F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value)).where(F.col(order).isNotNull())
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(step, out, state, "append", timeout)
