"""Attributes as known at event time (problem 4).

Every attribute has its own change history: one row per day on which the value of that
attribute changes. An event takes, of each attribute separately, the last change not
after its day; the matches are then pivoted back to one row per event. An attribute
that changes seldom costs few rows, whatever the others do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarraf.operators.intervals import OPEN_END


def change_histories(intervals: DataFrame, key: str, start: str, end: str, attributes: dict[str, Column]) -> DataFrame:
    """Independent change histories: `_k`, `_day`, `_attribute` and one `_v_<name>` per attribute.

    `_v_<name>` is a struct of one field `v`, filled only in rows of that attribute, so a
    change to null differs from no change. In force on a day is the valid interval
    covering it with the latest start; of several with that start, the one that ends
    last, then the one with the greatest attribute values. Where no interval covers the
    day all attributes change to null.

    Intervals are reduced to one per key and start before they are gathered by key, so a
    key's array is bounded by the number of different days, not by its rows.
    """
    names = list(attributes)
    rows = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_f"), F.struct(F.col(end).alias("t"), *[c.alias(f"a{i}") for i, c in enumerate(attributes.values())]).alias("_x"))
    latest = rows.where(F.col("_k").isNotNull() & (F.col("_f") <= F.col("_x.t"))).groupBy("_k", "_f").agg(F.max("_x").alias("_x"))
    by_key = latest.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_f", "_x"))).alias("_all"))
    starts = F.transform("_all", lambda r: r["_f"])
    stops = F.transform(F.filter("_all", lambda r: r["_x"]["t"] < F.lit(OPEN_END)), lambda r: F.date_add(r["_x"]["t"], 1))
    days = F.array_sort(F.array_distinct(F.concat(starts, stops)))

    def in_force(day: Column) -> Column:
        covering = F.filter("_all", lambda r: (r["_f"] <= day) & (r["_x"]["t"] >= day))
        return F.get(covering, F.size(covering) - 1)["_x"]

    steps = by_key.select("_k", F.inline(F.transform(days, lambda d: F.struct(d.alias("_day"), in_force(d).alias("_x")))))
    order = Window.partitionBy("_k").orderBy("_day")
    steps = steps.select("_k", "_day", "_x", F.lag("_x").over(order).alias("_old"), F.row_number().over(order).alias("_n"))
    changes = []
    for i, name in enumerate(names):
        new, old = F.col(f"_x.a{i}"), F.col(f"_old.a{i}")
        empty = [F.lit(None).cast(_struct(rows, j)).alias(f"_v_{n}") for j, n in enumerate(names)]
        empty[i] = F.struct(new.alias("v")).alias(f"_v_{name}")
        changes.append(F.when((F.col("_n") == 1) | ~new.eqNullSafe(old), F.struct(F.lit(name).alias("_attribute"), *empty)))
    return steps.select("_k", "_day", F.inline(F.filter(F.array(*changes), lambda c: c.isNotNull())))


def _struct(rows: DataFrame, i: int) -> str:
    kind = rows.schema["_x"].dataType[f"a{i}"].dataType
    return f"struct<v:{kind.simpleString()}>"


def as_known_at(events: DataFrame, key: str, day: str, histories: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per different (key, day) of `events` with the last known value of each attribute.

    Columns: the key and the day under their own names, then the attributes. A value of a
    later day is never used; an attribute without a change up to the day, or last changed
    to null, is null. Events with null key or day get null attributes. Repeated events give
    one row. Hot keys are reduced to their different days before the shuffle.
    """
    moments = events.select(F.col(key).alias("_k"), F.col(day).alias("_day")).distinct()
    moments = moments.withColumn("_event", F.lit(1))
    both = moments.unionByName(histories.withColumn("_event", F.lit(0)), allowMissingColumns=True)
    last = Window.partitionBy("_k").orderBy("_day", "_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.select("_k", "_day", "_event", *[F.last(f"_v_{a}", ignorenulls=True).over(last)["v"].alias(a) for a in attributes])
    known = known.where("_event = 1")
    usable = F.col("_k").isNotNull() & F.col("_day").isNotNull()
    return known.select(F.col("_k").alias(key), F.col("_day").alias(day), *[F.when(usable, F.col(a)).alias(a) for a in attributes])
