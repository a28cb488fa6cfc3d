"""The general problems against brute force, and their defined results in odd cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarraf.operators import attributes, hierarchy, intervals, rolling

D = dt.date


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def brute_periods(spans):
    days = {}
    for f, t in set(spans):
        for d in range(f, t + 1):
            days[d] = days.get(d, 0) + 1
    out, run = [], []
    for d in sorted(days):
        if run and d != run[-1] + 1:
            out.append((run[0], run[-1], max(days[x] for x in run)))
            run = []
        run.append(d)
    return out + ([(run[0], run[-1], max(days[x] for x in run))] if run else [])


def test_periods_equal_brute_force(spark):
    rng = random.Random(5)
    base = D(2024, 1, 1)
    data, want = [], []
    for k in range(60):
        spans = [(s, s + rng.randrange(0, 9)) for s in (rng.randrange(0, 40) for _ in range(rng.randrange(1, 8)))]
        data += [(f"e{k}", base + dt.timedelta(s), base + dt.timedelta(t)) for s, t in spans + spans[:1]]
        want += [(f"e{k}", base + dt.timedelta(f), base + dt.timedelta(t), n) for f, t, n in brute_periods(spans)]
    frame = spark.createDataFrame(data, "k string, f date, t date")
    got = intervals.coalesce_intervals(frame, ["k"], "f", "t").select("k", "from_day", "to_day", "deepest")
    assert rows(got) == sorted(want)


def test_interval_odd_cases(spark):
    schema = "k string, a date, b date, _d int, kind string"
    frame = spark.createDataFrame([("x", D(2024, 1, 1), None, 1, "q"), ("x", None, D(2024, 1, 1), 1, "q"), ("x", D(2024, 2, 2), D(2024, 2, 1), 1, "q"), (None, D(2024, 1, 1), D(2024, 1, 2), 1, "q")], schema)
    valid = intervals.valid_intervals(frame, F.col("k"), "a", "b")
    assert rows(valid) == [("x", D(2024, 1, 1), D(9999, 12, 31))]
    got = intervals.periods_and_gaps(frame.where("a is not null and b is not null"), ["k"], "a", "b")
    assert rows(got) == [(None, "period", D(2024, 1, 1), D(2024, 1, 2))]
    assert intervals.coalesce_intervals(frame.limit(0), ["k"], "a", "b").count() == 0


def test_adjoining_days_continue_and_touching_days_merge(spark):
    frame = spark.createDataFrame([("x", D(2024, 1, 1), D(2024, 1, 5)), ("x", D(2024, 1, 6), D(2024, 1, 7)), ("y", D(2024, 1, 1), D(2024, 1, 5)), ("y", D(2024, 1, 5), D(2024, 1, 7)), ("y", D(2024, 1, 9), D(2024, 1, 9))], "k string, f date, t date")
    got = intervals.periods_and_gaps(frame, ["k"], "f", "t")
    assert rows(got) == [("x", "period", D(2024, 1, 1), D(2024, 1, 7)), ("y", "gap", D(2024, 1, 8), D(2024, 1, 8)), ("y", "merged", D(2024, 1, 1), D(2024, 1, 7)), ("y", "period", D(2024, 1, 9), D(2024, 1, 9))]


def test_attributes_equal_brute_force(spark):
    rng = random.Random(9)
    base = D(2024, 1, 1)
    day = lambda n: base + dt.timedelta(n)
    spans, events = [], []
    for k in range(40):
        for s in rng.sample(range(60), rng.randrange(1, 7)):
            spans.append((f"e{k}", day(s), day(s + rng.randrange(0, 25)), rng.choice([None, 1, 2]), rng.choice([None, 10.0, 20.0])))
        events += [(f"e{k}", day(rng.randrange(0, 90))) for _ in range(10)]
    frame = spark.createDataFrame(spans, "k string, f date, t date, g int, s double")
    histories = attributes.change_histories(frame, "k", "f", "t", {"start": F.col("f"), "g": F.col("g"), "s": F.col("s")})
    got = attributes.as_known_at(spark.createDataFrame(events, "k string, d date"), "k", "d", histories, ["start", "g", "s"])
    want = set()
    for k, d in events:
        covering = [x for x in spans if x[0] == k and x[1] <= d <= x[2]]
        best = max(covering, key=lambda x: x[1]) if covering else (None,) * 5
        want.add((k, d, best[1], best[3], best[4]))
    assert {tuple(r) for r in got.collect()} == want
    per_attribute = histories.groupBy("_k", "_attribute", "_day").count().where("count > 1")
    assert per_attribute.count() == 0


def test_attributes_of_null_and_unknown_events(spark):
    held = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 1, 31), 5)], "k string, f date, t date, g int")
    h = attributes.change_histories(held, "k", "f", "t", {"g": F.col("g")})
    events = spark.createDataFrame([(None, D(2024, 1, 2)), ("a", None), ("b", D(2024, 1, 2)), ("a", D(2023, 12, 31)), ("a", D(2024, 2, 1)), ("a", D(2024, 1, 31))], "k string, d date")
    got = {(r["k"], r["d"]): r["g"] for r in attributes.as_known_at(events, "k", "d", h, ["g"]).collect()}
    assert got == {(None, D(2024, 1, 2)): None, ("a", None): None, ("b", D(2024, 1, 2)): None, ("a", D(2023, 12, 31)): None, ("a", D(2024, 2, 1)): None, ("a", D(2024, 1, 31)): 5}
    empty = attributes.as_known_at(events.limit(0), "k", "d", h, ["g"])
    assert empty.count() == 0


def brute_tree(links):
    parent = dict(links)
    out = set()
    for n in parent:
        seen, at = [n], n
        while parent.get(at) is not None and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        up = parent.get(at)
        if up is None:
            out.add((n, at, len(seen) - 1, "tree"))
        else:
            loop = seen[seen.index(up) :]
            depth = seen.index(up)
            out.add((n, min(loop), depth, "cycle" if depth == 0 else "into_cycle"))
    return out


@pytest.mark.parametrize("per_task", [1_000_000, 40])
def test_hierarchy_equals_brute_force(spark, per_task):
    rng = random.Random(per_task)
    names = [f"n{i:03d}" for i in range(300)]
    links = [(n, None if rng.random() < 0.03 else rng.choice(names[max(0, i - 30) : i + 4] + ["unknown"])) for i, n in enumerate(names)]
    frame = spark.createDataFrame(links + links[:5], "e string, m string")
    got = hierarchy.hierarchy(frame, "e", "m", links_per_task=per_task)
    assert {tuple(r) for r in got.collect()} == brute_tree(links)


def test_long_chain_and_paths(spark):
    links = [(f"{i:04d}", f"{i - 1:04d}" if i else None) for i in range(200)]
    frame = spark.createDataFrame(links, "e string, m string")
    got = hierarchy.hierarchy(frame, "e", "m", links_per_task=60)
    assert {tuple(r) for r in got.collect()} == {(f"{i:04d}", "0000", i, "tree") for i in range(200)}
    short = frame.where("e < '0006'")
    walked = hierarchy.paths(short, "e", "m", hierarchy.hierarchy(short, "e", "m"))
    assert {tuple(r) for r in hierarchy.descendants(walked, "e").collect()} == {(f"{a:04d}", f"{b:04d}", b - a) for b in range(6) for a in range(b)}


def test_hierarchy_odd_cases(spark):
    schema = "e string, m string, node string, depth int"
    got = hierarchy.hierarchy(spark.createDataFrame([("a", "a", "x", 1), ("b", "a", "x", 1), (None, "a", "x", 1), ("c", None, "x", 1), ("c", "d", "x", 1)], schema), "e", "m")
    assert {tuple(r) for r in got.collect()} == {("a", "a", 0, "cycle"), ("b", "a", 1, "into_cycle"), ("c", "d", 1, "tree")}
    assert hierarchy.hierarchy(spark.createDataFrame([], schema), "e", "m").count() == 0


def test_rolling_equals_brute_force(spark):
    rng = random.Random(3)
    data = [(f"e{rng.randrange(20)}", rng.randrange(1, 70), rng.choice([None, rng.randrange(-50, 50)])) for _ in range(400)]
    data += [(None, 3, 1), ("e1", None, 1)]
    frame = spark.createDataFrame(data, "k string, t int, v long").withColumn("_v", F.lit("clash"))
    got = rolling.rolling_totals(frame, "k", "t", "v", [3, 7, 30], tile=10)
    want = set()
    for k in {d[0] for d in data} - {None}:
        mine = [(t, v or 0) for n, t, v in data if n == k and t is not None]
        lo, hi = min(t for t, _ in mine), max(t for t, _ in mine)
        for t in range(lo, hi + 1):
            want.add((k, t, t - lo + 1, *[sum(v for u, v in mine if t - w < u <= t) for w in (3, 7, 30)]))
    assert {tuple(r) for r in got.collect()} == want
    assert rolling.rolling_totals(frame.limit(0), "k", "t", "v", [3]).count() == 0


def test_rolling_is_exact_beyond_doubles(spark):
    frame = spark.createDataFrame([("a", 1, 2**60 + 1), ("a", 2, 2**60 + 1)], "k string, t int, v long")
    assert [r["total_2"] for r in rolling.rolling_totals(frame, "k", "t", "v", [2]).orderBy("t").collect()] == [2**60 + 1, 2**61 + 2]


def test_band_operator():
    b = rolling.band(3, 2, 2)
    assert np.array_equal(np.array([[1, 2, 3, 4, 5]]) @ b, [[5, 7, 9]])


def test_paths_begin_with_roots_that_have_no_row(spark):
    links = spark.createDataFrame([("a", "gone"), ("b", "a"), ("c", "b"), ("d", None), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "x")], "n string, p string")
    found = hierarchy.hierarchy(links, "n", "p")
    got = {r["n"]: "/".join(r["path"]) for r in hierarchy.paths(links, "n", "p", found).collect()}
    assert got == {"a": "gone/a", "b": "gone/a/b", "c": "gone/a/b/c", "d": "d", "e": "d/e", "x": "x", "y": "y", "z": "x/z"}
