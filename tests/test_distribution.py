"""Exact percentiles and ranks of groups against numpy, and rows in odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarraf.operators import asof, distribution, rules, windows


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    data = [("big", float(x)) for x in rng.normal(size=900)] + [("ties", float(x)) for x in rng.integers(0, 4, 200)] + [("one", 3.5), (None, 1.0), (None, 2.0), ("big", None), ("big", float("nan")), ("none", None)]
    frame = spark.createDataFrame(data, "g string, v double").withColumn("n", F.lit("clash")).withColumn("size", F.lit("clash")).repartition(7)
    named = {"low": 0.0, "mid": 0.5, "p90": 0.9, "top": 1.0}
    got = {r["g"]: r for r in distribution.percentiles(frame, ["g"], "v", named).collect()}
    values = {g: [v for k, v in data if k == g and v is not None and v == v] for g, _ in data}
    assert got.keys() == {g for g, v in values.items() if v}
    for g, r in got.items():
        assert r["n"] == len(values[g]) and [r[n] for n in named] == pytest.approx([np.quantile(values[g], f) for f in named.values()], abs=1e-9)
    assert distribution.percentiles(frame.limit(0), ["g"], "v", named).count() == 0
    assert distribution.medians(frame, {"all": F.col("v"), "none": F.when(F.col("g") == "none", F.col("v"))}) == {"all": pytest.approx(np.median([v for x in values.values() for v in x])), "none": None}


def test_cumulative_ranks_count_ties_and_keep_rows(spark):
    frame = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("a", 3.0, 3), ("a", None, 4), (None, 5.0, 5)], "g string, v double, k int")
    got = {r["k"]: r["rank"] for r in distribution.with_cumulative_rank(frame, "v", "g", "rank").collect()}
    assert got == {1: pytest.approx(200 / 3), 2: pytest.approx(200 / 3), 3: 100.0, 4: None, 5: 100.0}


def test_latest_row_is_one_row_a_key(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("a", None, "w"), (None, 1, "n"), ("b", None, "b")], "k string, t int, v string")
    assert {tuple(r) for r in windows.latest_row(frame, ["k"], ["t"]).collect()} == {("a", 2, "z"), (None, 1, "n"), ("b", None, "b")}


def test_asof_rows_without_key_or_time_pass_by(spark):
    left = spark.createDataFrame([(None, 1), (None, 1), ("a", None), ("a", 5), ("b", 5)], "k string, d int").select("k", F.date_add(F.lit("2024-01-01"), "d").alias("t"))
    right = spark.createDataFrame([("a", 3, 7), (None, 1, 9), ("a", None, 8)], "k string, d int, v int").select("k", F.date_add(F.lit("2024-01-01"), "d").alias("since"), "v")
    got = sorted(((r["k"], r["t"] is None, r["v"]) for r in asof.asof_join(left, right, "k", "t", "since", ["v"]).collect()), key=str)
    assert got == sorted([(None, False, None), (None, False, None), ("a", True, None), ("a", False, 7), ("b", False, None)], key=str)


def test_all_rules_run_in_one_pass(spark):
    rows = spark.createDataFrame([("e", 202401, 5.0, 1.0), ("e", 202402, 6.0, None), ("e", 202404, 7.0, 2.0), ("f", 202401, None, 3.0), (None, 202401, 9.0, None)], "e string, period int, x double, y double")
    both = [rules.Rule("R1", "x > 4", "x", "CASE WHEN x > 5 THEN 'B' ELSE 'A' END", None, "{x:,.1f} of {y:,.0f}"), rules.Rule("R2", "y > 0", "y", exclusion="x > 6")]
    got = sorted((tuple(r) for r in rules.run_rules(both, rows, "e", "period").collect()), key=str)
    assert got == sorted([
        ("e", "R1", "B", 202401, 202402, 2, 6.0, 11.0, "6.0 of not recorded"), ("e", "R1", "B", 202404, 202404, 1, 7.0, 7.0, "7.0 of 2"), (None, "R1", "B", 202401, 202401, 1, 9.0, 9.0, "9.0 of not recorded"),
        ("e", "R2", "MEDIUM", 202401, 202401, 1, 1.0, 1.0, None), ("f", "R2", "MEDIUM", 202401, 202401, 1, 3.0, 3.0, None),
    ], key=str)
