"""Operators that have no SQL here, or whose odd cases matter: as-of, rules, bands, scores, stores, streams."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sarraf.functions import keys, periods, text
from sarraf.operators import asof, graphs, integrity, ml, rules, windows
from sarraf.sources import store
from sarraf.sources.catalog import Lake
from sarraf.streaming import events

D = dt.date


def test_asof_equals_brute_force(spark):
    rng = random.Random(7)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    left = [(f"k{rng.randrange(4)}", day(rng.randrange(1500)), i) for i in range(200)] + [(None, day(3), 900), ("k1", None, 901), ("zz", day(1), 902)]
    right = [(f"k{rng.randrange(4)}", day(rng.randrange(1500)), rng.randrange(100)) for _ in range(60)] + [(None, day(1), 5), ("k1", None, 6)]
    frames = spark.createDataFrame(left, "k string, t date, id int"), spark.createDataFrame(right, "k string, u date, v int")
    got = {r["id"]: r["v"] for r in asof.asof_join(*frames, "k", "t", "u", ["v"], tile_days=90).collect()}
    for k, t, i in left:
        fits = [(u, v) for x, u, v in right if x == k and k and u and t and u <= t]
        assert got[i] == (max(fits)[1] if fits else None)
    near = {r["id"]: r["v"] for r in asof.asof_join(*frames, "k", "t", "u", ["v"], tolerance_days=10).collect()}
    for k, t, i in left:
        fits = [(u, v) for x, u, v in right if x == k and k and u and t and u <= t]
        assert near[i] == (max(fits)[1] if fits and (t - max(fits)[0]).days <= 10 else None)


def test_clauses_and_templates(spark):
    frame = spark.createDataFrame([(5, "a", None), (None, "b", 2.5)], "n int, s string, x double")
    got = frame.select(rules.clause("n >= 5").alias("p"), rules.clause("s not in [a, c]").alias("q"), rules.failing(["n < 9", "x > 1"]).alias("f"), rules.message("{s}: {x:,.1f} of {n}").alias("m")).collect()
    assert [tuple(r) for r in got] == [(True, False, ["x > 1"], "a: not recorded of 5"), (False, True, ["n < 9"], "b: 2.5 of not recorded")]
    with pytest.raises(ValueError):
        rules.clause("n ~ 5")
    with pytest.raises(Exception, match="nowhere"):
        rules.Rule("Q01", "nowhere > 1").validate(frame)


def test_check_digits(spark):
    values = ["SA32 2300 0000 3000 0000 3168", "sa32-23-000000300000003168", "SA0000000000000000000000", "٠٠", None, "", "GB82WEST12345698765432"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(keys.iban_ok(keys.bare_code("v")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False, False, True]
    ids = ["1-016207357", "1016207358", "٠", "0000000000", None, "2016207357"]
    got = spark.createDataFrame([(v,) for v in ids], "v string").select(keys.national_id_ok(keys.bare_code("v")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False, False, False]


def test_periods(spark):
    got = spark.createDataFrame([(202311,)], "p int").select(periods.period_add("p", 3).alias("a"), periods.last_day("p").alias("l"), periods.month_label("p").alias("m"), periods.is_period(F.lit(202313)).alias("n")).first()
    assert tuple(got) == (202402, D(2023, 11, 30), "November 2023", False)
    assert periods.to_period(periods.to_index(202312) + 1) == 202401


def test_similarities():
    left, right = ["MARTHA", "DIXON", "", "a", "CRATE", "x" * 300, "JELLYFISH"], ["MARHTA", "DICKSONX", "", "", "TRACE", "x" * 299, "SMELLYFISH"]
    assert text.jaro_similarities(left, right) == pytest.approx([0.944444, 0.766667, 1.0, 0.0, 0.733333, 0.998889, 0.896296], abs=1e-6)
    assert text.jaro_winkler_similarities(left[:2], right[:2]) == pytest.approx([0.961111, 0.813333], abs=1e-6)
    assert len(text.jaro_winkler_similarities([], [])) == 0
    assert text.latin_key(" José  d'Arc ") == "JOSE D ARC"


def test_global_rank_has_no_gap_or_tie(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = windows.global_rank(frame, [F.col("v").desc(), F.col("id")], "n").collect()
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["n"])] == want and sorted(r["n"] for r in got) == list(range(1, 1001))


def test_cycles_and_components(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("e", "f"), (None, "a")]
    frame = spark.createDataFrame(links, "x string, y string")
    assert sorted(tuple(r["path"]) for r in graphs.simple_cycles(frame, "x", "y", 5).collect()) == [("a", "b"), ("a", "b", "c")]
    assert {tuple(r) for r in graphs.components(frame, "x", "y").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "e")}


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(0)
    data = [(str(i), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [("far", 9.0, -9.0)]
    frame = spark.createDataFrame(data, "k string, a double, b double")
    scores = {r["k"]: r["isolation"] for r in ml.isolation_forest(frame, "k", ["a", "b"], trees=50).collect()}
    assert max(scores, key=scores.get) == "far" and scores["far"] > 0.65
    assert ml.isolation_forest(frame.limit(0), "k", ["a", "b"]).count() == 0


def test_reconstruction_gap_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 1)) @ np.array([[1.0, 2.0, -1.0]]) + 0.01 * rng.normal(size=(200, 3))
    x[7] = [3.0, -6.0, 3.0]
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k int, a double, b double, c double")
    got = {r["k"]: (r["gap"], r["top"]) for r in ml.reconstruction_gap(frame, "k", ["a", "b", "c"], 1).select("k", "gap", ml.attributions("gaps", ["a", "b", "c"])[0]["name"].alias("top")).collect()}
    centred = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    gaps = np.linalg.norm(centred - centred @ v[:1].T @ v[:1], axis=1)
    assert all(got[i][0] == pytest.approx(gaps[i], abs=1e-6) for i in range(200)) and int(np.argmax(gaps)) == 7


def test_substitutions_add_up(spark):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))] + [(99, 1.0, 1.0), (98, None, None)], "k long, a double, b double")
    model = lambda m: 2 * m[:, 0] + 3 * m[:, 1] + m[:, 0] * m[:, 1]
    told = ml.substitutions(frame, "k", ["a", "b"], model, [1.0, 1.0])
    check = ml.additivity(told, ["a", "b"], 1e-6).first()
    assert check["rows"] == 52 and check["beyond"] == 0
    at_median = told.where("k = 99").first()
    assert (at_median["a"], at_median["b"], at_median["prediction"]) == (0.0, 0.0, 6.0)


def test_boosted_trees_learn_steps_and_keep_leaves(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, size=(3000, 2))
    y = np.where(x[:, 0] > 5, 100.0, 10.0) + 20 * (x[:, 1] > 2)
    model = ml.BoostedTrees(x, y, iterations=60)
    assert np.abs(model(x) - y).mean() < 2
    small = ml.BoostedTrees(x[:60], y[:60], iterations=10)  # no split leaves forty on both sides
    assert len(set(small(x).tolist())) == 1
    frame = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x[:400], y[:400]))], "k long, a double, b double, t double")
    found, _ = ml.boosted_expectation(frame, "k", ["a", "b"], "t", iterations=40, least=10)
    assert found.count() == 400 and np.mean([abs(r["expected"] - y[r["k"]]) for r in found.collect()]) < 8
    assert ml.boosted_expectation(frame.limit(0), "k", ["a", "b"], "t")[0].count() == 0


def test_autoencoder_gap_is_greatest_for_strange_rows(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 1))
    rows = np.column_stack([base, base + 0.05 * rng.normal(size=(400, 1)), -base])
    data = [(i, *map(float, r)) for i, r in enumerate(rows)] + [(900, 3.0, -3.0, 3.0)]
    found = ml.autoencoder_gap(spark.createDataFrame(data, "k long, a double, b double, c double"), "k", ["a", "b", "c"], widths=(16, 8, 1), epochs=40, batch=64)
    got = {r["k"]: r["gap"] for r in found.collect()}
    assert len(got) == 401 and max(got, key=got.get) == 900
    assert ml.flagged(found, "gap", 0.025, "odd").where("odd").count() == 10


def test_catalog_and_schema(spark):
    lake = Lake(spark, "/nowhere")
    with pytest.raises(KeyError):
        lake.path("labels")
    with pytest.raises(AttributeError):
        _ = lake.labels
    frame = spark.createDataFrame([(1, "a")], "k int, v string")
    assert integrity.schema_faults(frame, T.StructType([T.StructField("k", T.LongType()), T.StructField("w", T.StringType())])) == ["missing w", "extra v", "k is int"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"u{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=11 * i), float(i % 4)) for i in range(60)]
    frame = spark.createDataFrame(rows, "u string, ts timestamp, v double")
    frame.write.parquet(f"{tmp_path}/in")
    stream = events.read_stream(spark, f"{tmp_path}/in", frame.schema)
    for name, make in (("w", lambda f: events.windowed(f, "ts", ["u"], "v", "1 hour", late="1 day")), ("s", lambda f: events.sessions(f, "ts", "u", "20 minutes", late="1 day"))):
        run = make(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").option("checkpointLocation", f"{tmp_path}/c{name}").trigger(availableNow=True).start()
        run.awaitTermination(120)
        want = {tuple(r) for r in make(frame).collect()}
        got = {tuple(r) for r in spark.table(name).collect()}
        assert got == want if name == "w" else got <= want


def test_monthly_increments_replace_months(spark, tmp_path):
    schema = "period int, k string, v int"
    spark.createDataFrame([(202401, "a", 1), (202402, "a", 2)], schema).write.parquet(f"{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    for more in (None, [(202402, "b", 7)]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(f"{tmp_path}/in")
        whole = spark.read.parquet(f"{tmp_path}/in")
        stream = events.read_stream(spark, f"{tmp_path}/in", whole.schema)
        step = events.monthly_increments(stream, out, f"{tmp_path}/c", lambda batch, months: whole.join(months, "period", "left_semi").groupBy("period").agg(F.sum("v").alias("v"), F.count("*").alias("n")))
        step.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r) for r in store.read_by_period(spark, out).collect()) == [(202401, 1, 1), (202402, 9, 2)]


def test_changes_are_kept_across_batches(spark, tmp_path):
    schema = "k string, o long, v double"
    nan = float("nan")
    parts = [
        [[("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, 1.0), ("n", 1, nan)]],
        [[("a", 4, 7.0), ("b", 2, 1.0)], [("a", 3, 6.0), ("n", 2, nan), ("n", 3, None)]],  # two files of one batch, out of order
        [[("a", 2, 9.0), ("a", 5, 7.0), ("b", 3, 2.0), ("n", 4, 1.0), ("n", None, 3.0)]],
    ]
    for files in parts:
        for part in files:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = events.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        run = events.changes(stream, "k", "o", "v").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination(120)
    got = {tuple(r) for r in spark.read.schema("k string, o long, old double, new double, late boolean").parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 3, 5.0, 6.0, False), ("a", 4, 6.0, 7.0, False), ("a", 2, None, 9.0, True), ("b", 3, 1.0, 2.0, False), ("n", 4, None, 1.0, False)}


def test_cut_tables_are_released(spark):
    from pathlib import Path

    from sarraf.session import cut, ensure_checkpoint_dir, release

    frame = cut(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert frame.count() == 5 and frame.columns == ["id", "x"]
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    assert list(folder.glob("cut-*"))
    assert release(spark) > 0 and not list(folder.glob("cut-*")) and release(spark) == 0
