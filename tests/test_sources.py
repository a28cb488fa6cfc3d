"""Packs, scripts, versions, reports, bundles, queues and calendars in odd cases."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sarraf.functions import calendar as C
from sarraf.functions.amounts import expected_amount
from sarraf.operators import evidence, integrity, rules, windows
from sarraf.sources import packs, store, templates


def pack(folder, text, name="p.yaml"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return folder


def test_packs_are_digested_and_every_fault_is_fatal(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0)], "a int, b double")
    good = pack(tmp_path / "good", "rules:\n  - {code: R1, predicate: a > 0, impact: b, template: '{b}', evidence: [b]}\n")
    assert [r.code for r in packs.load_rules(good, rows)] == ["R1"]
    first = packs.load_pack(good)[1]
    assert first == packs.load_pack(good)[1]
    pack(good, '{"rules": [{"code": "R2", "predicate": "a > 1"}]}', "q.json")
    assert packs.load_pack(good)[1] != first and len(packs.load_rules(good)) == 2
    faulty = ["rules: [{code: R1}]", "rules: [{code: R1, predicate: a > 0, colour: red}]", "rules: [{code: r1, predicate: a > 0}]", "rules: [{code: R1, predicate: nothing > 0}]", "rules: [{code: R1, predicate: 5}]",
              "rules: [{code: R1, predicate: a > 0}, {code: R1, predicate: a > 1}]", "rules: [{code: R1, predicate: a > 0, template: '{b}'}]", "[1, 2]", "rules: [", ]
    for i, text in enumerate(faulty):
        with pytest.raises(packs.PackError):
            packs.load_rules(pack(tmp_path / f"bad{i}", text), rows)
    with pytest.raises(packs.PackError):
        packs.load_pack(tmp_path / "good" / ".." / "empty" if (tmp_path / "empty").mkdir() is None else "")
    assert len(packs.load_rules(packs.BUILT_IN)) == 2


def test_scripts_are_filled_in_and_cut():
    assert templates.render("a $x ${y_1}", {"x": "1", "y_1": "2"}) == "a 1 2"
    for values in ({"x": "1"}, {"x": "1", "y_1": "2", "z": "3"}):
        with pytest.raises(KeyError):
            templates.render("a $x ${y_1}", values)
    text = "-- one; two\nSELECT ';' AS a, \"b;c\" /* d; e */ FROM t - 1;\n;CREATE OR REPLACE TEMP VIEW v AS SELECT 1;"
    first, second = templates.statements(text)
    assert first.startswith("SELECT ';' AS a") and first.endswith("t - 1")
    assert templates.split_create(second) == ("v", "SELECT 1") and templates.split_create(first) == (None, first)
    assert templates.statements("") == []


def test_changes_hold_only_against_the_current_version(spark):
    current = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", None, 1)], "k string, v string, version int")
    changes = spark.createDataFrame([("a", "q", 1), ("a", "p", 1), ("b", "y", 1), ("z", "y", 1), ("c", "n", 1)], "k string, v string, based_on int")
    after, rejected = store.apply_versions(current, changes, "k", "v")
    assert {tuple(r) for r in after.collect()} == {("a", "p", 2), ("b", "x", 2), ("c", "n", 2)}
    assert {(r["k"], r["v"]) for r in rejected.collect()} == {("a", "q"), ("b", "y"), ("z", "y")}


def test_reports_and_declared_schemas(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    text = store.markdown("T", {"One": rows.orderBy("k")}, most=1)
    assert "| 1 | a\\|b |" in text and "(the first 1 rows)" in text and "| 2 |" not in text
    found = evidence.conform(spark.createDataFrame([("e", 3)], "employee_id string, period_from long"), evidence.FINDING)
    assert found.schema == evidence.FINDING and found.first()["period_from"] == 3
    with pytest.raises(ValueError):
        evidence.conform(rows, evidence.FINDING)
    assert evidence.read_conforming(spark, str(tmp_path / "none"), evidence.DISMISSAL).count() == 0


def test_faulty_bundles_never_leave(spark):
    rows = spark.createDataFrame([("a", "LOW"), ("b", "HIGH")], "k string, band string")
    wrong = evidence.faults({"k": F.col("k")}, {"band": (F.col("band"), ["LOW", "HIGH"])})
    assert {r[0] for r in rows.select(evidence.checked(F.to_json(F.struct("k")), wrong)).collect()} == {'{"k":"a"}', '{"k":"b"}'}
    for bad in (("c", "?"), (None, "LOW")):
        with pytest.raises(PySparkException):
            spark.createDataFrame([bad], "k string, band string").select(evidence.checked(F.to_json(F.struct("k")), wrong)).collect()


def test_queues_fill_bands_as_a_loop_would(spark):
    rng = random.Random(9)
    bands = [("A", 5, 88.0), ("B", 9, 72.0), ("C", None, 55.0)]
    for floor in (40, 80):
        data = [(i, float(rng.randrange(floor, 101)), rng.random() < 0.3) for i in range(80)]
        used, want = {"A": 0, "B": 0, "C": 0}, {}
        for i, score, hidden in sorted(data, key=lambda r: (-r[1], r[0])):
            want[i] = "rest"
            for name, size, least in bands:
                if score >= least and (size is None or used[name] < size):
                    want[i] = name
                    used[name] += not hidden
                    break
        frame = spark.createDataFrame(data, "k int, score double, hidden boolean").repartition(5)
        got = windows.capacity_bands(frame, [F.col("score").desc(), F.col("k")], "score", bands, "rest", ~F.col("hidden"))
        assert {r["k"]: r["band"] for r in got.collect()} == want
    assert windows.capacity_bands(frame.limit(0), [F.col("score").desc()], "score", bands, "rest").count() == 0


def test_ranks_within_groups(spark):
    frame = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), ("b", 2), (None, 4)], "g string, v int")
    got = {(r["g"], r["v"]): r["n"] for r in windows.rank_within(frame, "g", [F.col("v").desc()], "n").collect()}
    assert got == {("a", 3): 1, ("a", 1): 2, (None, 5): 1, (None, 4): 2, ("b", 2): 1}


def test_calendars_ids_and_amounts(spark):
    day = F.to_date(F.lit("2024-07-07"))
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(C.hijri(day), "ymd")], C.working_days(F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-31"))).alias("w"), C.named_uuid(F.lit("python.org"), "6ba7b8109dad11d180b400c04fd430c8").alias("u"), C.named_uuid(F.lit(None).cast("string")).alias("none")).first()
    assert (row["y"], row["m"], row["d"]) == (1445, 12, 30) or (row["y"], row["m"], row["d"]) == (1446, 1, 1)
    assert row["w"] == sum((dt.date(2024, 1, 1) + dt.timedelta(i)).weekday() not in (4, 5) for i in range(31))
    assert row["u"] == "886313e1-3b8a-5372-9b90-0c9aee199e5d"
    amounts = spark.createDataFrame([(1, 2, 10.0), (9, None, None)], "level int, heads int, base double").select(
        expected_amount("fixed", amount=5).alias("a"), expected_amount("fixed", amount=5, count=F.col("heads"), most=1).alias("b"), expected_amount("share_of_base", share="0.333", base=F.col("base")).alias("c"), expected_amount("by_level", level=F.col("level"), table={1: "7.5"}).alias("d"))
    assert [[None if v is None else float(v) for v in r] for r in amounts.collect()] == [[5.0, 5.0, 3.33, 7.5], [5.0, None, None, 0.0]]
    with pytest.raises(ValueError):
        expected_amount("other")


def test_values_outside_enumerations(spark):
    frame = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "v string")
    assert [tuple(r) for r in integrity.outside(frame, {"v": ["a"]}).collect()] == [("v", 2)]


def test_profiles_are_merged_by_stage(spark, tmp_path):
    for names in (("a", "b"), ("b", "b", "c")):
        profile = store.Profile(spark, f"file://{tmp_path}/profile.json")
        for name in names:
            with profile.stage(name):
                spark.range(3).count()
        merged = profile.merge()
    assert {n: s["runs"] for n, s in merged.items()} == {"a": 1, "b": 2, "c": 1} and all(s["peak_mb"] > 0 and s["seconds"] >= 0 for s in merged.values())
    with pytest.raises(ZeroDivisionError), profile.stage("d"):
        1 / 0
    assert profile.stages["d"]["runs"] == 1


def test_clauses_with_dots_and_null(spark):
    rows = spark.createDataFrame([(1, ("x", 3), 7), (2, (None, 5), None)], "k int, s struct<a:string,b:int>, `t.u` int")
    tests = {"s.b >= 4": [2], "s.a == null": [], "s.a != null": [1], "t.u != null": [1], "t.u not in [8, 9]": [1], "s.a in [x, y]": [1], "t.u == 7": [1]}
    for text, want in tests.items():
        assert [r["k"] for r in rows.where(rules.clause(text, rows.columns)).orderBy("k").collect()] == want, text
    for bad in ("s.b > null", "s.b in 4", "s..b == 1", "== 1", "k ~ 1"):
        with pytest.raises(ValueError):
            rules.clause(bad)
