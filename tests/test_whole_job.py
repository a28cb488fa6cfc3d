"""The whole job of queries whose SQL leaves part of it out: the SQL, unchanged, over tables that have the rest put right."""

from collections import Counter
from decimal import Decimal

import pytest
from compare import DATA, connect, rows_of_frame, rows_of_sql

from sarraf.operators import ml
from sarraf.plans import registry

SMALL = DATA / "sf0.001"


@pytest.mark.parametrize("name", ["p6_found", "p6_net_totals"])
def test_repeated_payroll_rows_count_once(spark, name):
    con = connect(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW fact_payroll_monthly AS SELECT DISTINCT * FROM read_parquet('{SMALL}/fact_payroll_monthly.parquet')")
    assert rows_of_frame(registry.QUERIES[name](spark, str(SMALL))) == rows_of_sql(con, registry.SQL[name])


def test_a_repeated_row_counts_once_and_a_supplement_adds_up(spark, tmp_path):
    payroll = spark.read.parquet(str(SMALL / "fact_payroll_monthly.parquet"))
    row = payroll.where("employee_id <> 'E00000000'").first().asDict() | {"period": 202401, "paid_flag": True, "net": Decimal("100.01"), "payroll_run_id": "R"}
    rows = [row | {"employee_id": "E1"}, row | {"employee_id": " e1"}, row | {"employee_id": "E1"}, row | {"employee_id": "E1", "payroll_run_id": "S"}]
    spark.createDataFrame(rows, payroll.schema).write.parquet(str(tmp_path / "fact_payroll_monthly.parquet"))
    got = registry.QUERIES["p6_net_totals"](spark, str(tmp_path)).select("employee_id", "period", "net_3").collect()
    assert [tuple(r) for r in got] == [("E1", 202401, Decimal("200.02"))]


@pytest.mark.parametrize("name", ["j03_left_two_keys", "a05_spread_and_slope", "w03_lag_lead", "w08_cusum", "w11_islands", "w12_conditional_window"])
def test_the_pooled_account_is_not_left_out(spark, name):
    con = connect(SMALL)
    other = "CASE employee_id WHEN 'E00000000' THEN 'POOLED' ELSE employee_id END"  # a name that no SQL leaves out
    con.execute(f"CREATE OR REPLACE VIEW fact_payroll_monthly AS SELECT * REPLACE ({other} AS employee_id) FROM read_parquet('{SMALL}/fact_payroll_monthly.parquet')")
    names, theirs = rows_of_sql(con, registry.SQL[name])
    got_names, ours = rows_of_frame(registry.QUERIES[name](spark, str(SMALL)))
    named = Counter({tuple("E00000000" if v == "POOLED" else v for v in row): n for row, n in theirs.items()})
    assert (got_names, ours) == (names, named)


def test_the_pooled_account_has_runs_and_unpaid_months(spark, tmp_path):
    payroll = spark.read.parquet(str(SMALL / "fact_payroll_monthly.parquet"))
    row = payroll.first().asDict() | {"employee_id": "E00000000", "paid_flag": False, "overtime_hours": 30.0, "overtime_pay": Decimal("10.50")}
    rows = [row | {"period": 202312, "paid_flag": True}, row | {"period": 202401}, row | {"period": 202401}, row | {"period": 202403}]
    spark.createDataFrame(rows, payroll.schema).write.parquet(str(tmp_path / "fact_payroll_monthly.parquet"))
    got = {name: sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) for name in ("w11_islands", "w12_conditional_window")}
    first = 2023 * 12 + 11
    assert got["w11_islands"] == [("E00000000", first, first + 1, 2, 31.5), ("E00000000", first + 3, first + 3, 1, 10.5)]
    assert got["w12_conditional_window"] == [("E00000000", 3)]


#: What the SQL leaves out by a condition of its own; dropped from a copy of it here.
CUTS = {
    "f10_messages": " AND net = round(net) AND period = 202401",
    "f32_maps": " AND period = 202406",
    "x14_timeline": " WHERE employee_id IN (SELECT employee_id FROM employee_features WHERE grade >= 18)",
}


@pytest.mark.parametrize("name", sorted(CUTS))
def test_the_whole_table_is_read(spark, name):
    whole = registry.SQL[name].replace(CUTS[name], "")
    assert rows_of_frame(registry.QUERIES[name](spark, str(SMALL))) == rows_of_sql(connect(SMALL), whole)


def test_manager_chains_stop_at_thirty_links(spark, tmp_path):
    held = spark.read.parquet(str(SMALL / "fact_assignment_history.parquet"))
    row = held.where("effective_from <= date'2024-01-01' and effective_to is null").first().asDict()
    above = {f"C{i:02d}": f"C{i + 1:02d}" for i in range(35)} | {"L1": "L2", "L2": "L1", "IN": "L1", "TOP": None}
    spark.createDataFrame([row | {"employee_id": e, "manager_id": m} for e, m in above.items()], held.schema).write.parquet(str(tmp_path / "fact_assignment_history.parquet"))
    got = {r["node"]: (r["depth"], r["looped"]) for r in registry.QUERIES["r01_manager_chain"](spark, str(tmp_path)).collect()}
    assert got == {f"C{i:02d}": (min(30, 35 - i), False) for i in range(35)} | {"L1": (2, True), "L2": (2, True), "IN": (30, False), "TOP": (0, False)}


def test_ml_score_is_the_mean_of_two_ranks(spark):
    a = spark.createDataFrame([("x", 0.1), ("y", 0.2), ("z", 0.3)], "k string, isolation double")
    b = spark.createDataFrame([("x", 9.0), ("y", 1.0), ("z", 5.0)], "k string, gap double")
    assert {tuple(r) for r in ml.ml_scores(a, b, "k").collect()} == {("x", 50.0), ("y", 25.0), ("z", 75.0)}
    got = registry.QUERIES["m10_ml_score"](spark, str(SMALL)).collect()
    assert len(got) == len({r["employee_id"] for r in got}) > 0 and all(0 <= r["ml_score"] <= 100 for r in got)


def test_attributions_have_a_direction(spark):
    frame = spark.createDataFrame([([4.0, 4.5, 1.5], [-2.0, 2.1, 1.2])], "g array<double>, s array<double>")
    told = frame.select(ml.attributions("g", ["a", "b", "c"], signed="s", categories=("c",)).alias("t")).first()["t"]
    assert [tuple(r) for r in told] == [("b", 0.45, "increases"), ("a", 0.4, "reduces"), ("c", 0.15, "unexpected")]
    assert '"direction":"' in registry.QUERIES["m09_reconstruction"](spark, str(SMALL)).where("gap > 0.001").first()["attributions"]
