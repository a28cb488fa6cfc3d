"""Relational operators, one query each: projections, joins, aggregations, windows, sorts, sets, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sarraf.functions import keys as K
from sarraf.functions import periods as P
from sarraf.operators import asof, distribution, rules, windows
from sarraf.plans.base import Registry
from sarraf.sources.catalog import Lake

query = Registry()


# Scans, projections and filters


@query("""SELECT employee_id, period, CAST(net AS double) AS net, CASE WHEN net < 5000 THEN 'low' WHEN net < 15000 THEN 'middle' ELSE 'high' END AS band
FROM fact_payroll_monthly WHERE period BETWEEN 202401 AND 202406 AND paid_flag AND net IS NOT NULL""")
def s05_pruned_scan(lake: Lake) -> DataFrame:
    """S-05, P-04, P-08: a month range pushed into the scan, three columns, a searched CASE."""
    rows = lake.fact_payroll_monthly.where(F.col("period").between(202401, 202406) & F.col("paid_flag") & F.col("net").isNotNull())
    band = F.when(F.col("net") < 5000, "low").when(F.col("net") < 15000, "middle").otherwise("high")
    return rows.select("employee_id", "period", F.col("net").cast("double").alias("net"), band.alias("band"))


@query("""SELECT org_unit_id, coalesce(parent_org_unit_id, 'none') AS parent, coalesce(cost_center, '?') AS cost_center, (head_employee_id IS NOT NULL)::INT AS headed FROM dim_org_unit""")
def p01_projection(lake: Lake) -> DataFrame:
    """P-01, F-01, F-03: aliases, defaults and a flag as a number."""
    return lake.dim_org_unit.select("org_unit_id", F.coalesce("parent_org_unit_id", F.lit("none")).alias("parent"), F.coalesce("cost_center", F.lit("?")).alias("cost_center"), F.col("head_employee_id").isNotNull().cast("int").alias("headed"))


@query("SELECT * EXCLUDE (hijri_year, hijri_month, is_ramadan) FROM dim_calendar")
def p02_all_but(lake: Lake) -> DataFrame:
    """P-02: all columns but some."""
    return lake.dim_calendar.drop("hijri_year", "hijri_month", "is_ramadan")


@query("""SELECT employee_id, change_reason FROM fact_bank_account WHERE effective_from >= DATE '2020-01-01' AND NOT coalesce(is_known_benign_share AND bank_code IN ('SIDR', 'NAHR'), FALSE)""")
def p06_null_safe_exclusion(lake: Lake) -> DataFrame:
    """P-06: an exclusion that is unknown excludes nothing."""
    out = F.col("is_known_benign_share") & F.col("bank_code").isin("SIDR", "NAHR")
    return lake.fact_bank_account.where((F.col("effective_from") >= "2020-01-01") & ~F.coalesce(out, F.lit(False))).select("employee_id", "change_reason")


@query("""SELECT employee_id, (national_id IS NOT DISTINCT FROM iqama_no) AS same, (passport_no IS NULL AND iqama_no IS NULL) AS bare FROM employee_master WHERE nationality_class IS DISTINCT FROM 'saudi'""")
def p10_null_safe_equality(lake: Lake) -> DataFrame:
    """P-10: equality and inequality that hold for nulls."""
    m = lake.employee_master.where(~F.col("nationality_class").eqNullSafe("saudi"))
    return m.select("employee_id", F.col("national_id").eqNullSafe(F.col("iqama_no")).alias("same"), (F.col("passport_no").isNull() & F.col("iqama_no").isNull()).alias("bare"))


@query("""SELECT employee_id, as_of_period, coalesce(grade >= 10, FALSE) AND coalesce(nationality_class IN ('saudi', 'gcc'), FALSE) AS eligible,
list_filter([CASE WHEN NOT coalesce(grade >= 10, FALSE) THEN 'grade >= 10' END, CASE WHEN NOT coalesce(nationality_class IN ('saudi', 'gcc'), FALSE) THEN 'nationality_class in [saudi, gcc]' END], lambda x: x IS NOT NULL) AS failing FROM employee_features""")
def p12_clauses(lake: Lake) -> DataFrame:
    """P-12: declared clauses compiled to columns; nulls satisfy none; what fails is told."""
    declared = ["grade >= 10", "nationality_class in [saudi, gcc]"]
    return lake.employee_features.select("employee_id", "as_of_period", rules.all_of(declared).alias("eligible"), rules.failing(declared).alias("failing"))


# Joins


@query("""SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1997-01-01'""")
def j01_inner(lake: Lake) -> DataFrame:
    """J-01, J-02: inner joins; the dimension is small by its size in the files, so Spark broadcasts it itself."""
    o = lake.orders.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    return o.join(lake.customer, F.col("o_custkey") == F.col("c_custkey")).join(lake.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("""WITH p AS (SELECT employee_id, period, sum(net) AS net FROM fact_payroll_monthly GROUP BY ALL)
SELECT a.employee_id, a.period, CAST(a.net AS double) AS net, CAST(b.net AS double) AS year_before FROM p a LEFT JOIN p b ON a.employee_id = b.employee_id AND b.period = a.period - 100""")
def j03_left_two_keys(lake: Lake) -> DataFrame:
    """J-03: a left join on employee and month; both sides share one aggregation and its partitioning."""
    p = lake.fact_payroll_monthly.groupBy("employee_id", "period").agg(F.sum("net").cast("double").alias("net"))
    before = p.select("employee_id", (F.col("period") + 100).alias("period"), F.col("net").alias("year_before"))
    return p.join(before, ["employee_id", "period"], "left")


_SPINE = """
WITH e AS (SELECT nullif(upper(trim(employee_id)), '') AS e, min(hire_date) AS hired FROM employee_master WHERE hire_date IS NOT NULL GROUP BY 1),
s AS (SELECT e, period, last_day(make_date(period // 100, period % 100, 1)) AS d FROM e CROSS JOIN dim_calendar WHERE e IS NOT NULL AND year(hired) * 100 + month(hired) <= period)"""


def _spine(lake: Lake) -> DataFrame:
    e = lake.employee_master.where("hire_date is not null").groupBy(K.norm_id("employee_id").alias("e")).agg(F.min("hire_date").alias("hired")).where("e is not null")
    months = F.broadcast(lake.dim_calendar.select("period"))  # one row per calendar month
    return e.crossJoin(months).where(F.year("hired") * 100 + F.month("hired") <= F.col("period")).select("e", "period", P.last_day("period").alias("d"))


@query(_SPINE + " SELECT period, count(*) AS employees FROM s GROUP BY period")
def j04_spine(lake: Lake) -> DataFrame:
    """J-04: employees by calendar months from their hire on, counted per month."""
    return _spine(lake).groupBy("period").agg(F.count("*").alias("employees"))


@query(_SPINE + """, h AS (SELECT upper(trim(employee_id)) AS e, effective_from AS f, max((grade, base_salary)) AS v FROM fact_assignment_history WHERE effective_from IS NOT NULL GROUP BY ALL),
r AS (SELECT s.e, s.period, h.f, h.v, row_number() OVER (PARTITION BY s.e, s.period ORDER BY h.f DESC NULLS LAST) AS n FROM s LEFT JOIN h ON h.e = s.e AND h.f <= s.d)
SELECT e AS employee_id, period, f AS effective_from FROM r WHERE n = 1""")
def j05_asof(lake: Lake) -> DataFrame:
    """J-05, FB-0: the last assignment row not after each month's end."""
    h = lake.fact_assignment_history.where("effective_from is not null").select(K.norm_id("employee_id").alias("e"), "effective_from")
    return asof.asof_join(_spine(lake), h, "e", "d", "effective_from", ["effective_from"]).select(F.col("e").alias("employee_id"), "period", "effective_from")


@query("""WITH t AS (SELECT DISTINCT org_unit_id AS k, head_employee_id AS h, cost_center AS c FROM dim_org_unit WHERE head_employee_id IS NOT NULL)
SELECT a.k AS a, b.k AS b, a.h AS head FROM t a JOIN t b ON a.h = b.h AND a.k < b.k""")
def j06_pairs(lake: Lake) -> DataFrame:
    """J-06: pairs of units with one head, on a fixed dimension."""
    t = lake.dim_org_unit.where("head_employee_id is not null").select("org_unit_id", F.col("head_employee_id").alias("head")).distinct()
    return t.withColumnRenamed("org_unit_id", "a").join(t.withColumnRenamed("org_unit_id", "b"), "head").where("a < b").select("a", "b", "head")


@query("""WITH h AS (SELECT DISTINCT upper(trim(employee_id)) AS e, effective_from AS f, lower(trim(change_reason)) AS r FROM fact_assignment_history WHERE effective_from IS NOT NULL)
SELECT a.e AS employee_id, a.f AS transferred, count(*) AS increments FROM h a JOIN h b ON a.e = b.e AND (year(b.f) * 12 + month(b.f)) - (year(a.f) * 12 + month(a.f)) BETWEEN 1 AND 6
WHERE a.r = 'transfer' AND b.r = 'increment' GROUP BY ALL""")
def j07_band_join(lake: Lake) -> DataFrame:
    """J-07, J-08, F-22: rows of one employee 1 to 6 month boundaries after another, an equi-join with a residual."""
    h = lake.fact_assignment_history.where("effective_from is not null").select(K.norm_id("employee_id").alias("employee_id"), F.col("effective_from").alias("f"), K.norm_word("change_reason").alias("r")).distinct()
    a = h.where("r = 'transfer'").select("employee_id", F.col("f").alias("transferred"))
    b = h.where("r = 'increment'").select("employee_id", F.col("f").alias("raised"))
    return a.join(b, "employee_id").where(P.month_boundaries("transferred", "raised").between(1, 6)).groupBy("employee_id", "transferred").agg(F.count("*").alias("increments"))


@query("""WITH j AS (SELECT upper(trim(employee_id)) AS e, year(effective_from) * 12 + month(effective_from) - 1 AS m FROM fact_assignment_history WHERE effective_from IS NOT NULL GROUP BY ALL),
b AS (SELECT upper(trim(employee_id)) AS e, year(effective_from) * 12 + month(effective_from) - 1 AS m FROM fact_bank_account WHERE effective_from IS NOT NULL GROUP BY ALL)
SELECT DISTINCT b.e AS employee_id, b.m AS month FROM b JOIN j ON j.e = b.e AND abs(j.m - b.m) <= 1""")
def j09_theta_to_equi(lake: Lake) -> DataFrame:
    """J-09, U-06: a theta condition turned into equality by expanding one side by a month each way."""
    m = lambda t: t.where("effective_from is not null").select(K.norm_id("employee_id").alias("employee_id"), P.index_of_date("effective_from").alias("month")).distinct()
    around = m(lake.fact_assignment_history).select("employee_id", F.explode(F.sequence(F.col("month") - 1, F.col("month") + 1)).alias("month")).distinct()
    return m(lake.fact_bank_account).join(around, ["employee_id", "month"], "left_semi")


@query("""SELECT DISTINCT upper(trim(employee_id)) AS employee_id FROM fact_bank_account b WHERE NOT EXISTS (SELECT 1 FROM employee_master m WHERE upper(trim(m.employee_id)) = upper(trim(b.employee_id)))""")
def j10_anti(lake: Lake) -> DataFrame:
    """J-10, J-18: accounts of ids the master does not have."""
    ids = lake.employee_master.select(K.norm_id("employee_id").alias("employee_id"))
    return lake.fact_bank_account.select(K.norm_id("employee_id").alias("employee_id")).where("employee_id is not null").distinct().join(ids, "employee_id", "left_anti")


@query("""SELECT DISTINCT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def j11_semi(lake: Lake) -> DataFrame:
    """J-11, P-09: customers with a large order."""
    return lake.customer.join(lake.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""SELECT period, round(net / (SELECT sum(CAST(net AS double)) FROM fact_payroll_monthly), 9) AS share FROM (SELECT period, sum(CAST(net AS double)) AS net FROM fact_payroll_monthly GROUP BY period)""")
def j12_scalar(lake: Lake) -> DataFrame:
    """J-12, A-23: each month's share of a global sum, from one aggregation per month."""
    months = lake.fact_payroll_monthly.groupBy("period").agg(F.sum(F.col("net").cast("double")).alias("net"))
    whole = months.agg(F.sum("net").alias("whole"))
    return months.crossJoin(F.broadcast(whole)).select("period", F.round(F.col("net") / F.col("whole"), 9).alias("share"))


@query("""WITH v AS (SELECT upper(trim(employee_id)) AS e, effective_from AS f, least(coalesce(effective_to, DATE '2025-12-31'), DATE '2025-12-31') AS t FROM fact_bank_account WHERE effective_from BETWEEN DATE '2024-01-01' AND DATE '2025-12-31')
SELECT m AS month, count(*) AS accounts FROM (SELECT e, f, t, unnest(generate_series(year(f) * 12 + month(f) - 1, year(t) * 12 + month(t) - 1)) AS m FROM v WHERE t >= f) GROUP BY m""")
def j13_series(lake: Lake) -> DataFrame:
    """J-13, U-06, G-01: intervals expanded to the months they touch."""
    end = F.to_date(F.lit("2025-12-31"))
    v = lake.fact_bank_account.where(F.col("effective_from").between("2024-01-01", "2025-12-31")).withColumn("t", F.least(F.coalesce("effective_to", end), end)).where("t >= effective_from")
    return v.select(F.explode(F.sequence(P.index_of_date("effective_from"), P.index_of_date("t"))).alias("month")).groupBy("month").agg(F.count("*").alias("accounts"))


@query("""WITH i AS (SELECT employee_id, 'passport' AS kind, passport_no AS v FROM employee_master WHERE passport_no IS NOT NULL UNION ALL SELECT employee_id, 'iqama', iqama_no FROM employee_master WHERE iqama_no IS NOT NULL)
SELECT kind, v AS value, count(DISTINCT employee_id) AS holders FROM i GROUP BY ALL HAVING count(DISTINCT employee_id) > 1""")
def j14_or_as_union(lake: Lake) -> DataFrame:
    """J-14, R-07, A-04: `same passport or same iqama` as two equalities, never a join with OR."""
    kinds = F.array(F.struct(F.lit("passport").alias("kind"), F.col("passport_no").alias("value")), F.struct(F.lit("iqama").alias("kind"), F.col("iqama_no").alias("value")))
    ids = lake.employee_master.select("employee_id", F.inline(kinds)).where("value is not null")
    return ids.groupBy("kind", "value").agg(F.count_distinct("employee_id").alias("holders")).where("holders > 1")


# Aggregations


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def a01_group_by(lake: Lake) -> DataFrame:
    """A-01, O-01: the usual aggregates over a large fact."""
    li = lake.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"))


@query("""SELECT period, count(*) FILTER (WHERE NOT paid_flag) AS unpaid, count(*) FILTER (WHERE net IS NULL) AS without_net, coalesce(bool_or(overtime_hours > 60 AND NOT isnan(overtime_hours)), FALSE) AS long_hours FROM fact_payroll_monthly GROUP BY period""")
def a02_conditional(lake: Lake) -> DataFrame:
    """A-02, A-12: aggregates over parts of a group."""
    hours = (F.col("overtime_hours") > 60) & ~F.isnan("overtime_hours")
    return lake.fact_payroll_monthly.groupBy("period").agg(F.count_if(~F.col("paid_flag")).alias("unpaid"), F.count_if(F.col("net").isNull()).alias("without_net"), F.coalesce(F.bool_or(hours), F.lit(False)).alias("long_hours"))


@query("""SELECT event_type, round(sum(value) FILTER (WHERE user_id % 3 = 0), 2) AS s0, round(sum(value) FILTER (WHERE user_id % 3 = 1), 2) AS s1, round(sum(value) FILTER (WHERE user_id % 3 = 2), 2) AS s2 FROM events GROUP BY event_type""")
def a03_pivot(lake: Lake) -> DataFrame:
    """A-03, U-05: long to wide over known values, one pass."""
    e = lake.events.select("event_type", (F.col("user_id") % 3).alias("part"), "value")
    return e.groupBy("event_type").pivot("part", [0, 1, 2]).agg(F.round(F.sum("value"), 2)).withColumnsRenamed({"0": "s0", "1": "s1", "2": "s2"})


@query("""SELECT employee_id, count(*) AS n, round(stddev_samp(CAST(net AS double)), 4) AS spread, round(regr_slope(CAST(net AS double), period // 100 * 12 + period % 100), 4) AS slope FROM fact_payroll_monthly WHERE net IS NOT NULL GROUP BY employee_id HAVING count(*) > 2""")
def a05_spread_and_slope(lake: Lake) -> DataFrame:
    """A-05, A-06, A-17: sample deviation and slope per employee."""
    p = lake.fact_payroll_monthly.where("net is not null").select("employee_id", F.col("net").cast("double").alias("net"), P.month_index("period").alias("m"))
    return p.groupBy("employee_id").agg(F.count("*").alias("n"), F.round(F.stddev_samp("net"), 4).alias("spread"), F.round(F.regr_slope("net", "m"), 4).alias("slope")).where("n > 2")


@query("""SELECT nationality_class, grade, quantile_cont(CAST(base_salary AS double), 0.5) AS median, round(quantile_cont(CAST(base_salary AS double), 0.01), 4) AS p01, round(quantile_cont(CAST(base_salary AS double), 0.99), 4) AS p99 FROM employee_features WHERE base_salary IS NOT NULL GROUP BY ALL""")
def a07_exact_percentiles(lake: Lake) -> DataFrame:
    """A-07, A-09: exact median and interpolated percentiles of groups of any size."""
    found = distribution.percentiles(lake.employee_features, ["nationality_class", "grade"], "base_salary", {"median": 0.5, "p01": 0.01, "p99": 0.99})
    return found.select("nationality_class", "grade", "median", F.round("p01", 4).alias("p01"), F.round("p99", 4).alias("p99"))


@query("""SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, max(value) AS most FROM events GROUP BY user_id""")
def a10_arg_min_max(lake: Lake) -> DataFrame:
    """A-10, A-11: the value at the least and the greatest key."""
    return lake.events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"), F.max("value").alias("most"))


@query("""SELECT parent_org_unit_id AS parent, list(org_unit_id ORDER BY org_unit_id) AS units, string_agg(DISTINCT cost_center, ',' ORDER BY cost_center) AS centres, to_json(list(struct_pack(id := org_unit_id, head := head_employee_id) ORDER BY org_unit_id))::VARCHAR AS detail FROM dim_org_unit WHERE parent_org_unit_id IS NOT NULL AND head_employee_id IS NOT NULL GROUP BY ALL""")
def a13_lists(lake: Lake) -> DataFrame:
    """A-13 to A-16, F-31, F-33: ordered lists, joined strings, JSON of structs, on a fixed dimension."""
    d = lake.dim_org_unit.where("parent_org_unit_id is not null and head_employee_id is not null").groupBy(F.col("parent_org_unit_id").alias("parent"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col("org_unit_id").alias("id"), F.col("head_employee_id").alias("head"))))
    return d.agg(F.sort_array(F.collect_list("org_unit_id")).alias("units"), F.array_join(F.sort_array(F.collect_set("cost_center")), ",").alias("centres"), F.to_json(pairs).alias("detail"))


@query("""WITH c AS (SELECT region_code, nationality_class, count(*) AS n FROM employee_features GROUP BY ALL)
SELECT region_code, nationality_class, n FROM c UNION ALL SELECT region_code, '*', sum(n)::BIGINT FROM c GROUP BY ALL UNION ALL SELECT '*', '*', sum(n)::BIGINT FROM c""")
def a19_totals(lake: Lake) -> DataFrame:
    """A-19, A-21, G-02, U-01: totals rows from a second aggregation of the first."""
    c = lake.employee_features.groupBy("region_code", "nationality_class").agg(F.count("*").alias("n"))
    by_region = c.groupBy("region_code").agg(F.sum("n").alias("n")).withColumn("nationality_class", F.lit("*"))
    whole = by_region.agg(F.sum("n").alias("n")).withColumns({"region_code": F.lit("*"), "nationality_class": F.lit("*")})
    return c.unionByName(by_region).unionByName(whole)


@query("""SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS int) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def a21_cube(lake: Lake) -> DataFrame:
    """A-21: all groupings of two columns in one pass."""
    return lake.orders.cube("o_orderpriority", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))


# Windows


@query("""SELECT employee_id, period, net, round(CAST(net - lag(net) OVER w AS double), 2) AS change, lead(period) OVER w AS next_period FROM (SELECT employee_id, period, sum(net) AS net FROM fact_payroll_monthly GROUP BY ALL) WINDOW w AS (PARTITION BY employee_id ORDER BY period)""")
def w03_lag_lead(lake: Lake) -> DataFrame:
    """W-03, W-04, W-13: month over month by one named window."""
    p = lake.fact_payroll_monthly.groupBy("employee_id", "period").agg(F.sum("net").alias("net"))
    w = Window.partitionBy("employee_id").orderBy("period")
    return p.select("employee_id", "period", F.col("net").cast("decimal(38,2)").alias("net"), F.round((F.col("net") - F.lag("net").over(w)).cast("double"), 2).alias("change"), F.lead("period").over(w).alias("next_period"))


@query("""SELECT employee_id, effective_from, grade FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY effective_from DESC NULLS LAST, effective_to DESC NULLS LAST, grade DESC, org_unit_id DESC NULLS LAST) AS n FROM fact_assignment_history) WHERE n = 1""")
def w02_latest_row(lake: Lake) -> DataFrame:
    """W-02: the latest row of each employee."""
    return windows.latest_row(lake.fact_assignment_history, ["employee_id"], ["effective_from", "effective_to", "grade", "org_unit_id"]).select("employee_id", "effective_from", "grade")


@query("""WITH j AS (SELECT upper(trim(employee_id)) AS e, year(effective_from) * 12 + month(effective_from) AS m, min(grade) AS g, count(*) AS n FROM fact_assignment_history WHERE effective_from IS NOT NULL GROUP BY ALL)
SELECT e AS employee_id, m AS month, CAST(sum(n) OVER (PARTITION BY e ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS bigint) AS moves, min(g) OVER (PARTITION BY e ORDER BY m RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS lowest FROM j""")
def w06_range_frames(lake: Lake) -> DataFrame:
    """W-06, W-07: counts and minima over month ranges."""
    j = lake.fact_assignment_history.where("effective_from is not null").groupBy(K.norm_id("employee_id").alias("employee_id"), (P.index_of_date("effective_from") + 1).alias("month")).agg(F.min("grade").alias("g"), F.count("*").alias("n"))
    w = Window.partitionBy("employee_id").orderBy("month")
    return j.select("employee_id", "month", F.sum("n").over(w.rangeBetween(-11, 0)).alias("moves"), F.min("g").over(w.rangeBetween(-23, 0)).alias("lowest"))


@query("""WITH p AS (SELECT employee_id AS e, period AS p, sum(CAST(overtime_pay AS double)) AS v FROM fact_payroll_monthly GROUP BY ALL), m AS (SELECT e, median(v) AS m FROM p GROUP BY e)
SELECT p.e AS employee_id, p.p AS period, round(sum(v - m) OVER (PARTITION BY p.e ORDER BY p.p ROWS UNBOUNDED PRECEDING), 3) AS cusum FROM p JOIN m USING (e)""")
def w08_cusum(lake: Lake) -> DataFrame:
    """W-08, A-08: running sums of deviations from the median."""
    p = lake.fact_payroll_monthly.groupBy("employee_id", "period").agg(F.sum(F.col("overtime_pay").cast("double")).alias("v"))
    m = p.groupBy("employee_id").agg(F.median("v").alias("m"))
    return p.join(m, "employee_id").select("employee_id", "period", F.round(windows.running_sum(F.col("v") - F.col("m"), ["employee_id"], "period"), 3).alias("cusum"))


@query("""SELECT s_suppkey, s_nationkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) * 100, 6) AS pct, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) * 100, 6) AS cume, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS place, count(*) OVER (PARTITION BY s_nationkey) AS peers FROM supplier""")
def w09_ranks(lake: Lake) -> DataFrame:
    """W-05, W-09, W-14 to W-16, A-22: relative ranks in a group."""
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal")
    ranked = distribution.with_cumulative_rank(lake.supplier, "s_acctbal", "s_nationkey", "cume")
    return ranked.select("s_suppkey", "s_nationkey", F.round(F.percent_rank().over(w) * 100, 6).alias("pct"), F.round("cume", 6).alias("cume"), F.dense_rank().over(w).cast("long").alias("place"), F.count("*").over(Window.partitionBy("s_nationkey")).alias("peers"))


@query("""WITH m AS (SELECT employee_id AS e, period // 100 * 12 + period % 100 - 1 AS i, sum(CAST(overtime_pay AS double)) AS v FROM fact_payroll_monthly WHERE overtime_hours > 20 AND NOT isnan(overtime_hours) GROUP BY ALL), g AS (SELECT *, i - row_number() OVER (PARTITION BY e ORDER BY i) AS k FROM m)
SELECT e AS employee_id, CAST(min(i) AS int) AS first_step, CAST(max(i) AS int) AS last_step, count(*) AS steps, round(sum(v), 2) AS v FROM g GROUP BY e, k""")
def w11_islands(lake: Lake) -> DataFrame:
    """W-11, J-15, ST-05: runs of consecutive months with long overtime."""
    p = lake.fact_payroll_monthly.where("overtime_hours > 20 and not isnan(overtime_hours)")
    m = p.groupBy("employee_id", P.month_index("period").alias("i")).agg(F.sum(F.col("overtime_pay").cast("double")).alias("v"))
    return windows.collapse_runs(m, ["employee_id"], "i", ["v"]).withColumn("v", F.round("v", 2))


@query("""WITH p AS (SELECT employee_id AS e, period, max(CASE WHEN paid_flag THEN period END) OVER (PARTITION BY employee_id) AS last_paid FROM fact_payroll_monthly) SELECT e AS employee_id, count(*) AS after_last_paid FROM p WHERE period > last_paid GROUP BY e""")
def w12_conditional_window(lake: Lake) -> DataFrame:
    """W-12: a conditional maximum over the group, then a filter on it; over months of employees, so a hot group is pre-aggregated."""
    months = lake.fact_payroll_monthly.groupBy("employee_id", "period").agg(F.count("*").alias("n"), F.max(F.when(F.col("paid_flag"), F.col("period"))).alias("paid"))
    known = months.withColumn("last_paid", F.max("paid").over(Window.partitionBy("employee_id")))
    return known.where("period > last_paid").groupBy("employee_id").agg(F.sum("n").alias("after_last_paid"))


# Sorts, limits, top k


@query("""SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS int) AS rank FROM part) WHERE rank <= 6""")
def o06_top_per_group(lake: Lake) -> DataFrame:
    """O-03, O-06: the six dearest parts of each brand."""
    return windows.top_k(lake.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 6)


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def o08_top_n(lake: Lake) -> DataFrame:
    """O-08, A-24: the hundred largest orders, each task keeping its own hundred."""
    return lake.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
SELECT o_orderkey, place, CASE WHEN place <= 50 AND o_totalprice >= 200000 THEN 'CRITICAL' WHEN place <= 250 AND o_totalprice >= 100000 THEN 'HIGH' ELSE 'LOW' END AS band FROM r""")
def x10_capacity_bands(lake: Lake) -> DataFrame:
    """X-10, O-04, O-05, M-04: a queue numbered without one task sorting it, cut into bands of limited size."""
    bands = [("CRITICAL", 50, 200000.0), ("HIGH", 200, 100000.0)]
    return windows.capacity_bands(lake.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "o_totalprice", bands, "LOW").select("o_orderkey", "place", "band")


# Set operations and reshaping


@query("""SELECT employee_id FROM fact_bank_account UNION SELECT employee_id FROM graph_components""")
def u02_union(lake: Lake) -> DataFrame:
    """U-02, A-18: a distinct union."""
    return lake.fact_bank_account.select("employee_id").union(lake.graph_components.select("employee_id")).distinct()


@query("""SELECT 'assignment' AS src, employee_id, effective_from, grade, NULL AS iban FROM fact_assignment_history UNION ALL SELECT 'bank', employee_id, effective_from, NULL, iban FROM fact_bank_account""")
def u03_union_by_name(lake: Lake) -> DataFrame:
    """U-03: a union by name, missing columns null."""
    a = lake.fact_assignment_history.select(F.lit("assignment").alias("src"), "employee_id", "effective_from", "grade")
    return a.unionByName(lake.fact_bank_account.select(F.lit("bank").alias("src"), "employee_id", "effective_from", "iban"), allowMissingColumns=True)


@query("""SELECT employee_id, as_of_period, metric, v AS value FROM (SELECT employee_id, as_of_period, CAST(base_salary AS double) AS base_salary, CAST(allowance_total_monthly AS double) AS allowance_total_monthly FROM employee_features) UNPIVOT (v FOR metric IN (base_salary, allowance_total_monthly))""")
def u04_unpivot(lake: Lake) -> DataFrame:
    """U-04: wide to long without nulls."""
    f = lake.employee_features.select("employee_id", "as_of_period", F.col("base_salary").cast("double"), F.col("allowance_total_monthly").cast("double"))
    return f.unpivot(["employee_id", "as_of_period"], ["base_salary", "allowance_total_monthly"], "metric", "value").where("value is not null")


@query("""(SELECT upper(trim(employee_id)) AS employee_id FROM employee_master EXCEPT SELECT upper(trim(employee_id)) FROM fact_assignment_history) UNION ALL (SELECT 'both:' || count(*) FROM (SELECT upper(trim(employee_id)) FROM employee_master INTERSECT SELECT upper(trim(employee_id)) FROM fact_assignment_history))""")
def u07_difference(lake: Lake) -> DataFrame:
    """U-07: set difference and intersection."""
    m, h = (t.select(K.norm_id("employee_id").alias("employee_id")) for t in (lake.employee_master, lake.fact_assignment_history))
    both = m.intersect(h).agg(F.concat(F.lit("both:"), F.count("*").cast("string")).alias("employee_id"))
    return m.subtract(h).unionByName(both)


# Scalar functions


@query("""SELECT period, last_day(make_date(period // 100, period % 100, 1)) AS last_day, CAST(CASE WHEN period % 100 > 9 THEN period + 91 ELSE period + 3 END AS int) AS in_3, strftime(make_date(period // 100, period % 100, 1), '%B %Y') AS label, CAST((period // 100 - 2020) * 12 + period % 100 - 1 AS int) AS since FROM dim_calendar""")
def f20_periods(lake: Lake) -> DataFrame:
    """F-09, F-20 to F-24: arithmetic of months written YYYYMM."""
    return lake.dim_calendar.select("period", P.last_day("period").alias("last_day"), P.period_add("period", 3).alias("in_3"), P.month_label("period").alias("label"), P.period_diff("period", F.lit(202001)).alias("since"))


@query("""SELECT n_nationkey, upper(n_name) || '-' || coalesce(CAST(n_regionkey AS varchar), '') AS name, concat_ws('/', n_name, NULL, CAST(n_regionkey AS varchar)) AS path, replace(n_name, 'A', 'a') AS replaced, right(n_name, 3) AS tail, levenshtein(n_name, 'GERMANY') AS edits, greatest(n_nationkey, 10) AS most, least(n_nationkey, NULL, 5) AS least_of, round(n_nationkey / 7, 2) AS r FROM nation""")
def f02_scalars(lake: Lake) -> DataFrame:
    """F-02, F-04, F-06, F-08: text and number functions."""
    n = F.col("n_name")
    key = F.col("n_nationkey")
    return lake.nation.select("n_nationkey", F.concat(F.upper(n), F.lit("-"), F.coalesce(F.col("n_regionkey").cast("string"), F.lit(""))).alias("name"), F.concat_ws("/", n, F.lit(None), F.col("n_regionkey").cast("string")).alias("path"), F.replace(n, F.lit("A"), F.lit("a")).alias("replaced"), F.right(n, F.lit(3)).alias("tail"), F.levenshtein(n, F.lit("GERMANY")).cast("long").alias("edits"), F.greatest(key, F.lit(10)).alias("most"), F.least(key, F.lit(None).cast("int"), F.lit(5)).alias("least_of"), F.round(key / 7, 2).alias("r"))


@query("""SELECT employee_id, len(certifications) AS n, len(list_filter(certifications, lambda c: c.expiry < DATE '2025-01-01')) AS expired, list_sort(languages)[1:2] AS languages FROM employee_master""")
def f30_arrays(lake: Lake) -> DataFrame:
    """F-30, F-31: array length, filter, order and slice, without a Python function."""
    c = F.col("certifications")
    expired = F.size(F.filter(c, lambda x: x["expiry"] < F.to_date(F.lit("2025-01-01"))))
    return lake.employee_master.select("employee_id", F.size(c).cast("long").alias("n"), expired.cast("long").alias("expired"), F.slice(F.array_sort("languages"), 1, 2).alias("languages"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS int) AS k, sha256(event_type || ':' || CAST(user_id AS varchar)) AS fingerprint FROM events""")
def f33_json_hash(lake: Lake) -> DataFrame:
    """F-33, F-34, X-08: a value out of JSON text, a SHA-256 fingerprint."""
    return lake.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.sha2(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")), 256).alias("fingerprint"))


@query("""WITH b AS (SELECT DISTINCT regexp_replace(upper(iban), '[\\s-]+', '', 'g') AS k FROM fact_bank_account WHERE iban IS NOT NULL)
SELECT k AS iban, CASE WHEN regexp_full_match(k, '[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}') THEN list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(substr(k, 5) || substr(k, 1, 4), ''), lambda c: CASE WHEN ascii(c) < 58 THEN c ELSE CAST(ascii(c) - 55 AS varchar) END), ''), ''), lambda c: CAST(c AS int))), lambda r, c: (r * 10 + c) % 97) = 1 ELSE FALSE END AS valid FROM b""")
def f36_check_digits(lake: Lake) -> DataFrame:
    """F-36, UDF-03: IBAN check digits as one expression."""
    return lake.fact_bank_account.select(K.bare_code("iban").alias("iban")).where("iban is not null").distinct().select("iban", K.iban_ok("iban").alias("valid"))


@query("""WITH b AS (SELECT grade, min(CAST(base_salary AS double)) AS lo, max(CAST(base_salary AS double)) AS hi FROM employee_features GROUP BY grade)
SELECT employee_id, round(CASE WHEN hi > lo THEN (CAST(base_salary AS double) - lo) / (hi - lo) END, 8) AS position FROM employee_features JOIN b USING (grade)""")
def f41_band_position(lake: Lake) -> DataFrame:
    """F-41: the place of a value between the bounds of its group, null where the bounds are one."""
    v = F.col("base_salary").cast("double")
    b = lake.employee_features.groupBy("grade").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return lake.employee_features.join(b, "grade").select("employee_id", F.round(place, 8).alias("position"))


@query("""SELECT period, CAST(substr(payroll_run_id, 2, 6) AS int) AS run_period, count(*) AS n FROM fact_payroll_monthly WHERE regexp_matches(payroll_run_id, '^[A-Z][0-9]{6}-') AND CAST(substr(payroll_run_id, 2, 6) AS int) > period GROUP BY ALL""")
def st04_late_rows(lake: Lake) -> DataFrame:
    """ST-04: rows posted by the run of a later month."""
    p = lake.fact_payroll_monthly.where(F.col("payroll_run_id").rlike("^[A-Z][0-9]{6}-"))
    run = F.substring("payroll_run_id", 2, 6).cast("int")
    return p.withColumn("run_period", run).where("run_period > period").groupBy("period", "run_period").agg(F.count("*").alias("n"))


@query("""SELECT employee_id, period, map_extract(MAP {'loan': CAST(loan_deduction AS double), 'absence': CAST(absence_deduction AS double)}, 'loan')[1] AS loan FROM fact_payroll_monthly WHERE loan_deduction > 0""")
def f32_maps(lake: Lake) -> DataFrame:
    """F-32: a map built and read by key."""
    p = lake.fact_payroll_monthly.where("loan_deduction > 0")
    parts = F.create_map(F.lit("loan"), F.col("loan_deduction").cast("double"), F.lit("absence"), F.col("absence_deduction").cast("double"))
    return p.select("employee_id", "period", parts["loan"].alias("loan"))
