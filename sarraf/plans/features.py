"""Feature blocks over the lake, one query each: what later layers read, one row a month or an employee.

Amounts and conditions are those of the data; no policy decides anything here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sarraf.functions import keys as K
from sarraf.functions import periods as P
from sarraf.functions.amounts import expected_amount
from sarraf.operators import asof, cohorts, graphs, hierarchy, windows
from sarraf.plans import problems
from sarraf.plans.base import Registry
from sarraf.session import cut
from sarraf.sources.catalog import Lake

query = Registry()

_ID = problems._ID.format
_LATEST = ("record_updated_at", "hire_date", "grade", "org_unit_id", "dob", "termination_date")
_MASTER = f"""
m AS (SELECT * FROM (SELECT {_ID('employee_id')} AS e, {', '.join(_LATEST)}, row_number() OVER (PARTITION BY {_ID('employee_id')} ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in _LATEST)}) AS n FROM employee_master WHERE {_ID('employee_id')} IS NOT NULL) WHERE n = 1),
hi AS (SELECT {_ID('employee_id')} AS e, min(hire_date) AS hired FROM employee_master WHERE {_ID('employee_id')} IS NOT NULL AND hire_date IS NOT NULL GROUP BY 1)"""
_HISTORY = f"""
h AS (SELECT * FROM (SELECT e, f, grade, org, manager, row_number() OVER (PARTITION BY e, f ORDER BY grade DESC NULLS LAST, org DESC NULLS LAST, manager DESC NULLS LAST) AS n
  FROM (SELECT {_ID('employee_id')} AS e, effective_from AS f, grade, org_unit_id AS org, {_ID('manager_id')} AS manager FROM fact_assignment_history) WHERE e IS NOT NULL AND f IS NOT NULL) WHERE n = 1)"""
_ASAT = f"""{_MASTER},{_HISTORY},
cal AS (SELECT period, last_day(make_date(period // 100, period % 100, 1)) AS d, working_days, row_number() OVER (ORDER BY period) AS i FROM dim_calendar),
sp AS (SELECT m.e, cal.*, hi.hired, m.grade AS g0, m.org_unit_id AS o0, m.dob, m.termination_date AS left_on FROM m JOIN hi ON hi.e = m.e CROSS JOIN cal WHERE year(hired) * 100 + month(hired) <= period),
ka AS (SELECT sp.*, h.f, h.grade, h.org, h.manager, row_number() OVER (PARTITION BY sp.e, sp.period ORDER BY h.f DESC NULLS LAST) AS k FROM sp LEFT JOIN h ON h.e = sp.e AND h.f <= sp.d),
asat AS (SELECT e, period, d, i, working_days, hired, dob, left_on, f IS NOT NULL AS from_history, CASE WHEN f IS NOT NULL THEN grade ELSE g0 END AS grade, CASE WHEN f IS NOT NULL THEN org ELSE o0 END AS org, manager FROM ka WHERE k = 1)"""
_MONTHS = f"""
pm AS (SELECT employee_id AS e, period, CAST(sum(base_pay) AS double) AS base, CAST(sum(allowance_total) AS double) AS allowance, CAST(sum(overtime_pay) AS double) AS overtime, CAST(sum(bonus) AS double) AS bonus, CAST(sum(retro_adjustment) AS double) AS retro, CAST(sum(net) AS double) AS net,
  sum(CASE WHEN NOT isnan(overtime_hours) THEN overtime_hours END) AS hours, bool_or(paid_flag) AS paid FROM (SELECT DISTINCT * REPLACE ({_ID('employee_id')} AS employee_id) FROM fact_payroll_monthly) WHERE employee_id IS NOT NULL GROUP BY ALL)"""


def _history(lake: Lake) -> DataFrame:
    """One assignment row an employee and day, the greatest of several."""
    h = lake.fact_assignment_history.select(K.norm_id("employee_id").alias("e"), F.col("effective_from").alias("f"), "grade", F.col("org_unit_id").alias("org"), K.norm_id("manager_id").alias("manager"))
    return windows.latest_row(h.where("e is not null and f is not null"), ["e", "f"], ["grade", "org", "manager"])


def as_at(lake: Lake) -> DataFrame:
    """Employees by calendar months from their hire on, with the assignment at each month's end, or else the master's state."""
    m = lake.employee_master.withColumn("e", K.norm_id("employee_id")).where("e is not null")
    first = m.groupBy("e").agg(F.min("hire_date").alias("hired")).where("hired is not null")
    people = windows.latest_row(m.select("e", *_LATEST), ["e"], list(_LATEST)).join(first, "e")
    months = lake.dim_calendar.select("period", P.last_day("period").alias("d"), "working_days", F.row_number().over(Window.orderBy("period")).alias("i"))  # one row a calendar month
    spine = people.crossJoin(F.broadcast(months)).where(F.year("hired") * 100 + F.month("hired") <= F.col("period"))
    spine = spine.select("e", "period", "d", "i", "working_days", "hired", F.col("grade").alias("g0"), F.col("org_unit_id").alias("o0"), "dob", F.col("termination_date").alias("left_on"))
    known = asof.asof_join(spine, _history(lake), "e", "d", "f", ["f", "grade", "org", "manager"])
    there = F.col("f").isNotNull()
    return known.select("e", "period", "d", "i", "working_days", "hired", "dob", "left_on", there.alias("from_history"), F.when(there, F.col("grade")).otherwise(F.col("g0")).alias("grade"), F.when(there, F.col("org")).otherwise(F.col("o0")).alias("org"), "manager")


def pay_months(lake: Lake) -> DataFrame:
    """One row an employee and month: exact repeats count once, supplements add up."""
    once = lake.fact_payroll_monthly.withColumn("employee_id", K.norm_id("employee_id")).where("employee_id is not null").distinct()
    money = {"base": "base_pay", "allowance": "allowance_total", "overtime": "overtime_pay", "bonus": "bonus", "retro": "retro_adjustment", "net": "net"}
    hours = F.sum(F.when(~F.isnan("overtime_hours"), F.col("overtime_hours"))).alias("hours")
    return once.groupBy(F.col("employee_id").alias("e"), "period").agg(*[F.sum(c).cast("double").alias(n) for n, c in money.items()], hours, F.bool_or("paid_flag").alias("paid"))


@query(f"""WITH {_ASAT} SELECT e AS employee_id, asat.period, CAST(i AS int) AS period_index, from_history, grade, org AS org_unit_id, manager AS manager_id, o.primary_site_id AS site_id FROM asat LEFT JOIN dim_org_unit o ON o.org_unit_id = asat.org""")
def fb0_as_at(lake: Lake) -> DataFrame:
    """FB-0, J-02, J-05: the state of each employee at each month's end, the master's where there is no history, with the unit's site."""
    units = lake.dim_org_unit.select(F.col("org_unit_id").alias("org"), F.col("primary_site_id").alias("site_id"))
    return as_at(lake).join(units, "org", "left").select(F.col("e").alias("employee_id"), "period", F.col("i").alias("period_index"), "from_history", "grade", F.col("org").alias("org_unit_id"), F.col("manager").alias("manager_id"), "site_id")


@query(f"""WITH {_MONTHS}, x AS (SELECT *, CASE WHEN base IS NOT NULL THEN least(CAST(round(CAST(base AS decimal(14,2)) * 0.25, 2) AS decimal(14,2)), 6000) END AS want FROM pm)
SELECT e AS employee_id, period, overtime AS overtime_amount, bonus AS bonus_amount, allowance AS allowance_amount, (coalesce(overtime, 0) > 0)::INT + (coalesce(bonus, 0) > 0)::INT + (coalesce(allowance, 0) > 0)::INT AS positive_codes,
CAST(want AS double) AS expected_allowance, coalesce(want > 0 AND abs(allowance - CAST(want AS double)) > 1.00, FALSE) AS off_expected FROM x""")
def fb1_amounts(lake: Lake) -> DataFrame:
    """FB-1, F-38: amounts by code side by side, one code left out of the count, against a declared expected amount."""
    months = cut(pay_months(lake))
    codes = ["overtime", "bonus", "retro", "allowance"]
    long = months.select("e", "period", F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("amount")) for c in codes])))
    counted = (F.col("amount") > 0) & (F.col("code") != "retro")
    wide = long.groupBy("e", "period").agg(*[F.max(F.when(F.col("code") == c, F.col("amount"))).alias(f"{c}_amount") for c in ("overtime", "bonus", "allowance")], F.count_if(counted).cast("int").alias("positive_codes"))
    want = months.select("e", "period", expected_amount("share_of_base", share="0.25", base=F.col("base"), most=6000).cast("double").alias("expected_allowance"))
    off = (F.col("expected_allowance") > 0) & (F.abs(F.col("allowance_amount") - F.col("expected_allowance")) > 1.00)
    return wide.join(want, ["e", "period"]).withColumn("off_expected", F.coalesce(off, F.lit(False))).withColumnRenamed("e", "employee_id")


@query(f"""WITH {_HISTORY}, l AS (SELECT e, f, org, lag(org) OVER (PARTITION BY e ORDER BY f) AS before FROM h), c AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY f DESC) AS n2 FROM l WHERE before IS NOT NULL AND org IS NOT NULL AND before <> org)
SELECT e AS employee_id, before AS previous_org, f AS moved_on FROM c WHERE n2 = 1""")
def fb2a_previous_value(lake: Lake) -> DataFrame:
    """FB-2a, W-03: the unit before the last change of unit."""
    moved = _history(lake).withColumn("before", F.lag("org").over(Window.partitionBy("e").orderBy("f"))).where("before <> org")
    return moved.groupBy(F.col("e").alias("employee_id")).agg(F.max_by("before", "f").alias("previous_org"), F.max("f").alias("moved_on"))


@query(f"""WITH {_ASAT},{_MONTHS} SELECT a.e AS employee_id, a.period, a.grade, o.business_line, year(a.d) - year(a.dob) AS age, (year(a.d) * 12 + month(a.d)) - (year(hired) * 12 + month(hired)) AS months_since_hire, (year(a.d) * 12 + month(a.d)) - (year(left_on) * 12 + month(left_on)) AS months_since_left,
p.e IS NOT NULL AS paid_row, coalesce(p.paid, FALSE) AS paid, round(coalesce(p.base, 0) + coalesce(p.allowance, 0), 2) AS standing, round(CASE WHEN p.base > 0 THEN p.allowance / p.base END, 6) AS allowance_ratio, round(p.net / a.working_days, 4) AS net_a_day
FROM asat a LEFT JOIN pm p ON p.e = a.e AND p.period = a.period LEFT JOIN dim_org_unit o ON o.org_unit_id = a.org""")
def fb2b_period_features(lake: Lake) -> DataFrame:
    """FB-2b, F-23: state, pay, unit and calendar of a month side by side, with derived columns."""
    a = as_at(lake)
    units = lake.dim_org_unit.select(F.col("org_unit_id").alias("org"), "business_line")
    wide = a.join(pay_months(lake), ["e", "period"], "left").join(units, "org", "left")
    base, zero = F.col("base"), F.lit(0.0)
    return wide.select(
        F.col("e").alias("employee_id"), "period", "grade", "business_line", (F.year("d") - F.year("dob")).cast("long").alias("age"),
        P.month_boundaries("hired", "d").cast("long").alias("months_since_hire"), P.month_boundaries("left_on", "d").cast("long").alias("months_since_left"),
        F.col("paid").isNotNull().alias("paid_row"), F.coalesce("paid", F.lit(False)).alias("paid"), F.round(F.coalesce(base, zero) + F.coalesce("allowance", zero), 2).alias("standing"),
        F.round(F.when(base > 0, F.col("allowance") / F.nullif(base, zero)), 6).alias("allowance_ratio"), F.round(F.col("net") / F.nullif(F.col("working_days"), F.lit(0)), 4).alias("net_a_day"),
    )


@query(f"""WITH {_MONTHS}, l AS (SELECT e, period // 100 * 12 + period % 100 AS i, base, net, base - lag(base) OVER w AS db, net - lag(net) OVER w AS dn, lag(base) OVER w AS b0 FROM pm WINDOW w AS (PARTITION BY e ORDER BY period))
SELECT e AS employee_id, count(*) AS months, round(avg(base), 8) AS base_mean, round(stddev_samp(base), 4) AS base_spread, round(regr_slope(base, i), 4) AS base_slope, round(max(abs(db)), 4) AS base_jump, round(max(CASE WHEN b0 > 0 THEN abs(db) / b0 END), 6) AS base_jump_share, round(avg(net), 8) AS net_mean, round(max(abs(dn)), 4) AS net_jump FROM l GROUP BY e""")
def fb3a_rollups(lake: Lake) -> DataFrame:
    """FB-3a: mean, deviation, slope and greatest step of the months that have pay."""
    w = Window.partitionBy("e").orderBy("period")
    steps = pay_months(lake).select("e", P.month_index("period").alias("i"), "base", "net", F.lag("base").over(w).alias("b0"), F.lag("net").over(w).alias("n0"))
    jump = F.abs(F.col("base") - F.col("b0"))
    return steps.groupBy(F.col("e").alias("employee_id")).agg(
        F.count("*").alias("months"), F.round(F.avg("base"), 8).alias("base_mean"), F.round(F.stddev_samp("base"), 4).alias("base_spread"), F.round(F.regr_slope("base", "i"), 4).alias("base_slope"),
        F.round(F.max(jump), 4).alias("base_jump"), F.round(F.max(F.when(F.col("b0") > 0, jump / F.nullif(F.col("b0"), F.lit(0.0)))), 6).alias("base_jump_share"), F.round(F.avg("net"), 8).alias("net_mean"), F.round(F.max(F.abs(F.col("net") - F.col("n0"))), 4).alias("net_jump"),
    )


_CODES = ("overtime", "bonus", "allowance")
_LONG = " UNION ALL ".join(f"SELECT e, period, '{c}' AS code, {c} AS amount FROM pm WHERE {c} > 0" for c in _CODES)


@query(f"""WITH {_MONTHS}, l AS ({_LONG}), d AS (SELECT *, amount - lag(amount) OVER (PARTITION BY e, code ORDER BY period) AS step FROM l)
SELECT e AS employee_id, code, count(*) AS months, min(period) AS first_period, max(period) AS last_period, round(avg(amount), 8) AS mean, max(amount) AS most, round(sum(amount), 2) AS total, round(max(step), 2) AS jump FROM d GROUP BY ALL""")
def fb3b_amount_history(lake: Lake) -> DataFrame:
    """FB-3b: the history of each code of an employee, steps within both keys."""
    long = pay_months(lake).select("e", "period", F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("amount")) for c in _CODES]))).where("amount > 0")
    steps = long.withColumn("step", F.col("amount") - F.lag("amount").over(Window.partitionBy("e", "code").orderBy("period")))
    return steps.groupBy(F.col("e").alias("employee_id"), "code").agg(F.count("*").alias("months"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.round(F.avg("amount"), 8).alias("mean"), F.max("amount").alias("most"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.max("step"), 2).alias("jump"))


@query(problems._TREE + f""", {_MASTER},
ib AS (SELECT DISTINCT {_ID('employee_id')} AS e, iban AS v FROM fact_bank_account WHERE iban IS NOT NULL AND {_ID('employee_id')} IS NOT NULL), ibs AS (SELECT v, count(*) AS n FROM ib GROUP BY v), ibm AS (SELECT e, max(n) AS n FROM ib JOIN ibs USING (v) GROUP BY e),
ni AS (SELECT DISTINCT {_ID('employee_id')} AS e, national_id AS v FROM employee_master WHERE national_id IS NOT NULL AND {_ID('employee_id')} IS NOT NULL), nis AS (SELECT v, count(*) AS n FROM ni GROUP BY v), nim AS (SELECT e, max(n) AS n FROM ni JOIN nis USING (v) GROUP BY e),
ap AS (SELECT {_ID('employee_id')} AS e, {_ID('approved_by')} AS b FROM fact_assignment_history), gv AS (SELECT b AS e, count(*) AS n FROM ap WHERE b IS NOT NULL GROUP BY 1), sf AS (SELECT e, bool_or(e = b) AS own FROM ap WHERE e IS NOT NULL GROUP BY 1)
SELECT m.e AS employee_id, coalesce(ibm.n, 1) AS account_cluster, coalesce(nim.n, 1) AS identity_cluster, CAST(CASE WHEN NOT res.looped THEN res.depth END AS int) AS manager_depth, coalesce(res.looped AND res.depth = 0, FALSE) AS in_cycle, coalesce(gv.n, 0) AS approvals_given, coalesce(sf.own, FALSE) AS own_approval
FROM m LEFT JOIN ibm ON ibm.e = m.e LEFT JOIN nim ON nim.e = m.e LEFT JOIN res ON res.e = m.e LEFT JOIN gv ON gv.e = m.e LEFT JOIN sf ON sf.e = m.e""")
def fb4_graph_features(lake: Lake) -> DataFrame:
    """FB-4, R-01, R-07: how many share an employee's account and identity, place in the tree of managers, approvals; defaults where nothing is known."""
    people = lake.employee_master.select(K.norm_id("employee_id").alias("e"), "national_id").where("e is not null")
    accounts = graphs.cluster_sizes(lake.fact_bank_account.select(K.norm_id("employee_id").alias("e"), "iban"), "e", "iban").withColumnsRenamed({"node": "e", "cluster_size": "account"})
    identities = graphs.cluster_sizes(people, "e", "national_id").withColumnsRenamed({"node": "e", "cluster_size": "identity"})
    tree = hierarchy.hierarchy(problems._links(lake), "employee_id", "manager_id").select(F.col("employee_id").alias("e"), "depth", "kind")
    approvals = lake.fact_assignment_history.select(K.norm_id("employee_id").alias("e"), K.norm_id("approved_by").alias("b"))
    given = approvals.where("b is not null").groupBy(F.col("b").alias("e")).agg(F.count("*").alias("given"))
    own = approvals.where("e is not null").groupBy("e").agg(F.bool_or(F.col("e") == F.col("b")).alias("own"))
    wide = people.select("e").distinct()
    for part in (accounts, identities, tree, given, own):
        wide = wide.join(part, "e", "left")
    one, no = F.lit(1).cast("long"), F.lit(False)
    return wide.select(F.col("e").alias("employee_id"), F.coalesce("account", one).alias("account_cluster"), F.coalesce("identity", one).alias("identity_cluster"), F.when(F.col("kind") == "tree", F.col("depth")).alias("manager_depth"), F.coalesce(F.col("kind") == "cycle", no).alias("in_cycle"), F.coalesce("given", F.lit(0).cast("long")).alias("approvals_given"), F.coalesce("own", no).alias("own_approval"))


@query(f"""WITH {_MONTHS}, a AS (SELECT e, max(period) AS last_period, count(*) AS months, round(avg(hours), 8) AS mean_hours, round(sum(overtime) / nullif(sum(base), 0), 6) AS overtime_ratio, count(*) FILTER (WHERE paid AND coalesce(overtime, 0) = 0 AND coalesce(bonus, 0) = 0 AND coalesce(retro, 0) = 0) AS silent_months FROM pm GROUP BY e)
SELECT a.e AS employee_id, a.last_period, pm.net AS last_net, pm.base AS last_base, months, mean_hours, overtime_ratio, silent_months FROM a JOIN pm ON pm.e = a.e AND pm.period = a.last_period""")
def fb5_employee_features(lake: Lake) -> DataFrame:
    """FB-5: the latest month of an employee with means over what is known, ratios and counts, in one aggregation."""
    nothing = F.lit(True)
    for c in ("overtime", "bonus", "retro"):
        nothing = nothing & (F.coalesce(c, F.lit(0.0)) == 0)
    last = F.max(F.struct("period", "net", "base"))
    found = pay_months(lake).groupBy(F.col("e").alias("employee_id")).agg(last.alias("_l"), F.count("*").alias("months"), F.round(F.avg("hours"), 8).alias("mean_hours"), F.round(F.sum("overtime") / F.nullif(F.sum("base"), F.lit(0.0)), 6).alias("overtime_ratio"), F.count_if(F.col("paid") & nothing).alias("silent_months"))
    return found.select("employee_id", F.col("_l.period").alias("last_period"), F.col("_l.net").alias("last_net"), F.col("_l.base").alias("last_base"), "months", "mean_hours", "overtime_ratio", "silent_months")


_RUNGS = [["job_family", "grade", "region_code", "nationality_class"], ["job_family", "grade", "region_code"], ["job_family", "grade"], ["job_family"], ["grade"]]
_METRICS = ["base_salary", "allowance_total_monthly", "allowance_ratio"]


def _rungs_sql() -> str:
    levels = " UNION ALL ".join(f"SELECT {i} AS level, concat_ws('|', {', '.join(g)}) AS cohort, * FROM x WHERE {' AND '.join(c + ' IS NOT NULL' for c in g)}" for i, g in enumerate(_RUNGS, 1))
    values = " UNION ALL ".join(f"SELECT level, cohort, '{m}' AS metric, CAST({m} AS double) AS v FROM l WHERE {m} IS NOT NULL AND NOT isnan(CAST({m} AS double))" for m in _METRICS)
    return f"""WITH x AS (SELECT lower(trim(job_family)) AS job_family, grade, region_code, nationality_class, {', '.join(_METRICS)} FROM employee_features), l AS ({levels}), v AS ({values}),
m AS (SELECT level, cohort, metric, count(*) AS n, median(v) AS med, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.99) AS high FROM v GROUP BY ALL), d AS (SELECT level, cohort, metric, median(abs(v.v - m.med)) AS mad FROM v JOIN m USING (level, cohort, metric) GROUP BY ALL)
SELECT level, cohort, metric, n, round(med, 6) AS median, round(mad, 6) AS mad, round(low, 6) AS low, round(high, 6) AS high FROM m JOIN d USING (level, cohort, metric)"""


@query(_rungs_sql())
def fb6_five_rungs(lake: Lake) -> DataFrame:
    """FB-6, A-21: robust statistics of three metrics on five groupings, the null groups of a grouping left out."""
    people = lake.employee_features.withColumn("job_family", F.lower(F.trim("job_family")))
    stats = cohorts.ladder_stats(people, _RUNGS, _METRICS)
    return stats.select("level", "cohort", "metric", "n", *[F.round(c, 6).alias(c) for c in ("median", "mad", "low", "high")])
