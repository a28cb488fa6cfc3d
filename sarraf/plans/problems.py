"""The queries of problems 3 to 6 and the same results in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarraf.functions import periods as P
from sarraf.functions.keys import norm_id, norm_word
from sarraf.operators import attributes, hierarchy, intervals, rolling
from sarraf.sources.catalog import Lake

#: Fixed values of the project: the change reasons that are moves, and the last day of current rows.
MOVES = ("promotion", "transfer", "regrade", "acting", "return_from_acting")
CURRENT_ON = dt.date(2025, 12, 31)


def _entities(lake: Lake) -> DataFrame:
    parts = []
    for source, table in (("assignment", lake.fact_assignment_history), ("bank", lake.fact_bank_account)):
        rows = intervals.valid_intervals(table, norm_id("employee_id"), "effective_from", "effective_to")
        parts.append(rows.select(F.lit(source).alias("entity_source"), F.col("_k").alias("employee_id"), "_from", "_to"))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps, and continuous periods in which intervals overlap, of both interval tables."""
    rows = intervals.periods_and_gaps(_entities(Lake(spark, folder)), ["entity_source", "employee_id"], "_from", "_to")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.where("kind <> 'period'").select("entity_source", "employee_id", "kind", day("from_day"), day("to_day"))


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Every continuous period with the number of intervals that share its busiest day."""
    rows = intervals.coalesce_intervals(_entities(Lake(spark, folder)), ["entity_source", "employee_id"], "_from", "_to")
    return rows.select("entity_source", "employee_id", "from_day", "to_day", F.col("deepest").cast("long").alias("deepest"))


def _assignments(lake: Lake) -> DataFrame:
    rows = intervals.valid_intervals(
        lake.fact_assignment_history, norm_id("employee_id"), "effective_from", "effective_to",
        F.col("grade").cast("int").alias("grade"), "base_salary", norm_id("manager_id").alias("manager_id"),
    )
    return rows.withColumnRenamed("_k", "employee_id")


def _payroll_as_known(lake: Lake) -> tuple[DataFrame, DataFrame]:
    paid = lake.fact_payroll_monthly.select(norm_id("employee_id").alias("employee_id"), "period", "base_pay").where(P.is_period("period") & F.col("employee_id").isNotNull())
    events = paid.select("employee_id", P.last_day("period").alias("day"))
    held = _assignments(lake)
    wanted = {"in_force_from": F.col("_from"), "grade": F.col("grade"), "base_salary": F.col("base_salary")}
    histories = attributes.change_histories(held, "employee_id", "_from", "_to", wanted)
    return paid, attributes.as_known_at(events, "employee_id", "day", histories, list(wanted))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Payroll rows paid at a salary that came into force only after the period."""
    lake = Lake(spark, folder)
    paid, known = _payroll_as_known(lake)
    known = known.where("base_salary is not null").select("employee_id", (F.year("day") * 100 + F.month("day")).alias("period"), "day", "in_force_from", "grade", "base_salary")
    later = _assignments(lake).groupBy("employee_id", F.col("base_salary").alias("base_pay")).agg(F.max("_from").alias("starts"))
    rows = paid.where("base_pay is not null").distinct().join(known, ["employee_id", "period"]).where("base_pay <> base_salary")
    early = rows.join(later, ["employee_id", "base_pay"]).where("starts > day")
    return early.select("employee_id", "period", F.date_format("in_force_from", "yyyy-MM-dd").alias("in_force_from"), "grade").distinct()


def p4_as_known(spark: SparkSession, folder: str) -> DataFrame:
    """Grade and salary in force at the end of every month with payroll, by employee and month."""
    _, known = _payroll_as_known(Lake(spark, folder))
    return known.select("employee_id", "day", "in_force_from", "grade", "base_salary")


def _links(lake: Lake) -> DataFrame:
    rows = _assignments(lake).where(F.col("_from") <= F.lit(CURRENT_ON))
    current = rows.groupBy("employee_id").agg(F.max(F.struct("_from", "_to", "manager_id")).alias("now"))
    return current.select("employee_id", F.col("now.manager_id").alias("manager_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth and kind of every employee with a current assignment row."""
    return hierarchy.hierarchy(_links(Lake(spark, folder)), "employee_id", "manager_id").select("employee_id", "root_id", "depth", "kind")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The chain of each employee, from the root (or the cycle) down."""
    links = _links(Lake(spark, folder))
    found = hierarchy.hierarchy(links, "employee_id", "manager_id")
    return hierarchy.paths(links, "employee_id", "manager_id", found).select("employee_id", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of an id and an employee below it, with the links between them."""
    links = _links(Lake(spark, folder))
    found = hierarchy.hierarchy(links, "employee_id", "manager_id")
    pairs = hierarchy.descendants(hierarchy.paths(links, "employee_id", "manager_id", found), "employee_id")
    return pairs.withColumn("distance", F.col("distance").cast("int"))


def _net_totals(lake: Lake) -> DataFrame:
    # Exact repeats count once, supplements add up. Rows are told apart by 128 bits over all columns, so
    # that only these and the cents are shuffled; E00000000 stays spread over its different rows.
    rows = lake.fact_payroll_monthly.where(P.is_period("period")).withColumn("employee_id", norm_id("employee_id"))
    nulls = [F.col(c).isNull() for c in rows.columns]  # a null leaves a hash as it is
    mark = [F.xxhash64(F.lit(1), *rows.columns, *nulls).alias("_a"), F.xxhash64(*nulls, *rows.columns[::-1], F.lit(2)).alias("_b")]
    cents = F.when(F.col("paid_flag"), (F.col("net") * 100).cast("long")).alias("cents")
    rows = rows.select("employee_id", P.month_index("period").alias("month"), cents, *mark)
    rows = rows.groupBy("employee_id", "month", "_a", "_b").agg(F.max("cents").alias("cents"))
    return rolling.rolling_totals(rows, "employee_id", "month", "cents", [3, 6, 12])


def _move_totals(lake: Lake) -> DataFrame:
    months = lake.dim_calendar.where(P.is_period("period")).agg(F.min(P.month_index("period")), F.max(P.month_index("period"))).first()
    if months[0] is None:
        months = (0, -1)
    moves = lake.fact_assignment_history.select(norm_id("employee_id").alias("employee_id"), F.col("effective_from").cast("date").alias("day"), norm_word("change_reason").alias("reason"))
    moves = moves.where(F.col("day").isNotNull() & F.col("reason").isin(*MOVES)).distinct()
    rows = moves.select("employee_id", P.index_of_date("day").alias("month"), F.lit(1).alias("moves"))
    return rolling.rolling_totals(rows, "employee_id", "month", "moves", [3, 6, 12], first=months[0], last=months[1], beyond=11)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Months in which a quarter's net outweighs the year's rest, or moves crowd a half-year."""
    lake = Lake(spark, folder)
    net = _net_totals(lake).where("nth >= 12 and total_12 > 0 and 2 * total_3 > total_12").select(F.lit("net").alias("measure"), "employee_id", P.period_of_index("month").alias("period"))
    moves = _move_totals(lake).where("total_6 >= 4").select(F.lit("changes").alias("measure"), "employee_id", P.period_of_index("month").alias("period"))
    known = F.broadcast(lake.dim_calendar.select("period").distinct())  # one row per calendar month
    return net.unionByName(moves.join(known, "period", "left_semi").select("measure", "employee_id", "period"))


def p6_net_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Net over 3, 6 and 12 trailing months and the monthly mean of 12, for every month of every employee."""
    money = lambda c: (F.col(c).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")
    rows = _net_totals(Lake(spark, folder))
    return rows.select("employee_id", P.period_of_index("month").alias("period"), *[money(f"total_{w}").alias(f"net_{w}") for w in (3, 6, 12)], F.round(rolling.rolling_mean(F.col("total_12") / 100, 12), 4).alias("mean_12"))


QUERIES = {f.__name__: f for f in (p3_found, p3_periods, p4_found, p4_as_known, p5_found, p5_paths, p5_descendants, p6_found, p6_net_totals)}

_ID = r"nullif(upper(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_VALID = f"""
  SELECT DISTINCT {_ID.format('employee_id')} AS e, CAST(effective_from AS date) AS f, coalesce(CAST(effective_to AS date), DATE '9999-12-31') AS t{{more}}
  FROM {{table}}
  WHERE {_ID.format('employee_id')} IS NOT NULL AND effective_from IS NOT NULL AND coalesce(effective_to, DATE '9999-12-31') >= effective_from"""
_PERIODS = f"""
WITH v AS (
  SELECT 'assignment' AS src, * FROM ({_VALID.format(table='fact_assignment_history', more='')})
  UNION ALL SELECT 'bank', * FROM ({_VALID.format(table='fact_bank_account', more='')})
), far AS (
  SELECT *, max(t) OVER (PARTITION BY src, e ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v
), isl AS (
  SELECT *, sum(CASE WHEN reached IS NULL OR datediff('day', reached, f) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY src, e ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS g FROM far
), starts AS (
  SELECT a.src, a.e, a.g, a.f, count(*) AS n FROM isl a JOIN isl b ON a.src = b.src AND a.e = b.e AND a.g = b.g AND b.f <= a.f AND b.t >= a.f GROUP BY a.src, a.e, a.g, a.f, a.t
), per AS (
  SELECT src, e, g, min(f) AS f, max(t) AS t FROM isl GROUP BY src, e, g
), deep AS (
  SELECT src, e, g, max(n) AS n FROM starts GROUP BY src, e, g
), p AS (
  SELECT per.*, deep.n, lead(per.f) OVER (PARTITION BY per.src, per.e ORDER BY per.f) AS nf FROM per JOIN deep USING (src, e, g)
)"""
_HELD = f"""
WITH h AS ({_VALID.format(table='fact_assignment_history', more=", CAST(grade AS int) AS grade, base_salary, " + _ID.format('manager_id') + " AS manager_id")}
), pay AS (
  SELECT DISTINCT {_ID.format('employee_id')} AS e, period, base_pay, last_day(make_date(period // 100, period % 100, 1)) AS d FROM fact_payroll_monthly
), ev AS (SELECT DISTINCT e, d FROM pay WHERE e IS NOT NULL
), known AS (
  SELECT ev.e, ev.d, h.f, h.grade, h.base_salary, row_number() OVER (PARTITION BY ev.e, ev.d ORDER BY h.f DESC NULLS LAST, h.t DESC) AS n
  FROM ev LEFT JOIN h ON ev.e = h.e AND h.f <= ev.d AND h.t >= ev.d
)"""
_TREE = f"""
WITH RECURSIVE h AS ({_VALID.format(table='fact_assignment_history', more=", " + _ID.format('manager_id') + " AS m")}
), cur AS (
  SELECT e, m FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY f DESC, t DESC, m DESC NULLS LAST) AS n FROM h WHERE f <= DATE '2025-12-31') WHERE n = 1
), up AS (
  SELECT e, e AS pos, 0 AS n, [e] AS seen, false AS looped FROM cur
  UNION ALL
  SELECT up.e, cur.m, up.n + 1, list_append(up.seen, cur.m), list_contains(up.seen, cur.m) FROM up JOIN cur ON cur.e = up.pos WHERE cur.m IS NOT NULL AND NOT up.looped
), fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY n DESC) AS k FROM up) WHERE k = 1
), res AS (
  SELECT e, looped, seen, pos, n, CASE WHEN looped THEN list_position(seen, pos) - 1 ELSE n END AS depth,
    CASE WHEN looped THEN list_min(seen[list_position(seen, pos):]) ELSE pos END AS root_id
  FROM fin
)"""
_NET = f"""
WITH m AS (
  SELECT employee_id AS e, period // 100 * 12 + period % 100 - 1 AS i, sum(CASE WHEN paid_flag THEN coalesce(net, 0) ELSE 0 END) AS v
  FROM (SELECT DISTINCT * REPLACE ({_ID.format('employee_id')} AS employee_id) FROM fact_payroll_monthly) WHERE employee_id IS NOT NULL GROUP BY ALL
), span AS (SELECT e, min(i) AS lo, max(i) AS hi FROM m GROUP BY e
), grid AS (SELECT e, lo, unnest(generate_series(lo, hi)) AS i FROM span
), s AS (
  SELECT g.e, g.i, g.i - g.lo + 1 AS nth,
    sum(coalesce(v, 0)) OVER (PARTITION BY g.e ORDER BY g.i ROWS 2 PRECEDING) AS t3,
    sum(coalesce(v, 0)) OVER (PARTITION BY g.e ORDER BY g.i ROWS 5 PRECEDING) AS t6,
    sum(coalesce(v, 0)) OVER (PARTITION BY g.e ORDER BY g.i ROWS 11 PRECEDING) AS t12
  FROM grid g LEFT JOIN m ON m.e = g.e AND m.i = g.i
)"""

SQL = {
    "p3_found": _PERIODS + """
SELECT src AS entity_source, e AS employee_id, 'merged' AS kind, strftime(f, '%Y-%m-%d') AS from_day, strftime(t, '%Y-%m-%d') AS to_day FROM p WHERE n > 1
UNION ALL
SELECT src, e, 'gap', strftime(t + INTERVAL 1 DAY, '%Y-%m-%d'), strftime(nf - INTERVAL 1 DAY, '%Y-%m-%d') FROM p WHERE nf IS NOT NULL""",
    "p3_periods": _PERIODS + "\nSELECT src AS entity_source, e AS employee_id, f AS from_day, t AS to_day, n AS deepest FROM p",
    "p4_found": _HELD + """
SELECT DISTINCT pay.e AS employee_id, pay.period, strftime(known.f, '%Y-%m-%d') AS in_force_from, known.grade
FROM pay JOIN known ON known.e = pay.e AND known.d = pay.d AND known.n = 1
WHERE pay.base_pay <> known.base_salary AND EXISTS (SELECT 1 FROM h WHERE h.e = pay.e AND h.base_salary = pay.base_pay AND h.f > pay.d)""",
    "p4_as_known": _HELD + "\nSELECT e AS employee_id, d AS day, f AS in_force_from, grade, base_salary FROM known WHERE n = 1",
    "p5_found": _TREE + """
SELECT e AS employee_id, root_id, CAST(depth AS int) AS depth, CASE WHEN NOT looped THEN 'tree' WHEN depth = 0 THEN 'cycle' ELSE 'into_cycle' END AS kind FROM res""",
    "p5_paths": _TREE + """
SELECT e AS employee_id, array_to_string(list_reverse(seen[1:depth + 1]), '/') AS path FROM res""",
    "p5_descendants": _TREE + """
SELECT ancestor, descendant, CAST(distance AS int) AS distance FROM (
  SELECT e AS descendant, unnest(seen[2:depth + 1]) AS ancestor, unnest(generate_series(1, depth)) AS distance FROM res WHERE depth > 0)""",
    "p6_found": _NET + f"""
, mv AS (
  SELECT DISTINCT {_ID.format('employee_id')} AS e, CAST(effective_from AS date) AS f, lower(regexp_replace(change_reason, '^\\s+|\\s+$', '', 'g')) AS r
  FROM fact_assignment_history WHERE effective_from IS NOT NULL AND {_ID.format('employee_id')} IS NOT NULL
), mvi AS (SELECT e, year(f) * 12 + month(f) - 1 AS i, count(*) AS v FROM mv WHERE r IN ('promotion', 'transfer', 'regrade', 'acting', 'return_from_acting') GROUP BY ALL)
SELECT 'net' AS measure, e AS employee_id, CAST(i // 12 * 100 + i % 12 + 1 AS int) AS period FROM s WHERE nth >= 12 AND t12 > 0 AND 2 * t3 > t12
UNION ALL
SELECT 'changes', e, c.period FROM (SELECT DISTINCT period FROM dim_calendar) c JOIN mvi ON mvi.i BETWEEN c.period // 100 * 12 + c.period % 100 - 6 AND c.period // 100 * 12 + c.period % 100 - 1
GROUP BY e, c.period HAVING sum(v) >= 4""",
    "p6_net_totals": _NET + """
SELECT e AS employee_id, CAST(i // 12 * 100 + i % 12 + 1 AS int) AS period, CAST(t3 AS decimal(18,2)) AS net_3, CAST(t6 AS decimal(18,2)) AS net_6, CAST(t12 AS decimal(18,2)) AS net_12,
  round(CAST(t12 AS double) / 12, 4) AS mean_12 FROM s""",
}
