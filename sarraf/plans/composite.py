"""Composite operators, one query each: peer groups, rules, walks, scores, aggregates, checks, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sarraf.functions import keys as K
from sarraf.functions import periods as P
from sarraf.functions import text as X
from sarraf.operators import cohorts, distribution, graphs, integrity, ml, rules, windows
from sarraf.plans import problems
from sarraf.plans.base import Registry
from sarraf.session import cut
from sarraf.sources.catalog import Lake

query = Registry()

_LADDER = [["job_family", "grade", "region_code"], ["job_family", "grade"], ["grade"]]
_STATS = """
WITH x AS (SELECT lower(trim(job_family)) AS job_family, grade, region_code, employee_id, CAST(base_salary AS double) AS base_salary, allowance_ratio FROM employee_features),
l AS (SELECT 1 AS level, concat_ws('|', job_family, grade, region_code) AS cohort, * FROM x WHERE job_family IS NOT NULL AND grade IS NOT NULL AND region_code IS NOT NULL
 UNION ALL SELECT 2, concat_ws('|', job_family, grade), * FROM x WHERE job_family IS NOT NULL AND grade IS NOT NULL UNION ALL SELECT 3, CAST(grade AS varchar), * FROM x WHERE grade IS NOT NULL),
v AS (SELECT level, cohort, employee_id, 'base_salary' AS metric, base_salary AS value FROM l WHERE base_salary IS NOT NULL UNION ALL SELECT level, cohort, employee_id, 'allowance_ratio', allowance_ratio FROM l WHERE allowance_ratio IS NOT NULL AND NOT isnan(allowance_ratio)),
m AS (SELECT level, cohort, metric, count(*) AS n, median(value) AS median, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM v GROUP BY ALL),
d AS (SELECT level, cohort, metric, median(abs(v.value - m.median)) AS mad FROM v JOIN m USING (level, cohort, metric) GROUP BY ALL),
st AS (SELECT m.*, d.mad FROM m JOIN d USING (level, cohort, metric))"""


def _people(lake: Lake) -> DataFrame:
    return lake.employee_features.withColumn("job_family", F.lower(F.trim("job_family")))


@query(_STATS + " SELECT level, cohort, metric, n, round(median, 7) AS median, round(mad, 7) AS mad, round(low, 7) AS low, round(high, 7) AS high FROM st")
def fb6_cohort_stats(lake: Lake) -> DataFrame:
    """FB-6, A-08, A-09, A-21, U-04: robust statistics of two metrics on three groupings."""
    stats = cohorts.ladder_stats(_people(lake), _LADDER, ["base_salary", "allowance_ratio"])
    return stats.select("level", "cohort", "metric", "n", *[F.round(c, 7).alias(c) for c in ("median", "mad", "low", "high")])


@query(_STATS + """, j AS (SELECT v.employee_id, v.value, st.level, st.n, st.median, st.mad, row_number() OVER (PARTITION BY v.employee_id ORDER BY (st.n >= 30) DESC, CASE WHEN st.n >= 30 THEN st.level ELSE -st.level END) AS r FROM (SELECT DISTINCT * FROM v) v JOIN st USING (level, cohort, metric) WHERE metric = 'base_salary')
SELECT employee_id, level, n, round(CASE WHEN n >= 8 AND greatest(mad, abs(median) * 0.02) > 0 THEN 0.6745 * (value - median) / greatest(mad, abs(median) * 0.02) END, 9) AS z FROM j WHERE r = 1""")
def w10_peer_z(lake: Lake) -> DataFrame:
    """W-10, F-39: each employee against the finest grouping that is large enough."""
    people = _people(lake)
    stats = cohorts.ladder_stats(people, _LADDER, ["base_salary"])
    chosen = cohorts.choose_rung(people, "employee_id", _LADDER, "base_salary", stats, 30)
    return chosen.select("employee_id", "level", "n", F.round(cohorts.robust_z("value", "median", "mad", "n"), 9).alias("z"))


_DEMO_RULES = [
    rules.Rule("Q01", "overtime_hours > 40 AND NOT isnan(overtime_hours)", "overtime_pay", "CASE WHEN overtime_hours > 60 THEN 'HIGH' ELSE 'MEDIUM' END", "NOT paid_flag", "{overtime_hours:,.1f} hours for {overtime_pay:,.0f}", ["overtime_hours", "overtime_pay"]),
    rules.Rule("Q02", "absence_deduction > 0", "absence_deduction", "'LOW'", None, "absence of {absence_deduction:,.0f} at {cost_center}", ["absence_deduction", "cost_center"]),
]


@query("""WITH h AS (
SELECT employee_id AS e, period // 100 * 12 + period % 100 - 1 AS m, 'Q01' AS code, CAST(overtime_pay AS double) AS v, CASE WHEN overtime_hours > 60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM fact_payroll_monthly WHERE overtime_hours > 40 AND NOT isnan(overtime_hours) AND NOT coalesce(NOT paid_flag, FALSE)
UNION ALL SELECT employee_id, period // 100 * 12 + period % 100 - 1, 'Q02', CAST(absence_deduction AS double), 'LOW' FROM fact_payroll_monthly WHERE absence_deduction > 0),
d AS (SELECT e, code, m, sum(v) AS v FROM h GROUP BY ALL), g AS (SELECT *, m - row_number() OVER (PARTITION BY e, code ORDER BY m) AS k FROM d)
SELECT e AS employee_id, code, CAST(min(m) // 12 * 100 + min(m) % 12 + 1 AS int) AS period_from, CAST(max(m) // 12 * 100 + max(m) % 12 + 1 AS int) AS period_to, count(*) AS months, round(arg_max(v, m), 2) AS monthly, round(sum(v), 2) AS cumulative FROM g GROUP BY e, code, k""")
def p05_rules(lake: Lake) -> DataFrame:
    """P-05 to P-07, S-17, W-11, F-10: two declared rules over payroll, as windows of months with impact."""
    found = rules.run_rules(_DEMO_RULES, lake.fact_payroll_monthly, "employee_id", "period")
    return found.select("employee_id", "code", "period_from", "period_to", "months", F.round("monthly", 2).alias("monthly"), F.round("cumulative", 2).alias("cumulative"))


@query("""SELECT employee_id, period, format('{:,.0f}', CAST(net AS double)) AS net_text, coalesce(CAST(cost_center AS varchar), 'not recorded') || ' in ' || CAST(period AS varchar) AS description FROM fact_payroll_monthly WHERE net IS NOT NULL""")
def f10_messages(lake: Lake) -> DataFrame:
    """F-05, F-10: number formats and templates as columns."""
    p = lake.fact_payroll_monthly.where("net is not null")
    return p.select("employee_id", "period", F.format_number(F.col("net").cast("double"), 0).alias("net_text"), rules.message("{cost_center} in {period}").alias("description"))


_ORG = """
WITH RECURSIVE w(node, pos, depth) AS (SELECT org_unit_id, parent_org_unit_id, 0 FROM dim_org_unit UNION ALL SELECT node, o.parent_org_unit_id, depth + 1 FROM w JOIN dim_org_unit o ON o.org_unit_id = w.pos WHERE depth < 12)"""


@query(_ORG + " SELECT node, CAST(max(depth) AS int) AS depth, FALSE AS looped FROM w GROUP BY node")
def r01_chain(lake: Lake) -> DataFrame:
    """R-08: the chain of each unit up to its root, at most twelve links."""
    return graphs.chain(lake.dim_org_unit, "org_unit_id", "parent_org_unit_id", 12)


@query("""WITH RECURSIVE w(a, b, n) AS (SELECT org_unit_id, parent_org_unit_id, 1 FROM dim_org_unit WHERE parent_org_unit_id IS NOT NULL UNION ALL SELECT a, parent_org_unit_id, n + 1 FROM w JOIN dim_org_unit ON org_unit_id = b WHERE parent_org_unit_id IS NOT NULL AND n < 3)
SELECT a AS start, b AS "end", min(n)::INT AS steps FROM w GROUP BY ALL""")
def r02_reach(lake: Lake) -> DataFrame:
    """R-02: what is reached within three links."""
    return graphs.reach(lake.dim_org_unit, "org_unit_id", "parent_org_unit_id", 3)


_MANAGERS = f"""
WITH RECURSIVE h AS ({problems._VALID.format(table='fact_assignment_history', more=", " + problems._ID.format('manager_id') + " AS m")}
), cur AS (
  SELECT e, m FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY f DESC, t DESC, m DESC NULLS LAST) AS n FROM h WHERE f <= DATE '2025-12-31') WHERE n = 1
)"""


@query(_MANAGERS + """, w(node, pos, depth) AS (SELECT e, m, CASE WHEN m IS NULL THEN 0 ELSE 1 END FROM cur UNION ALL SELECT node, cur.m, depth + 1 FROM w JOIN cur ON cur.e = pos WHERE cur.m IS NOT NULL AND pos <> node AND depth < 30)
SELECT node, CAST(max(depth) AS int) AS depth, coalesce(bool_or(pos = node), FALSE) AS looped FROM w GROUP BY node""")
def r01_manager_chain(lake: Lake) -> DataFrame:
    """R-01, J-17: the chain of current managers of each employee up to its root or itself, at most thirty links."""
    return graphs.chain(problems._links(lake), "employee_id", "manager_id", 30)


@query(_MANAGERS + """, w(a, b, n) AS (SELECT e, m, 1 FROM cur WHERE m IS NOT NULL UNION ALL SELECT a, cur.m, n + 1 FROM w JOIN cur ON cur.e = b WHERE cur.m IS NOT NULL AND n < 6)
SELECT a AS start, b AS "end", CAST(min(n) AS int) AS steps FROM w GROUP BY ALL""")
def r02_manager_reach(lake: Lake) -> DataFrame:
    """R-02: the managers above each employee within six links."""
    return graphs.reach(problems._links(lake), "employee_id", "manager_id", 6)


_MANAGED = "(SELECT DISTINCT upper(trim(employee_id)) AS a, upper(trim(manager_id)) AS b FROM fact_assignment_history WHERE employee_id IS NOT NULL AND manager_id IS NOT NULL AND upper(trim(employee_id)) <> upper(trim(manager_id)))"


@query(f"""WITH RECURSIVE e AS {_MANAGED}, w(path) AS (SELECT [a, b] FROM e WHERE a < b UNION ALL SELECT list_append(path, b) FROM w JOIN e ON a = path[-1] WHERE b > path[1] AND NOT list_contains(path, b) AND len(path) < 4)
SELECT array_to_string(path, '>') AS path FROM w JOIN e ON e.a = path[-1] AND e.b = path[1]""")
def r04_cycles(lake: Lake) -> DataFrame:
    """R-04: simple cycles of up to four links of `was ever managed by`, each from its smallest member."""
    h = lake.fact_assignment_history.select(K.norm_id("employee_id").alias("a"), K.norm_id("manager_id").alias("b"))
    return graphs.simple_cycles(h, "a", "b", 4).select(F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT upper(trim(employee_id)) AS a, upper(trim(closest_employee_id)) AS b FROM graph_components WHERE employee_id IS NOT NULL AND closest_employee_id IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT a AS node, min(b) AS component FROM r GROUP BY a""")
def r03_components(lake: Lake) -> DataFrame:
    """R-03: components of the candidate pairs of an earlier run, named by their smallest member."""
    pairs = lake.graph_components.select(K.norm_id("employee_id").alias("a"), K.norm_id("closest_employee_id").alias("b"))
    return graphs.components(pairs, "a", "b")


@query("""WITH t AS (SELECT DISTINCT upper(trim(employee_id)) AS e, iban AS v FROM fact_bank_account WHERE iban IS NOT NULL AND employee_id IS NOT NULL), s AS (SELECT v, count(*) AS n FROM t GROUP BY v) SELECT e AS node, max(n) AS cluster_size FROM t JOIN s USING (v) GROUP BY e""")
def r07_cluster_sizes(lake: Lake) -> DataFrame:
    """R-07, FB-4: how many share an account with an employee; a hot account costs one count."""
    ties = lake.fact_bank_account.select(K.norm_id("employee_id").alias("e"), "iban")
    return graphs.cluster_sizes(ties, "e", "iban")


_CLOSE = """WITH m AS (SELECT component_id, upper(trim(employee_id)) AS e FROM graph_components WHERE component_id IS NOT NULL AND employee_id IS NOT NULL GROUP BY ALL), n AS (SELECT upper(trim(employee_id)) AS e, max(name_en_normalised) AS name FROM employee_master WHERE name_en_normalised IS NOT NULL GROUP BY 1),
p AS (SELECT a.component_id, a.e, b.e AS o, jaro_winkler_similarity(x.name, y.name) AS s FROM m a JOIN m b ON a.component_id = b.component_id AND a.e <> b.e JOIN n x ON x.e = a.e JOIN n y ON y.e = b.e)"""


@query(_CLOSE + " SELECT component_id, e AS employee_id, arg_max(o, (round(s, 9), o)) AS closest, round(max(s), 6) AS similarity FROM p GROUP BY ALL")
def r06_closest(lake: Lake) -> DataFrame:
    """R-06, F-07, UDF-01: the most similar name within a match group, ties to the greatest id.

    Every member is compared with every other, so a group of n costs n squared: match groups are
    the records of one case, and no bound on similarity prunes the way a metric would.
    """
    m = lake.graph_components.select("component_id", K.norm_id("employee_id").alias("e")).where("component_id is not null and e is not null").distinct()
    n = lake.employee_master.where("name_en_normalised is not null").groupBy(K.norm_id("employee_id").alias("e")).agg(F.max("name_en_normalised").alias("name"))
    a = m.join(n, "e")
    b = a.withColumnsRenamed({"e": "o", "name": "other"})
    pairs = a.join(b, "component_id").where("e <> o").withColumn("s", X.jaro_winkler("name", "other", boost_above=0.7))
    return pairs.groupBy("component_id", F.col("e").alias("employee_id")).agg(F.max(F.struct(F.round("s", 9).alias("s"), "o")).alias("_b")).select("component_id", "employee_id", F.col("_b.o").alias("closest"), F.round("_b.s", 6).alias("similarity"))


# Scores and their fusion

_FINDINGS = """
WITH f AS (SELECT user_id, event_type AS layer, date_trunc('month', ts) AS m, round(sum(value), 2) AS impact FROM events GROUP BY ALL),
r AS (SELECT *, cume_dist() OVER (PARTITION BY layer ORDER BY impact) * 100 AS rank FROM f WHERE impact >= 10),
o AS (SELECT user_id, layer, max(rank) AS score FROM r GROUP BY ALL)"""


def _findings(lake: Lake) -> DataFrame:
    e = lake.events.groupBy("user_id", F.col("event_type").alias("layer"), F.trunc("ts", "month").alias("m")).agg(F.round(F.sum("value"), 2).alias("impact"))
    return distribution.with_cumulative_rank(cut(e.where("impact >= 10")), "impact", "layer", "rank")


@query(_FINDINGS + """, w AS (SELECT user_id, avg(score) AS base, count(*) AS layers FROM o GROUP BY user_id)
SELECT user_id, layers, round(base + CASE WHEN layers >= 4 THEN 18 WHEN layers = 3 THEN 12 WHEN layers = 2 THEN 6 ELSE 0 END * (100 - base) / 100, 6) AS score FROM w""")
def x06_fused_score(lake: Lake) -> DataFrame:
    """X-02 to X-06, F-40, A-22: floor, rank per layer, own best rank, damped bonus for several layers."""
    own = _findings(lake).groupBy("user_id", "layer").agg(F.max("rank").alias("score"))
    w = own.groupBy("user_id").agg(F.avg("score").alias("base"), F.count("*").alias("layers"))
    bonus = F.when(F.col("layers") >= 4, 18).when(F.col("layers") == 3, 12).when(F.col("layers") == 2, 6).otherwise(0)
    return w.select("user_id", "layers", F.round(F.col("base") + bonus * (100 - F.col("base")) / 100, 6).alias("score"))


@query(_FINDINGS + """, l AS (SELECT *, max(m) OVER (PARTITION BY user_id, layer) AS last_m FROM r)
SELECT user_id, layer, count(*) AS findings, round(sum(impact), 2) AS cumulative, round(sum(CASE WHEN m = last_m THEN impact END), 2) AS monthly FROM l GROUP BY ALL""")
def x07_impact(lake: Lake) -> DataFrame:
    """X-04, X-07: findings of one subject and layer together; the monthly impact is that of the last month."""
    f = _findings(lake)
    last = F.struct("m", "impact")
    return f.groupBy("user_id", "layer").agg(F.count("*").alias("findings"), F.round(F.sum("impact"), 2).alias("cumulative"), F.max(last)["impact"].alias("monthly"))


@query(_FINDINGS + """, n AS (SELECT user_id, layer, score, row_number() OVER (PARTITION BY layer ORDER BY score DESC, user_id) AS k FROM o)
SELECT a.user_id, a.layer, list(b.user_id ORDER BY b.k) AS similar_users FROM n a JOIN n b ON a.layer = b.layer AND b.k <= 6 AND a.user_id <> b.user_id WHERE a.k <= 100 GROUP BY ALL""")
def x12_similar_cases(lake: Lake) -> DataFrame:
    """X-12, O-06: the six highest cases of a layer for each of its hundred highest, never all pairs."""
    own = _findings(lake).groupBy("user_id", "layer").agg(F.max("rank").alias("score"))
    n = windows.top_k(own, ["layer"], [F.col("score").desc(), F.col("user_id")], 100)
    b = n.where("rank <= 6").select("layer", F.col("user_id").alias("o"), F.col("rank").alias("k"))
    lists = n.join(b, "layer").where("user_id <> o").groupBy("user_id", "layer").agg(F.sort_array(F.collect_list(F.struct("k", "o"))).alias("_l"))
    return lists.select("user_id", "layer", F.col("_l.o").alias("similar_users"))


@query("""WITH x AS (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS n FROM events) SELECT event_id, round((n - 1) / ((SELECT count(*) FROM events) - 1) * 100, 8) AS pct FROM x""")
def m04_percentile_ranks(lake: Lake) -> DataFrame:
    """M-04: stable ranks of all rows by score, then id."""
    return ml.percentile_ranks(lake.events.select("event_id", "value"), "event_id", "value", "pct").select("event_id", F.round("pct", 8).alias("pct"))


@query("""WITH l AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM l) SELECT event_id, CAST(code AS int) AS code FROM events JOIN c USING (event_type)""")
def m01_ordinal(lake: Lake) -> DataFrame:
    """M-01: categories numbered in the order of their values."""
    return ml.ordinal_codes(lake.events, "event_type", "code").select("event_id", "code")


_SCALED = """WITH x AS (SELECT employee_id, CAST(base_salary AS double) AS b, CASE WHEN NOT isnan(allowance_ratio) THEN allowance_ratio END AS a FROM employee_features), m AS (SELECT median(b) AS mb, median(a) AS ma FROM x), d AS (SELECT median(abs(b - mb)) AS db, median(abs(a - ma)) AS da FROM x, m)"""


@query(_SCALED + " SELECT employee_id, round(coalesce((b - mb) / (1.4826 * db), 0), 6) AS base_salary, round(coalesce((a - ma) / (1.4826 * da), 0), 6) AS allowance_ratio FROM x, m, d")
def m03_robust_scale(lake: Lake) -> DataFrame:
    """M-02, M-03: median for what is missing, robust scale."""
    f = lake.employee_features.select("employee_id", F.col("base_salary").cast("double").alias("base_salary"), "allowance_ratio")
    return ml.robust_scale(f, ["base_salary", "allowance_ratio"]).select("employee_id", *[F.round(c, 6).alias(c) for c in ("base_salary", "allowance_ratio")])


def _matrix(lake: Lake) -> DataFrame:
    f = lake.employee_features.select("employee_id", F.col("grade").cast("double").alias("grade"), F.col("base_salary").cast("double").alias("base_salary"), F.col("allowance_total_monthly").cast("double").alias("allowance"), "allowance_ratio")
    return ml.robust_scale(f, ["grade", "base_salary", "allowance", "allowance_ratio"])


_FIELDS = ["grade", "base_salary", "allowance", "allowance_ratio"]


def _one_each(lake: Lake) -> DataFrame:
    """The scaled matrix with one row an employee and state: exact repeats count once."""
    return cut(_matrix(lake).withColumn("employee_id", K.norm_id("employee_id")).where("employee_id is not null").distinct())


@query()
def m08_isolation(lake: Lake) -> DataFrame:
    """M-08, UDF-02: an isolation forest of 300 trees over employees, and the 2.5 % most isolated; checked by tests."""
    return ml.flagged(ml.isolation_forest(_one_each(lake), "employee_id", _FIELDS), "isolation", 0.025, "anomalous")


@query()
def m09_reconstruction(lake: Lake) -> DataFrame:
    """M-09, M-11, O-07: gaps of a denoising autoencoder with their attributions and directions; checked by tests."""
    found = ml.autoencoder_gap(_one_each(lake), "employee_id", _FIELDS)
    return found.select("employee_id", "gap", F.to_json(ml.attributions("gaps", _FIELDS, signed="signed")).alias("attributions"))


@query()
def m09_principal_gap(lake: Lake) -> DataFrame:
    """M-09: the same gaps from principal components, which need no sample; checked by tests."""
    return ml.reconstruction_gap(_one_each(lake), "employee_id", _FIELDS, 2).select("employee_id", "gap")


@query()
def m10_ml_score(lake: Lake) -> DataFrame:
    """M-10: the mean of the percentile ranks of both scores, one row an employee; checked by tests."""
    m = _one_each(lake)
    forest = ml.isolation_forest(m, "employee_id", _FIELDS).groupBy("employee_id").agg(F.max("isolation").alias("isolation"))
    gap = ml.autoencoder_gap(m, "employee_id", _FIELDS).groupBy("employee_id").agg(F.max("gap").alias("gap"))
    return ml.ml_scores(forest, gap, "employee_id")


def _expected(lake: Lake):
    m = lake.employee_features.distinct().select(F.monotonically_increasing_id().alias("_row"), K.norm_id("employee_id").alias("employee_id"), F.col("grade").cast("double").alias("grade"), F.col("allowance_total_monthly").cast("double").alias("allowance"), F.col("allowance_ratio").alias("ratio"), F.col("base_salary").cast("double").alias("base_salary"))
    m = cut(ml.ordinal_codes(m.where("base_salary is not null").withColumn("ratio", F.nanvl("ratio", F.lit(None).cast("double"))).join(lake.employee_features.select(K.norm_id("employee_id").alias("employee_id"), F.lower(F.trim("job_family")).alias("family")).groupBy("employee_id").agg(F.min("family").alias("family")), "employee_id", "left"), "family", "family_code"))
    fields = ["grade", "family_code", "allowance"]
    expected, model = ml.boosted_expectation(m, "_row", fields, "base_salary")
    return m, fields, expected, model


@query()
def m05_expected_salary(lake: Lake) -> DataFrame:
    """M-05: boosted trees (300 rounds of depth 6 at rate 0.08, leaves of 40) fitted on a bounded sample, the residual of every row; checked by tests."""
    m, _, expected, _ = _expected(lake)
    return m.join(expected, "_row").select("employee_id", "expected", (F.col("base_salary") - F.col("expected")).alias("residual"))


@query("SELECT count(*) AS rows, 0 AS beyond, TRUE AS within FROM (SELECT DISTINCT * FROM employee_features) WHERE base_salary IS NOT NULL AND nullif(trim(employee_id), '') IS NOT NULL")
def m07_additivity(lake: Lake) -> DataFrame:
    """M-06, M-07: contributions by median substitution for every row, and the check that they add up to within one unit."""
    m, fields, _, model = _expected(lake)
    medians = distribution.medians(m, {c: F.col(c) for c in fields})
    explained = ml.substitutions(m, "_row", fields, model, [medians[c] or 0.0 for c in fields])
    return ml.additivity(explained, fields, 1.0).select("rows", "beyond", (F.col("largest") <= 1.0).alias("within"))


# Aggregates over time, evaluation, listings


@query("""WITH v AS (SELECT upper(trim(employee_id)) AS e, org_unit_id AS o, year(effective_from) * 12 + month(effective_from) - 1 AS f, year(least(coalesce(effective_to, DATE '2025-12-31'), DATE '2025-12-31')) * 12 + month(least(coalesce(effective_to, DATE '2025-12-31'), DATE '2025-12-31')) - 1 AS t, CAST(base_salary AS double) AS s FROM fact_assignment_history WHERE effective_from IS NOT NULL AND base_salary IS NOT NULL),
x AS (SELECT e, o, s / (t - f + 1) AS part, unnest(generate_series(f, t)) AS m FROM v WHERE t >= f),
k AS (SELECT m, o, count(DISTINCT e) AS heads, sum(part) AS exposure FROM x WHERE m BETWEEN 2025 * 12 AND 2025 * 12 + 11 GROUP BY ALL)
SELECT m AS month, o AS org_unit_id, heads, round(exposure, 2) AS exposure FROM k UNION ALL SELECT m, '*', sum(heads)::BIGINT, round(sum(exposure), 2) FROM k GROUP BY m""")
def g02_monthly_exposure(lake: Lake) -> DataFrame:
    """G-01, G-02: windows exploded to months, amounts spread evenly, totals per month."""
    end = F.to_date(F.lit("2025-12-31"))
    v = lake.fact_assignment_history.where("effective_from is not null and base_salary is not null").select(K.norm_id("employee_id").alias("e"), "org_unit_id", P.index_of_date("effective_from").alias("f"), P.index_of_date(F.least(F.coalesce("effective_to", end), end)).alias("t"), F.col("base_salary").cast("double").alias("s")).where("t >= f")
    inside = v.withColumn("part", F.col("s") / (F.col("t") - F.col("f") + 1)).where((F.col("t") >= 2025 * 12) & (F.col("f") <= 2025 * 12 + 11))
    x = inside.select("e", "org_unit_id", "part", F.explode(F.sequence(F.greatest("f", F.lit(2025 * 12)), F.least("t", F.lit(2025 * 12 + 11)))).alias("month"))
    k = x.groupBy("month", "org_unit_id").agg(F.count_distinct("e").alias("heads"), F.sum("part").alias("exposure"))
    whole = k.groupBy("month").agg(F.lit("*").alias("org_unit_id"), F.sum("heads").alias("heads"), F.sum("exposure").alias("exposure"))
    return k.unionByName(whole).withColumn("exposure", F.round("exposure", 2))


@query("""WITH t AS (SELECT DISTINCT doc_id, lower(trim(subject_code)) AS s FROM subject_labels WHERE labelled_by <> 'import' AND doc_id IS NOT NULL), f AS (SELECT DISTINCT doc_id, lower(trim(subject_code)) AS s FROM subject_labels WHERE labelled_by = 'import' AND doc_id IS NOT NULL)
SELECT coalesce(t.s, f.s) AS code, count(t.doc_id) AS labelled, count(f.doc_id) AS found, count(CASE WHEN t.doc_id IS NOT NULL AND f.doc_id IS NOT NULL THEN 1 END) AS both FROM t FULL JOIN f ON t.doc_id = f.doc_id AND t.s = f.s GROUP BY 1""")
def e01_agreement(lake: Lake) -> DataFrame:
    """E-01, E-02, E-05, K-03: findings against labels by code, with what only one side has; one full join."""
    rows = lake.subject_labels.where("doc_id is not null and labelled_by is not null").select("doc_id", F.lower(F.trim("subject_code")).alias("code"), (F.col("labelled_by") == "import").alias("imported"))
    t = rows.where("not imported").select("doc_id", "code", F.lit(1).alias("t")).distinct()
    f = rows.where("imported").select("doc_id", "code", F.lit(1).alias("f")).distinct()
    return t.join(f, ["doc_id", "code"], "full").groupBy("code").agg(F.count("t").alias("labelled"), F.count("f").alias("found"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("both"))


@query("""WITH q AS (SELECT o_orderstatus = 'F' AS good, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT n AS k, round(avg(CAST(good AS int)), 9) AS precision FROM q, (VALUES (10), (100), (1000)) v(n) WHERE k <= n GROUP BY n""")
def a24_precision_at_k(lake: Lake) -> DataFrame:
    """A-24, E-03: the share of right rows among the first k, for several k from one ordered thousand."""
    top = lake.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(1000)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")))  # a thousand rows
    sizes = F.explode(F.array(F.lit(10), F.lit(100), F.lit(1000)))
    return ranked.select("o_orderstatus", "r", sizes.alias("k")).where("r <= k").groupBy("k").agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 9).alias("precision"))


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH') AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def k01_page(lake: Lake) -> DataFrame:
    """K-01: OR within a field, AND across fields, a page of a total order."""
    kept = lake.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "O"))
    return kept.orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""WITH p AS (SELECT employee_id, CAST(sum(net) AS double) AS net FROM fact_payroll_monthly WHERE period = 202412 AND net IS NOT NULL GROUP BY ALL), c AS (SELECT employee_id, CAST(sum(net) AS double) AS net FROM fact_payroll_monthly WHERE period = 202512 AND net IS NOT NULL GROUP BY ALL)
SELECT coalesce(p.employee_id, c.employee_id) AS employee_id, CASE WHEN p.employee_id IS NULL THEN 'new' WHEN c.employee_id IS NULL THEN 'resolved' WHEN c.net > p.net THEN 'worse' ELSE 'same' END AS state FROM p FULL JOIN c USING (employee_id)""")
def k03_run_diff(lake: Lake) -> DataFrame:
    """K-03: what is new, gone or greater between two runs; one scan of both months."""
    month = lambda m, n: lake.fact_payroll_monthly.where((F.col("period") == m) & F.col("net").isNotNull()).groupBy("employee_id").agg(F.sum("net").alias(n))
    both = month(202412, "p").join(month(202512, "c"), "employee_id", "full")
    return both.select("employee_id", F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "resolved").when(F.col("c") > F.col("p"), "worse").otherwise("same").alias("state"))


@query("""WITH c AS (SELECT n_regionkey AS r, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n, count(DISTINCT o_custkey) AS heads FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT r AS region, m AS month, round(n * 1000.0 / heads, 6) AS rate, n - lag(n) OVER (PARTITION BY r ORDER BY m) AS delta FROM c""")
def k05_region_frame(lake: Lake) -> DataFrame:
    """K-04, K-05: regional rates from sums, never means of rates, and the change to the month before."""
    joined = lake.orders.join(lake.customer, F.col("o_custkey") == F.col("c_custkey")).join(lake.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    c = joined.groupBy(F.col("n_regionkey").alias("region"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("heads"))
    return c.select("region", "month", F.round(F.col("n") * 1000.0 / F.col("heads"), 6).alias("rate"), (F.col("n") - F.lag("n").over(Window.partitionBy("region").orderBy("month"))).alias("delta"))


@query("""WITH RECURSIVE s(u) AS (SELECT org_unit_id FROM dim_org_unit WHERE org_unit_id = 'OU-000001' UNION SELECT o.org_unit_id FROM dim_org_unit o JOIN s ON o.parent_org_unit_id = s.u) SELECT employee_id, org_unit_id FROM employee_master WHERE org_unit_id IN (SELECT u FROM s)""")
def k06_scoped(lake: Lake) -> DataFrame:
    """K-06: rows of the units below one unit, by a semi-join with its subtree."""
    allowed = graphs.subtree(lake.dim_org_unit, "org_unit_id", "parent_org_unit_id", "OU-000001").withColumnRenamed("node", "org_unit_id")
    return lake.employee_master.join(allowed, "org_unit_id", "left_semi").select("employee_id", "org_unit_id")


@query("""WITH p AS (SELECT employee_id, period, sum(net) AS net FROM fact_payroll_monthly GROUP BY ALL), e AS (SELECT DISTINCT employee_id FROM p)
SELECT e.employee_id, list(CAST(p.net AS double) ORDER BY c.period) AS series FROM e CROSS JOIN dim_calendar c LEFT JOIN p ON p.employee_id = e.employee_id AND p.period = c.period GROUP BY ALL""")
def x14_timeline(lake: Lake) -> DataFrame:
    """X-14, K-02: one value a calendar month and employee, months without one null."""
    p = lake.fact_payroll_monthly.groupBy("employee_id", "period").agg(F.sum("net").cast("double").alias("net"))
    grid = p.select("employee_id").distinct().crossJoin(F.broadcast(lake.dim_calendar.select("period")))  # one row a calendar month
    rows = grid.join(p, ["employee_id", "period"], "left").groupBy("employee_id").agg(F.sort_array(F.collect_list(F.struct("period", "net"))).alias("_s"))
    return rows.select("employee_id", F.col("_s.net").alias("series"))


# Checks


@query("""SELECT 'assignment' AS link, count(*) AS orphans FROM fact_assignment_history WHERE org_unit_id IS NOT NULL AND org_unit_id NOT IN (SELECT org_unit_id FROM dim_org_unit) UNION ALL SELECT 'account', count(*) FROM fact_bank_account WHERE employee_id IS NOT NULL AND employee_id NOT IN (SELECT employee_id FROM employee_master WHERE employee_id IS NOT NULL)
UNION ALL SELECT 'document', count(*) FROM documents WHERE org_unit_id IS NOT NULL AND org_unit_id NOT IN (SELECT org_unit_id FROM dim_org_unit)""")
def n09_orphans(lake: Lake) -> DataFrame:
    """N-09, J-18: links whose end is missing."""
    return integrity.orphans([
        ("assignment", lake.fact_assignment_history, "org_unit_id", lake.dim_org_unit, "org_unit_id"),
        ("account", lake.fact_bank_account, "employee_id", lake.employee_master, "employee_id"),
        ("document", lake.documents, "org_unit_id", lake.dim_org_unit, "org_unit_id"),
    ])


@query("""WITH r AS (SELECT employee_id, effective_from AS f, coalesce(effective_to, DATE '9999-12-31') AS t, lead(effective_from) OVER (PARTITION BY employee_id ORDER BY effective_from, coalesce(effective_to, DATE '9999-12-31')) AS nf FROM fact_assignment_history WHERE effective_from IS NOT NULL),
k AS (SELECT employee_id, f, CASE WHEN t < f THEN 'backwards' WHEN nf <= t THEN 'overlap' WHEN datediff('day', t, nf) > 1 THEN 'gap' END AS fault FROM r) SELECT employee_id, f AS start, fault FROM k WHERE fault IS NOT NULL""")
def n09_contiguity(lake: Lake) -> DataFrame:
    """N-09, W-04, J-16: intervals that overlap, leave gaps or run backwards."""
    return integrity.interval_faults(lake.fact_assignment_history, "employee_id", "effective_from", "effective_to")


@query("""SELECT 'gross' AS "check", count(*) FILTER (WHERE NOT coalesce(gross = base_pay + allowance_total + overtime_pay + bonus + retro_adjustment, FALSE)) AS failed FROM fact_payroll_monthly UNION ALL SELECT 'net', count(*) FILTER (WHERE NOT coalesce(net = gross - gosi_employee - loan_deduction - absence_deduction, FALSE)) FROM fact_payroll_monthly""")
def n09_arithmetic(lake: Lake) -> DataFrame:
    """N-09: sums that must come out, all in one pass."""
    c = F.col
    return integrity.failed(lake.fact_payroll_monthly, {
        "gross": c("gross") == c("base_pay") + c("allowance_total") + c("overtime_pay") + c("bonus") + c("retro_adjustment"),
        "net": c("net") == c("gross") - c("gosi_employee") - c("loan_deduction") - c("absence_deduction"),
    })


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, k""")
def st01_sessions(lake: Lake) -> DataFrame:
    """ST-01: sessions, by the function the stream uses."""
    from sarraf.streaming.events import sessions

    return sessions(lake.events, "ts", "user_id", "30 minutes")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def st01_windows(lake: Lake) -> DataFrame:
    """ST-01: tumbling windows, by the function the stream uses."""
    from sarraf.streaming.events import windowed

    return windowed(lake.events, "ts", ["event_type"], "value", "1 hour").withColumn("total", F.round("total", 4))


@query("""SELECT period, overtime_hours > 40 AS hit, CAST(overtime_pay AS double) AS impact FROM (SELECT period, CAST(50 AS double) AS overtime_hours, overtime_pay FROM fact_payroll_monthly WHERE employee_id = 'E00000011')""")
def p11_what_if(lake: Lake) -> DataFrame:
    """P-11, Q-01: one employee's rows with a value put in place, judged again."""
    one = rules.what_if(lake.fact_payroll_monthly, "employee_id", "E00000011", {"overtime_hours": 50})
    return one.select("period", (F.col("overtime_hours") > 40).alias("hit"), F.col("overtime_pay").cast("double").alias("impact"))


@query("""SELECT period, CAST(row_number() OVER (ORDER BY period) AS int) AS period_index, working_days - public_holiday_days AS net_days FROM dim_calendar""")
def w01_calendar_index(lake: Lake) -> DataFrame:
    """W-01: the calendar numbered, one row a month."""
    return lake.dim_calendar.select("period", F.row_number().over(Window.orderBy("period")).alias("period_index"), (F.col("working_days") - F.col("public_holiday_days")).alias("net_days"))


@query("""SELECT upper(trim(employee_id)) AS employee_id, list(DISTINCT lower(trim(change_reason)) ORDER BY lower(trim(change_reason))) FILTER (WHERE lower(trim(change_reason)) IN ('promotion', 'regrade')) AS raised FROM fact_assignment_history GROUP BY 1""")
def a15_filtered_sets(lake: Lake) -> DataFrame:
    """A-15: sets of part of a group, null where that part is empty."""
    r = K.norm_word("change_reason")
    found = F.sort_array(F.collect_set(F.when(r.isin("promotion", "regrade"), r)))
    return lake.fact_assignment_history.groupBy(K.norm_id("employee_id").alias("employee_id")).agg(found.alias("_r")).select("employee_id", F.when(F.size("_r") > 0, F.col("_r")).alias("raised"))


@query("""WITH m AS (SELECT DISTINCT component_id, upper(trim(employee_id)) AS e FROM graph_components WHERE component_id IS NOT NULL AND employee_id IS NOT NULL), d AS (SELECT upper(trim(employee_id)) AS e, max(dob) AS dob, max(spouse_employee_id) AS s FROM employee_master GROUP BY 1),
x AS (SELECT m.component_id, m.e, d.dob, upper(trim(d.s)) AS s FROM m LEFT JOIN d USING (e)), p AS (SELECT a.component_id, coalesce(a.s = b.e AND b.s = a.e, FALSE) AS couple, coalesce(a.dob = b.dob, FALSE) AS born FROM x a JOIN x b ON a.component_id = b.component_id AND a.e < b.e)
SELECT component_id, CASE WHEN bool_and(couple) THEN 'couple' WHEN bool_and(born) THEN 'same_birth' ELSE 'unrelated' END AS kind, count(*) AS pairs FROM p GROUP BY component_id""")
def r05_classes(lake: Lake) -> DataFrame:
    """R-05: match groups classed by what all their pairs have in common, told from counts without a pair.

    All pairs are born alike if there is one birth date and none is missing; all are couples only
    if there are two members, each the other's.
    """
    m = lake.graph_components.select("component_id", K.norm_id("employee_id").alias("e")).where("component_id is not null and e is not null").distinct()
    d = lake.employee_master.groupBy(K.norm_id("employee_id").alias("e")).agg(F.max("dob").alias("dob"), K.norm_id(F.max("spouse_employee_id")).alias("s"))
    groups = m.join(d, "e", "left").groupBy("component_id").agg(
        F.count("*").alias("n"), F.min("dob").alias("first"), F.max("dob").alias("last"), F.count("dob").alias("dated"),
        F.min(F.struct("e", "s")).alias("a"), F.max(F.struct("e", "s")).alias("b"))
    couple = F.coalesce((F.col("n") == 2) & (F.col("a.s") == F.col("b.e")) & (F.col("b.s") == F.col("a.e")), F.lit(False))
    born = F.coalesce((F.col("dated") == F.col("n")) & (F.col("first") == F.col("last")), F.lit(False))
    return groups.where("n > 1").select("component_id", F.when(couple, "couple").when(born, "same_birth").otherwise("unrelated").alias("kind"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))


@query(_FINDINGS + """, d AS (SELECT user_id, event_type AS layer, max(ts) AS dismissed_at, round(sum(value) / 40, 2) AS impact_then FROM events WHERE user_id % 5 = 0 GROUP BY ALL), s AS (SELECT user_id, layer, sum(impact) AS impact FROM r GROUP BY ALL)
SELECT s.user_id, s.layer, d.user_id IS NOT NULL AND s.impact < 1.25 * d.impact_then AS suppressed FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.layer = s.layer""")
def x09_suppression(lake: Lake) -> DataFrame:
    """X-09, ST-07: what was dismissed stays away until its impact has grown by a quarter."""
    dismissed = lake.events.where("user_id % 5 = 0").groupBy("user_id", F.col("event_type").alias("layer")).agg(F.round(F.sum("value") / 40, 2).alias("then"))
    now = _findings(lake).groupBy("user_id", "layer").agg(F.sum("impact").alias("impact"))
    back = F.col("then").isNotNull() & (F.col("impact") < 1.25 * F.col("then"))
    return now.join(dismissed, ["user_id", "layer"], "left").select("user_id", "layer", F.coalesce(back, F.lit(False)).alias("suppressed"))


@query(_FINDINGS + """, b AS (SELECT a.user_id, a.layer, o.layer AS other, o.score FROM o a JOIN o ON a.user_id = o.user_id AND a.layer <> o.layer) SELECT user_id, layer, count(*) AS others, arg_max(other, (score, other)) AS strongest FROM b GROUP BY ALL""")
def x13_corroboration(lake: Lake) -> DataFrame:
    """X-13: for a subject's finding the strongest of its other layers; a subject has one row a layer."""
    own = _findings(lake).groupBy("user_id", "layer").agg(F.max("rank").alias("score"))
    both = own.select("user_id", "layer").join(own.select("user_id", F.col("layer").alias("other"), "score"), "user_id").where("layer <> other")
    return both.groupBy("user_id", "layer").agg(F.count("*").alias("others"), F.max(F.struct("score", "other"))["other"].alias("strongest"))


@query("""WITH x AS (SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS bad, (o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.9) FROM orders))::INT AS p FROM orders) SELECT round(median(o_totalprice) FILTER (WHERE bad), 4) AS bad_median, round(median(o_totalprice) FILTER (WHERE NOT bad), 4) AS good_median, round(count(*) FILTER (WHERE bad AND p = 1) / count(*) FILTER (WHERE bad), 9) AS recall, round((count(*) FILTER (WHERE bad AND p = 1) / count(*) FILTER (WHERE p = 1)) / (count(*) FILTER (WHERE bad) / count(*)), 9) AS lift FROM x""")
def m12_separation(lake: Lake) -> DataFrame:
    """M-12: how well a score separates: medians, share of the bad in the top tenth, lift."""
    o = lake.orders.select("o_orderkey", F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").alias("bad"))
    top = o.crossJoin(F.broadcast(distribution.percentiles(o, [], "v", {"v90": 0.9}).select("v90")))  # one row
    high = F.col("v") >= F.col("v90")
    bad = F.col("bad")
    middle = distribution.medians(o, {"bad": F.when(bad, F.col("v")), "good": F.when(~bad, F.col("v"))})
    out = top.agg(F.round(F.lit(middle["bad"]), 4).alias("bad_median"), F.round(F.lit(middle["good"]), 4).alias("good_median"), (F.count_if(bad & high) / F.count_if(bad)).alias("recall"), ((F.count_if(bad & high) / F.count_if(high)) / (F.count_if(bad) / F.count("*"))).alias("lift"))
    return out.select("bad_median", "good_median", F.round("recall", 9).alias("recall"), F.round("lift", 9).alias("lift"))


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders), b AS (SELECT *, CASE WHEN place <= 50 AND o_totalprice >= 200000 THEN 'CRITICAL' WHEN place <= 250 AND o_totalprice >= 100000 THEN 'HIGH' ELSE 'LOW' END AS band FROM r)
SELECT band, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS right_ones, round(sum(o_totalprice), 2) AS total FROM b GROUP BY band""")
def e04_band_summary(lake: Lake) -> DataFrame:
    """E-04: what each band of a queue holds."""
    bands = [("CRITICAL", 50, 200000.0), ("HIGH", 200, 100000.0)]
    q = windows.capacity_bands(lake.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "o_totalprice", bands, "LOW")
    return q.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("right_ones"), F.round(F.sum("o_totalprice"), 2).alias("total"))
