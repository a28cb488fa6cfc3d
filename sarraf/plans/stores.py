"""Sources, sinks, registries and scalar families, one query each: written, read again and compared with plain SQL.

Tables are written below the shared checkpoint folder of the session, each under a name of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sarraf.functions import calendar as C
from sarraf.functions import keys as K
from sarraf.functions import periods as P
from sarraf.functions import text as X
from sarraf.functions.amounts import expected_amount
from sarraf.operators import evidence, integrity, rules
from sarraf.plans import composite, fusion
from sarraf.plans.base import Registry
from sarraf.session import cut, ensure_checkpoint_dir
from sarraf.sources import packs, store, templates
from sarraf.sources.catalog import Lake, isolated

query = Registry()


def _place(lake: Lake) -> str:
    return f"{ensure_checkpoint_dir(lake.spark)}/store-{uuid.uuid4().hex}"


_MONTHS = "SELECT employee_id, period, CAST(sum(net) AS double) AS net FROM fact_payroll_monthly WHERE employee_id IS NOT NULL GROUP BY ALL"


def _months(lake: Lake) -> DataFrame:
    return lake.fact_payroll_monthly.where("employee_id is not null").groupBy("employee_id", "period").agg(F.sum("net").cast("double").alias("net"))


# Catalog and scans


@query(f"SELECT period, count(*) AS n, round(sum(net), 2) AS net FROM ({_MONTHS}) GROUP BY period")
def s01_recursive_scan(lake: Lake) -> DataFrame:
    """S-01: nested folders read as one table of a declared schema; folder names are no columns."""
    path, rows = _place(lake), _months(lake)
    store.write_by_period(rows, path)
    read = lake.spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)
    return read.groupBy("period").agg(F.count("*").alias("n"), F.round(F.sum("net"), 2).alias("net"))


_NAMED = ("region", "nation", "customer", "orders", "employee_master", "dim_org_unit")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _NAMED))
def s02_catalog_views(lake: Lake) -> DataFrame:
    """S-02, S-04: allow-listed tables as temporary views, of those that exist."""
    views = lake.register(*[n for n in _NAMED if lake.exists(n)], prefix="lake_")
    return lake.spark.sql(" UNION ALL ".join(f"SELECT '{v.removeprefix('lake_')}' AS name, count(*) AS n FROM {v}" for v in views))


@query("SELECT 'evaluation' AS session, count(*) AS labels FROM subject_labels UNION ALL SELECT 'detection', NULL")
def s03_isolated_labels(lake: Lake) -> DataFrame:
    """S-03: labels are a view of the evaluation's session alone; the caller's session does not know it."""
    truth = isolated(lake.spark, lake.folder, ("subject_labels",), prefix="truth_")
    count = truth.spark.sql("SELECT count(*) AS n FROM truth_subject_labels").first()["n"]
    seen = count if lake.spark.catalog.tableExists("truth_subject_labels") else None
    return lake.spark.createDataFrame([("evaluation", count), ("detection", seen)], "session string, labels long")


# Written tables


@query(f"SELECT * FROM ({_MONTHS}) WHERE period BETWEEN 202401 AND 202412")
def s06_month_partitions(lake: Lake) -> DataFrame:
    """S-06, S-08: month partitions in files of bounded rows, the month kept as a column; a range of months prunes folders (the range is the feature)."""
    path = _place(lake)
    store.write_by_period(_months(lake), path, rows_per_file=100_000)
    return store.read_by_period(lake.spark, path, 202401, 202412).select("employee_id", "period", "net")


@query(f"SELECT employee_id, period, CASE WHEN period IN (202406, 202407) THEN net * 2 ELSE net END AS net FROM ({_MONTHS})")
def s07_replaced_months(lake: Lake) -> DataFrame:
    """S-07: two months written anew, all others left as they are."""
    path = _place(lake)
    store.write_by_period(_months(lake), path)
    again = _months(lake).where(F.col("period").isin(202406, 202407)).withColumn("net", F.col("net") * 2)
    store.write_by_period(again, path)
    return store.read_by_period(lake.spark, path).select("employee_id", "period", "net")


_HITS = composite.query.sql["p05_rules"]


@query(f"SELECT employee_id, code, 'rules' AS layer, period_from, period_to, months, round(cumulative, 2) AS impact FROM ({_HITS})")
def s11_findings_table(lake: Lake) -> DataFrame:
    """S-11: findings in their declared schema, written and read again."""
    path = _place(lake)
    found = rules.run_rules(composite._DEMO_RULES, lake.fact_payroll_monthly, "employee_id", "period").withColumnsRenamed({"monthly": "impact_monthly", "cumulative": "impact_cumulative"})
    evidence.conform(found.withColumn("layer", F.lit("rules")), evidence.FINDING).write.parquet(path)
    return evidence.read_conforming(lake.spark, path, evidence.FINDING).select("employee_id", "code", "layer", "period_from", "period_to", "months", F.round("impact_cumulative", 2).alias("impact"))


@query(fusion._SCORED + " SELECT user_id, layer, score, FALSE AS dismissed FROM sc")
def s12_scores_and_dismissals(lake: Lake) -> DataFrame:
    """S-12: scores written and read again; dismissals that were never written are an empty table."""
    path = _place(lake)
    fusion._scored(lake).write.parquet(f"{path}/scores")
    dismissed = evidence.read_conforming(lake.spark, f"{path}/dismissals", evidence.DISMISSAL).select(F.col("employee_id").cast("long").alias("user_id"), F.col("code").alias("layer"), F.lit(True).alias("d"))
    return lake.spark.read.parquet(f"{path}/scores").join(dismissed, ["user_id", "layer"], "left").select("user_id", "layer", "score", F.coalesce("d", F.lit(False)).alias("dismissed"))


@query("SELECT o.org_unit_id, o.business_line, count(m.employee_id) AS people FROM dim_org_unit o LEFT JOIN employee_master m USING (org_unit_id) GROUP BY ALL")
def s13_arrow_exchange(lake: Lake) -> DataFrame:
    """S-13: a fixed dimension fetched as an Arrow table and handed back to the engine."""
    table = lake.dim_org_unit.select("org_unit_id", "business_line").toArrow()
    units = lake.spark.createDataFrame(table)
    heads = lake.employee_master.groupBy("org_unit_id").agg(F.count("employee_id").alias("people"))
    return units.join(heads, "org_unit_id", "left").select("org_unit_id", "business_line", F.coalesce("people", F.lit(0)).alias("people"))


@query("SELECT v.label, count(*) AS orders FROM orders JOIN (VALUES ('1-URGENT', 'now'), ('2-HIGH', 'now'), ('5-LOW', 'later')) v(p, label) ON o_orderpriority = v.p GROUP BY v.label")
def s14_literal_rows(lake: Lake) -> DataFrame:
    """S-14: literal rows as a table of declared types, joined."""
    rows = lake.spark.createDataFrame([("1-URGENT", "now"), ("2-HIGH", "now"), ("5-LOW", "later")], "p string, label string")
    return lake.orders.join(rows, F.col("o_orderpriority") == F.col("p")).groupBy("label").agg(F.count("*").alias("orders"))


@query("SELECT 'first' AS key, CAST(min(period) AS varchar) AS value FROM dim_calendar UNION ALL SELECT 'last', CAST(max(period) AS varchar) FROM dim_calendar UNION ALL SELECT 'units', CAST(count(*) AS varchar) FROM dim_org_unit")
def s15_manifest(lake: Lake) -> DataFrame:
    """S-15: a JSON manifest of a run written and read again."""
    path = f"{_place(lake)}.json"
    span = lake.dim_calendar.agg(F.min("period"), F.max("period")).first()
    store.write_json(lake.spark, path, {"first": span[0], "last": span[1], "units": lake.dim_org_unit.count()})
    return lake.spark.createDataFrame([(k, str(v)) for k, v in store.read_json(lake.spark, path).items()], "key string, value string")


@query(_HITS)
def s17_pack_rules(lake: Lake) -> DataFrame:
    """S-16, S-17: the rules of a pack file, checked when loaded, over payroll."""
    found = rules.run_rules(packs.load_rules(packs.BUILT_IN, lake.fact_payroll_monthly), lake.fact_payroll_monthly, "employee_id", "period")
    return found.select("employee_id", "code", "period_from", "period_to", "months", F.round("monthly", 2).alias("monthly"), F.round("cumulative", 2).alias("cumulative"))


@query("SELECT employee_id, count(*) AS n, min(effective_from) AS since FROM fact_assignment_history WHERE employee_id IN ('E00000011', 'E00000042', 'E00000077') GROUP BY employee_id")
def s18_keyed_lookup(lake: Lake) -> DataFrame:
    """S-18: a copy ordered by key, so that a look-up (the feature) reads few row groups."""
    rows = store.keyed_copy(lake.fact_assignment_history, _place(lake), "employee_id")
    return rows.where(F.col("employee_id").isin("E00000011", "E00000042", "E00000077")).groupBy("employee_id").agg(F.count("*").alias("n"), F.min("effective_from").alias("since"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END AS status, o_totalprice FROM orders WHERE o_totalprice >= 1000 UNION ALL SELECT -1 - c_custkey, 'N', NULL FROM customer WHERE c_acctbal < 0""")
def s19_edits(lake: Lake) -> DataFrame:
    """S-19: keys dropped, cells patched, rows appended."""
    o = lake.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    dropped = lake.orders.where("o_totalprice < 1000")
    patches = lake.orders.where("o_orderpriority = '5-LOW'").select("o_orderkey", F.lit("X").alias("status"))
    added = lake.customer.where("c_acctbal < 0").select((-1 - F.col("c_custkey")).cast(o.schema["o_orderkey"].dataType).alias("o_orderkey"), F.lit("N").alias("status"))
    return store.merge_edits(o, ["o_orderkey"], dropped, patches, added)


@query("""SELECT '| ' || r_name || ' | ' || CAST(count(*) AS varchar) || ' |' AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT '# Report' UNION ALL SELECT '## Nations' UNION ALL SELECT '| region | nations |' UNION ALL SELECT '|-|-|'""")
def s20_report(lake: Lake) -> DataFrame:
    """S-20: a Markdown report of small tables, as its lines."""
    nations = lake.nation.join(lake.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations")).orderBy("region")
    lines = [x for x in store.markdown("Report", {"Nations": nations}).split("\n") if x]
    return lake.spark.createDataFrame([(x,) for x in lines], "line string")


_SCRIPT = """
-- orders per status; a semicolon here ends nothing
CREATE TEMP TABLE by_status_$run AS SELECT o_orderstatus, count(*) AS n FROM $orders GROUP BY o_orderstatus;
SELECT concat(o_orderstatus, ';') AS status, n FROM by_status_$run WHERE n >= $least
"""


@query("SELECT o_orderstatus || ';' AS status, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10")
def s10_script(lake: Lake) -> DataFrame:
    """S-09, S-10: a script filled in (a place without value is an error), cut into statements and run."""
    (orders,) = lake.register("orders", prefix="script_")
    return templates.run_script(lake.spark, _SCRIPT, {"run": uuid.uuid4().hex, "orders": orders, "least": "10"})


# Increments, caches, registries


@query("SELECT DISTINCT period FROM fact_payroll_monthly WHERE period IN (202406, 202407)")
def st02_stale_months(lake: Lake) -> DataFrame:
    """ST-02: the months whose files have changed since the signatures were taken."""
    path = _place(lake)
    store.write_by_period(_months(lake), path)
    before = store.signatures(lake.spark, path)
    store.write_by_period(_months(lake).where(F.col("period").isin(202406, 202407)), path)
    stale = store.stale(store.signatures(lake.spark, path), before)
    return lake.spark.createDataFrame([(int(s.partition("=")[2]),) for s in stale], "period int")


@query("SELECT period, count(*) AS n, 1 AS builds FROM fact_payroll_monthly GROUP BY period")
def st03_cached_stage(lake: Lake) -> DataFrame:
    """ST-03: a stage asked for twice with the same inputs is built once."""
    path, builds = _place(lake), []

    def build() -> DataFrame:
        builds.append(1)
        return lake.fact_payroll_monthly.groupBy("period").agg(F.count("*").alias("n"))

    for _ in range(2):
        table = store.cached_stage(lake.spark, path, "months", {"table": "fact_payroll_monthly", "version": 1}, build)
    return table.withColumn("builds", F.lit(len(builds)))


@query("""WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation WHERE n_regionkey IN (0, 1)), b AS (SELECT n_name, row_number() OVER (ORDER BY n_name) + (SELECT count(*) FROM a) AS k FROM nation WHERE n_regionkey NOT IN (0, 1)) SELECT n_name, 'ALT-' || lpad(CAST(k AS varchar), 6, '0') AS id FROM a UNION ALL SELECT n_name, 'ALT-' || lpad(CAST(k AS varchar), 6, '0') FROM b""")
def st06_sticky_ids(lake: Lake) -> DataFrame:
    """ST-06: a second run keeps the ids of the first and numbers new keys on from the last."""
    empty = lake.spark.createDataFrame([], "n_name string, number long, id string")
    first = cut(store.register_ids(empty, lake.nation.where(F.col("n_regionkey").isin(0, 1)), ["n_name"]))
    return store.register_ids(first, lake.nation, ["n_name"]).select("n_name", "id")


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus AS state, 1 AS version FROM orders) SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'done' ELSE o_orderstatus END AS state, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS version, o_orderpriority = '2-HIGH' AS rejected FROM orders""")
def k07_dispositions(lake: Lake) -> DataFrame:
    """K-07: dispositions against a version: those made on the current one hold, those on another are rejected."""
    current = lake.orders.select("o_orderkey", F.col("o_orderstatus").alias("state"), F.lit(1).alias("version"))
    urgent = lake.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit(1).alias("based_on"), F.lit("done").alias("state"))
    outdated = lake.orders.where("o_orderpriority = '2-HIGH'").select("o_orderkey", F.lit(0).alias("based_on"), F.lit("done").alias("state"))
    after, rejected = store.apply_versions(current, urgent.unionByName(outdated), "o_orderkey", "state")
    return after.join(rejected.select("o_orderkey", F.lit(True).alias("r")), "o_orderkey", "left").select("o_orderkey", "state", "version", F.coalesce("r", F.lit(False)).alias("rejected"))


# Checks


@query("""SELECT 'payment_method' AS field, count(*) FILTER (WHERE payment_method IS NOT NULL AND payment_method NOT IN ('bank_transfer', 'cash', 'cheque')) AS outside FROM employee_master UNION ALL SELECT 'gender', count(*) FILTER (WHERE gender IS NOT NULL AND gender NOT IN ('M', 'F')) FROM employee_master UNION ALL SELECT 'nationality_class', count(*) FILTER (WHERE nationality_class IS NOT NULL AND nationality_class NOT IN ('saudi', 'gcc', 'expat')) FROM employee_master""")
def n09_enumerations(lake: Lake) -> DataFrame:
    """N-09: values outside their enumeration, all fields in one pass."""
    return integrity.outside(lake.employee_master, {"payment_method": ["bank_transfer", "cash", "cheque"], "gender": ["M", "F"], "nationality_class": ["saudi", "gcc", "expat"]})


@query("SELECT 'employee_master' AS name, (SELECT count(*) FROM employee_master) AS n, (SELECT count(DISTINCT employee_id) FROM employee_master) AS ids UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(DISTINCT o_orderkey) FROM orders)")
def n09_counts(lake: Lake) -> DataFrame:
    """N-09: rows and different keys of tables."""
    part = lambda n, key: lake.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.count_distinct(key).alias("ids"))
    return part("employee_master", "employee_id").unionByName(part("orders", "o_orderkey"))


@query("SELECT 'orders' AS name, TRUE AS equal, TRUE AS differs_after_edit UNION ALL SELECT 'fact_bank_account', TRUE, TRUE")
def n11_determinism(lake: Lake) -> DataFrame:
    """N-11: a digest that does not depend on how rows are dealt, and tells a table with one more row."""
    found = []
    for name in ("orders", "fact_bank_account"):
        t = lake.table(name)
        digest = store.row_digest(t)
        found.append((name, digest == store.row_digest(t.repartition(7)), digest != store.row_digest(t.unionByName(t.limit(1)))))
    return lake.spark.createDataFrame(found, "name string, equal boolean, differs_after_edit boolean")


_SECOND = {
    "Q01": "overtime_hours = overtime_hours AND NOT isnan(overtime_hours) AND overtime_hours - 40 > 0 AND (paid_flag OR paid_flag IS NULL)",
    "Q02": "sign(absence_deduction) = 1",
}


@query(f"""WITH h AS ({_HITS}), a AS (SELECT code, employee_id, sum(months) AS months FROM h GROUP BY ALL) SELECT code, count(*) AS agreed, 0 AS only_first, 0 AS only_second FROM a GROUP BY code""")
def n10_second_opinion(lake: Lake) -> DataFrame:
    """N-10: each rule against a predicate of its own wording, over different months of an employee: what both, one or the other find."""
    p = lake.fact_payroll_monthly
    first = rules.run_rules(composite._DEMO_RULES, p, "employee_id", "period").groupBy("code", "employee_id").agg(F.sum("months").alias("first"))
    tags = F.array_compact(F.array(*[F.when(F.expr(x), c) for c, x in _SECOND.items()]))
    second = p.select("employee_id", "period", F.explode(tags).alias("code")).distinct().groupBy("code", "employee_id").agg(F.count("*").alias("second"))
    both = first.join(second, ["code", "employee_id"], "full")
    return both.groupBy("code").agg(F.count_if(F.col("first") == F.col("second")).alias("agreed"), F.count_if(F.coalesce(F.col("first") > F.col("second"), F.col("second").isNull())).alias("only_first"), F.count_if(F.coalesce(F.col("second") > F.col("first"), F.col("first").isNull())).alias("only_second"))


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM fact_payroll_monthly LIMIT 0)")
def o09_schema_probe(lake: Lake) -> DataFrame:
    """O-09: the columns of a table, without reading rows."""
    return lake.spark.createDataFrame([(f.name,) for f in lake.fact_payroll_monthly.schema], "name string")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY md5(CAST(l_orderkey AS varchar) || ':' || CAST(l_linenumber AS varchar) || ':7'), l_orderkey, l_linenumber LIMIT 1000")
def o10_stable_sample(lake: Lake) -> DataFrame:
    """O-10: a sample of a thousand rows that is the same however the rows are stored; the sample is the feature."""
    order = F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit("7")))
    return lake.lineitem.orderBy(order, "l_orderkey", "l_linenumber").limit(1000).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE substr(md5('sample:' || CAST(o_orderkey AS varchar)), 1, 2) < '1a'")
def o11_share_sample(lake: Lake) -> DataFrame:
    """O-11: a tenth of the rows, each in or out by its own hash; no sort, and the sample is the feature."""
    return lake.orders.select("o_orderkey").where(F.substring(F.md5(F.concat(F.lit("sample:"), F.col("o_orderkey").cast("string"))), 1, 2) < "1a")


@query("""WITH m AS (SELECT DISTINCT employee_id AS e, as_of_period AS p, CAST(base_salary AS double) / 10000 AS a, coalesce(allowance_ratio, 0) AS b, CAST(allowance_total_monthly AS double) / 10000 AS c FROM employee_features WHERE base_salary IS NOT NULL AND allowance_total_monthly IS NOT NULL AND NOT isnan(coalesce(allowance_ratio, 0))),
l AS (SELECT e, p, a, b, c, unnest([{'name': 'base', 'v': a}, {'name': 'ratio', 'v': b}, {'name': 'total', 'v': c}]) AS x FROM m) SELECT e AS employee_id, p AS period, list(x.name ORDER BY abs(x.v) DESC, x.name)[1:2] AS top FROM l WHERE abs(x.v) >= 0.2 GROUP BY e, p, a, b, c""")
def o07_top_contributions(lake: Lake) -> DataFrame:
    """O-07: the two largest contributions of a row that reach a floor, by an array sorted in place."""
    ratio = F.coalesce("allowance_ratio", F.lit(0.0))
    f = lake.employee_features.where(F.col("base_salary").isNotNull() & F.col("allowance_total_monthly").isNotNull() & ~F.isnan(ratio))
    parts = {"base": F.col("base_salary").cast("double") / 10000, "ratio": ratio, "total": F.col("allowance_total_monthly").cast("double") / 10000}
    sized = F.array(*[F.struct((-F.abs(v)).alias("order"), F.lit(n).alias("name")) for n, v in parts.items()])
    top = F.transform(F.slice(F.array_sort(F.filter(sized, lambda s: s["order"] <= -0.2)), 1, 2), lambda s: s["name"])
    rows = f.select(F.col("employee_id"), F.col("as_of_period").alias("period"), *[v.alias(f"_{n}") for n, v in parts.items()], top.alias("top")).where("size(top) > 0")
    return rows.groupBy("employee_id", "period", *[f"_{n}" for n in parts]).agg(F.min("top").alias("top"), F.count("*").alias("_n")).select("employee_id", "period", "top")


# Scalar families


@query("""SELECT employee_id, trim(regexp_replace(upper(strip_accents(name_en)), '[^A-Z]+', ' ', 'g')) AS key FROM employee_master WHERE name_en IS NOT NULL""")
def f11_name_keys(lake: Lake) -> DataFrame:
    """F-11: plain name keys, A to Z and single blanks."""
    return lake.employee_master.where("name_en is not null").select("employee_id", X.latin_keys("name_en").alias("key"))


@query(r"""SELECT payroll_run_id AS run, regexp_matches(payroll_run_id, '^[RS]\d{6}-\d+$') AS regular, nullif(regexp_extract(payroll_run_id, '^([A-Z])(\d{6})', 2), '') AS month, count(*) AS n FROM fact_payroll_monthly GROUP BY ALL""")
def f12_patterns(lake: Lake) -> DataFrame:
    """F-12: patterns tested and taken apart, over the different values."""
    runs = lake.fact_payroll_monthly.groupBy(F.col("payroll_run_id").alias("run")).agg(F.count("*").alias("n"))
    return runs.select("run", F.col("run").rlike(r"^[RS]\d{6}-\d+$").alias("regular"), F.nullif(F.regexp_extract("run", r"^([A-Z])(\d{6})", 2), F.lit("")).alias("month"), "n")


@query("""WITH d AS (SELECT period, make_date(period // 100, period % 100, 1) AS f FROM dim_calendar), a AS (SELECT *, datediff('day', DATE '1970-01-01', f) + 2440588 - 1948440 + 10632 AS l0 FROM d), b AS (SELECT *, (l0 - 1) // 10631 AS n FROM a), c AS (SELECT *, l0 - 10631 * n + 354 AS l1 FROM b), e AS (SELECT *, ((10985 - l1) // 5316) * ((50 * l1) // 17719) + (l1 // 5670) * ((43 * l1) // 15238) AS j FROM c),
g AS (SELECT *, l1 - ((30 - j) // 15) * ((17719 * j) // 50) - (j // 16) * ((15238 * j) // 43) + 29 AS l2 FROM e), h AS (SELECT *, (24 * l2) // 709 AS m FROM g)
SELECT period, CAST(30 * n + j - 30 AS int) AS hijri_year, CAST(m AS int) AS hijri_month, CAST(l2 - (709 * m) // 24 AS int) AS hijri_day, CAST(len(list_filter(generate_series(f, last_day(f), INTERVAL 1 DAY), lambda x: dayofweek(x) NOT IN (5, 6))) AS int) AS working_days FROM h""")
def f25_calendar(lake: Lake) -> DataFrame:
    """F-25: the Islamic date of each month's first day, and its days outside the weekend."""
    first = P.first_day("period")
    y, m, d = C.hijri(first)
    return lake.dim_calendar.select("period", y.alias("hijri_year"), m.alias("hijri_month"), d.alias("hijri_day"), C.working_days(first, F.last_day(first)).alias("working_days"))


@query("""WITH h AS (SELECT DISTINCT org_unit_id AS o, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(org_unit_id)) AS h FROM dim_org_unit) SELECT o AS org_unit_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def f35_named_ids(lake: Lake) -> DataFrame:
    """F-35: name-based ids of version 5."""
    return lake.dim_org_unit.select("org_unit_id").distinct().select("org_unit_id", C.named_uuid(F.col("org_unit_id")).alias("id"))


_CORNERS = [(10.0, 20.0), (220.0, 5.0), (150.0, 80.0), (260.0, 140.0), (40.0, 130.0), (90.0, 70.0)]
_EDGES = ", ".join(f"({i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, (a, b) in enumerate(zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]])))


@query(f"""SELECT event_id, count(*) FILTER (WHERE (y1 > user_id) <> (y2 > user_id) AND value < (user_id - y1) * ((x2 - x1) / (y2 - y1)) + x1) % 2 = 1 AS inside FROM events, (VALUES {_EDGES}) v(i, x1, y1, x2, y2) GROUP BY event_id""")
def f37_inside_polygon(lake: Lake) -> DataFrame:
    """F-37: points in a polygon by crossings of a ray, as one expression."""
    return lake.events.select("event_id", C.inside_polygon(F.col("value"), F.col("user_id").cast("double"), _CORNERS).alias("inside"))


@query("""SELECT employee_id, CASE WHEN dependents_count IS NOT NULL THEN CAST(300 * least(dependents_count, 4) AS double) END AS fixed, CASE WHEN base_salary IS NOT NULL THEN CAST(least(round(base_salary * 0.25, 2), 4000) AS double) END AS share, CAST(CASE WHEN grade IS NULL THEN NULL ELSE CASE grade WHEN 5 THEN 500 WHEN 10 THEN 1000 WHEN 15 THEN 1500.50 ELSE 0 END END AS double) AS by_level FROM employee_master""")
def f38_declared_amounts(lake: Lake) -> DataFrame:
    """F-38: amounts by declared kind: fixed by head up to a number, a capped share of a base, a table of levels."""
    fixed = expected_amount("fixed", amount=300, count=F.col("dependents_count"), most=4)
    share = expected_amount("share_of_base", share="0.25", base=F.col("base_salary"), most=4000)
    level = expected_amount("by_level", level=F.col("grade"), table={5: 500, 10: 1000, 15: "1500.50"})
    return lake.employee_master.select("employee_id", *[c.cast("double").alias(n) for n, c in (("fixed", fixed), ("share", share), ("by_level", level))])


_U = "('0x' || substr(md5('grade:' || CAST(c_custkey AS varchar)), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT c_custkey, round({_U}, 9) AS u, CASE WHEN {_U} < 0.5 THEN 'low' WHEN {_U} < 0.8 THEN 'middle' ELSE 'high' END AS choice FROM customer")
def n01_random_streams(lake: Lake) -> DataFrame:
    """N-01: named random streams keyed by row, and a weighted choice; neither order nor other draws matter."""
    u = C.stream_value("grade", F.col("c_custkey"))
    return lake.customer.select("c_custkey", F.round(u, 9).alias("u"), C.weighted_choice(u, {"low": 5, "middle": 3, "high": 2}).alias("choice"))
