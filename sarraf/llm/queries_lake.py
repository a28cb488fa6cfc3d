"""The queries of problems 2 and 7 and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarraf.functions.keys import bare_code, iban_ok, national_id_ok, norm_id, norm_word
from sarraf.llm import components, quantiles
from sarraf.sources.catalog import Lake


def _ties(lake: Lake) -> DataFrame:
    who = norm_id("employee_id").alias("employee_id")
    iban, nid = bare_code("iban").alias("bare"), bare_code("national_id").alias("bare")
    tie = lambda rows, kind, ok: rows.select("employee_id", F.when(ok("bare"), F.concat(F.lit(f"{kind}:"), "bare")).alias("tie"))
    banks = tie(lake.fact_bank_account.select(who, iban), "iban", iban_ok)
    people = tie(lake.employee_master.select(who, nid), "id", national_id_ok)
    earlier = lake.graph_components.select(who, F.concat(F.lit("component:"), norm_word("component_id")).alias("tie"))
    return banks.unionByName(people).unionByName(earlier)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every employee tied to another by IBAN, national id or earlier component."""
    return components.connected_groups(_ties(Lake(spark, folder)), "employee_id", "tie")


def _feature_counts(lake: Lake) -> tuple[DataFrame, DataFrame]:
    rows = lake.employee_features.distinct().select(norm_id("employee_id").alias("employee_id"), norm_word("job_family").alias("job_family"), F.col("grade").cast("int").alias("grade"), F.inline(F.array(
        F.struct(F.lit("base_salary").alias("field"), F.col("base_salary").cast("double").alias("value")),
        F.struct(F.lit("allowance_ratio").alias("field"), F.col("allowance_ratio").alias("value")),
    )))
    return rows, quantiles.value_counts(rows, ["field", "job_family", "grade"], "value")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Salaries over twice the median, ratios over twice the 90th percentile, of their group."""
    rows, counts = _feature_counts(Lake(spark, folder))
    limits = quantiles.percentiles(counts, ["field", "job_family", "grade"], [0.5, 0.9])
    limits = limits.where((F.col("field") == "base_salary") == (F.col("fraction") == 0.5))
    limits = limits.select(F.col("field").alias("f"), F.col("job_family").alias("j"), F.col("grade").alias("g"), F.round(F.col("percentile") * 2, 8).alias("most"))
    same = F.col("field").eqNullSafe(F.col("f")) & F.col("job_family").eqNullSafe(F.col("j")) & F.col("grade").eqNullSafe(F.col("g"))
    values = rows.where("value is not null and not isnan(value) and employee_id is not null")
    return values.join(limits, same).where("value > most").select("employee_id", "field").distinct()


def p7_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Five percentiles of salary and allowance ratio for each job family and grade."""
    _, counts = _feature_counts(Lake(spark, folder))
    found = quantiles.percentiles(counts, ["field", "job_family", "grade"], [0.1, 0.25, 0.5, 0.9, 0.99])
    return found.select("field", "job_family", "grade", "fraction", "n", F.round("percentile", 6).alias("percentile"))


QUERIES = {f.__name__: f for f in (p2_found, p7_found, p7_percentiles)}

_ID = r"nullif(upper(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_BARE = r"regexp_replace(upper(translate({0}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')), '[\s\x{{00A0}}\-\x{{2010}}-\x{{2015}}]+', '', 'g')"
_MOD97 = """(list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(substr({0}, 5) || substr({0}, 1, 4), ''),
  lambda ch: CASE WHEN ascii(ch) < 58 THEN ch ELSE CAST(ascii(ch) - 55 AS varchar) END), ''), ''), lambda ch: CAST(ch AS int))), lambda r, ch: (r * 10 + ch) % 97) = 1)"""
_DOUBLED = " + ".join(f"list_sum(list_transform(string_split(CAST(2 * CAST(substr(k, {i}, 1) AS int) AS varchar), ''), lambda ch: CAST(ch AS int)))" for i in (1, 3, 5, 7, 9))
_PLAIN = " + ".join(f"CAST(substr(k, {i}, 1) AS int)" for i in (2, 4, 6, 8, 10))

_FIELDS = """
WITH d AS (SELECT DISTINCT * FROM employee_features
), f AS (
  SELECT 'base_salary' AS field, {0} AS e, lower(regexp_replace(job_family, '^\\s+|\\s+$', '', 'g')) AS job_family, CAST(grade AS int) AS grade, CAST(base_salary AS double) AS v FROM d
  UNION ALL SELECT 'allowance_ratio', {0}, lower(regexp_replace(job_family, '^\\s+|\\s+$', '', 'g')), CAST(grade AS int), allowance_ratio FROM d
), ok AS (SELECT * FROM f WHERE v IS NOT NULL AND NOT isnan(v))""".format(_ID.format("employee_id"))

SQL = {
    "p2_found": f"""
WITH RECURSIVE ib AS (
  SELECT DISTINCT {_ID.format('employee_id')} AS e, {_BARE.format('iban')} AS k FROM fact_bank_account
), ni AS (
  SELECT DISTINCT {_ID.format('employee_id')} AS e, {_BARE.format('national_id')} AS k FROM employee_master
), t AS (
  SELECT e, 'iban:' || k AS k FROM ib WHERE CASE WHEN regexp_full_match(k, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{4,30}}') THEN {_MOD97.format('k')} ELSE false END
  UNION SELECT e, 'id:' || k FROM ni WHERE CASE WHEN regexp_full_match(k, '1[0-9]{{9}}') THEN ({_DOUBLED} + {_PLAIN}) % 10 = 0 ELSE false END
  UNION SELECT {_ID.format('employee_id')}, 'component:' || lower(trim(component_id)) FROM graph_components WHERE component_id IS NOT NULL
), ties AS (SELECT * FROM t WHERE e IS NOT NULL
), reach(a, b) AS (
  SELECT DISTINCT e, e FROM ties
  UNION SELECT r.a, y.e FROM reach r JOIN ties x ON x.e = r.b JOIN ties y ON y.k = x.k
)
SELECT a AS employee_id, min(b) AS group_id FROM reach GROUP BY a HAVING count(*) > 1""",
    "p7_found": _FIELDS + """
, lim AS (SELECT field, job_family, grade, round(2 * quantile_cont(v, 0.5), 8) AS most FROM ok WHERE field = 'base_salary' GROUP BY ALL UNION ALL SELECT field, job_family, grade, round(2 * quantile_cont(v, 0.9), 8) FROM ok WHERE field = 'allowance_ratio' GROUP BY ALL)
SELECT DISTINCT ok.e AS employee_id, ok.field FROM ok JOIN lim ON ok.field = lim.field AND ok.job_family IS NOT DISTINCT FROM lim.job_family AND ok.grade IS NOT DISTINCT FROM lim.grade
WHERE ok.v > lim.most AND ok.e IS NOT NULL""",
    "p7_percentiles": _FIELDS + """
, x AS (SELECT field, job_family, grade, count(*) AS n, quantile_cont(v, [0.1, 0.25, 0.5, 0.9, 0.99]) AS xs FROM ok GROUP BY ALL)
SELECT field, job_family, grade, CAST(p.p AS double) AS fraction, n, round(xs[i], 6) AS percentile FROM x, (VALUES (1, 0.1), (2, 0.25), (3, 0.5), (4, 0.9), (5, 0.99)) p(i, p)""",
}
