"""Fusion of findings of several layers into scored, banded and numbered alerts, and their evaluation.

Event types of the events table stand for layers; their weights are parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarraf.functions import keys as K
from sarraf.operators import evidence, rules, windows
from sarraf.plans import composite, features
from sarraf.plans.base import Registry
from sarraf.session import cut
from sarraf.sources import store
from sarraf.sources.catalog import Lake

query = Registry()

#: Weight of each layer, the floor of a rule hit, the least score of an unsupervised layer, the bonus by number of layers.
WEIGHTS = {"rules": 1.00, "peer_stats": 0.45, "ml_unsupervised": 0.35, "graph": 0.60}
FLOOR, ML_LEAST, BONUS = 78, 90, {2: 6, 3: 12, 4: 18}
#: Floors of the bands; the limits are those of a small queue.
BANDS = [("CRITICAL", 20, 88.0), ("HIGH", 120, 72.0), ("MEDIUM", None, 55.0)]
EXPIRES_AFTER, RESURFACE = 6, 1.25

_LAYER = {"purchase": "rules", "error": "peer_stats", "view": "ml_unsupervised", "click": "graph"}
_LAYER_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{y}'" for e, y in _LAYER.items()) + " END"
_SPLIT = f"""WITH f AS (SELECT user_id, {_LAYER_SQL} AS layer, date_trunc('week', ts)::DATE AS m, round(sum(value), 2) AS impact FROM events WHERE {_LAYER_SQL} IS NOT NULL GROUP BY ALL),
r AS (SELECT *, cume_dist() OVER (PARTITION BY layer ORDER BY impact) * 100 AS rank FROM f WHERE impact >= 10)"""
_OWN = _SPLIT + """, o AS (SELECT user_id, layer, max(rank) AS score, round(sum(impact), 2) AS impact FROM r GROUP BY ALL)"""
_WEIGHT = "CASE {0} " + " ".join(f"WHEN '{y}' THEN {w}" for y, w in WEIGHTS.items()) + " END"
_SCORED = _OWN + f""", c AS (SELECT a.user_id, a.layer, a.impact, b.layer AS other, b.score, {_WEIGHT.format('b.layer')} AS w FROM o a JOIN o b ON a.user_id = b.user_id WHERE b.layer = a.layer OR b.layer <> 'ml_unsupervised' OR b.score >= {ML_LEAST}),
g AS (SELECT user_id, layer, max(impact) AS impact, count(*) AS layers, sum(w * score) / sum(w) AS mean, bool_or(other = 'rules') AS ruled FROM c GROUP BY user_id, layer),
b AS (SELECT *, CASE WHEN ruled THEN greatest(mean, {FLOOR}) ELSE mean END AS base FROM g),
sc AS (SELECT user_id, layer, impact, layers, round_even(base + CASE layers WHEN 4 THEN 18 WHEN 3 THEN 12 WHEN 2 THEN 6 ELSE 0 END * (100 - base) / 100, 0) AS score FROM b)"""
_DISMISSED = _SCORED + f""", d AS (SELECT user_id, {_LAYER_SQL} AS layer, CAST(user_id % 9 AS int) AS runs_since, round(sum(value) * 0.9, 2) AS was FROM events WHERE {_LAYER_SQL} IS NOT NULL AND user_id % 4 = 0 GROUP BY ALL),
su AS (SELECT sc.*, coalesce(d.runs_since < {EXPIRES_AFTER} AND NOT sc.impact > {RESURFACE} * d.was, FALSE) AS suppressed FROM sc LEFT JOIN d ON d.user_id = sc.user_id AND d.layer = sc.layer)"""
_BANDED = _DISMISSED + """, q AS (SELECT *, CASE WHEN suppressed THEN 0 ELSE 1 END AS takes FROM su), w AS (SELECT *, sum(takes) OVER (ORDER BY score DESC, impact DESC, user_id, layer ROWS UNBOUNDED PRECEDING) - takes AS before FROM q),
t AS (SELECT least(20, sum(takes) FILTER (WHERE score >= 88)) AS c, sum(takes) FILTER (WHERE score >= 72) AS h FROM w),
bd AS (SELECT w.*, CASE WHEN score >= 88 AND before < 20 THEN 'CRITICAL' WHEN score >= 72 AND before - coalesce(t.c, 0) < 120 THEN 'HIGH' WHEN score >= 55 THEN 'MEDIUM' ELSE 'WATCHLIST' END AS band FROM w, t)"""


def _layers(lake: Lake) -> DataFrame:
    """X-01: each layer's findings as an input of its own, marked with its layer."""
    parts = None
    for kind, layer in _LAYER.items():
        one = lake.events.where(F.col("event_type") == kind).groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("m")).agg(F.round(F.sum("value"), 2).alias("impact")).withColumn("layer", F.lit(layer))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def _ranked(lake: Lake) -> DataFrame:
    from sarraf.operators import distribution

    return distribution.with_cumulative_rank(cut(_layers(lake).where("impact >= 10")), "impact", "layer", "rank")


def _scored(lake: Lake) -> DataFrame:
    own = cut(_ranked(lake).groupBy("user_id", "layer").agg(F.max("rank").alias("score"), F.round(F.sum("impact"), 2).alias("impact")))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("other"))
    others = own.select("user_id", F.col("layer").alias("other"), "score")  # at most one row a layer
    both = own.select("user_id", "layer", "impact").join(others, "user_id").where((F.col("other") == F.col("layer")) | (F.col("other") != "ml_unsupervised") | (F.col("score") >= ML_LEAST))
    g = both.groupBy("user_id", "layer").agg(F.max("impact").alias("impact"), F.count("*").alias("layers"), (F.sum(weight * F.col("score")) / F.sum(weight)).alias("mean"), F.bool_or(F.col("other") == "rules").alias("ruled"))
    base = F.when(F.col("ruled"), F.greatest(F.col("mean"), F.lit(float(FLOOR)))).otherwise(F.col("mean"))
    bonus = F.lit(0)
    for layers, more in BONUS.items():
        bonus = F.when(F.col("layers") == layers, more).otherwise(bonus)
    return g.withColumn("_b", base).select("user_id", "layer", "impact", "layers", F.bround(F.col("_b") + bonus * (100 - F.col("_b")) / 100, 0).alias("score"))


def _dismissals(lake: Lake) -> DataFrame:
    e = lake.events.where("user_id % 4 = 0")  # what reviewers have dismissed: the tables hold no dismissals
    layer = F.element_at(F.create_map(*[F.lit(x) for pair in _LAYER.items() for x in pair]), F.col("event_type"))
    return e.withColumn("layer", layer).where("layer is not null").groupBy("user_id", "layer").agg(F.round(F.sum("value") * 0.9, 2).alias("was")).withColumn("runs_since", (F.col("user_id") % 9).cast("int"))


def _suppressed(lake: Lake) -> DataFrame:
    holds = (F.col("runs_since") < EXPIRES_AFTER) & ~(F.col("impact") > RESURFACE * F.col("was"))
    return _scored(lake).join(_dismissals(lake), ["user_id", "layer"], "left").withColumn("suppressed", F.coalesce(holds, F.lit(False))).drop("was", "runs_since")


def _banded(lake: Lake) -> DataFrame:
    order = [F.col("score").desc(), F.col("impact").desc(), F.col("user_id"), F.col("layer")]
    return windows.capacity_bands(_suppressed(lake), order, "score", BANDS, "WATCHLIST", ~F.col("suppressed"))


@query(_SPLIT + " SELECT layer, count(*) AS findings, count(DISTINCT user_id) AS subjects, round(sum(impact), 2) AS impact FROM f GROUP BY layer")
def x01_layer_split(lake: Lake) -> DataFrame:
    """X-01: findings by layer, each layer an input of its own."""
    return _layers(lake).groupBy("layer").agg(F.count("*").alias("findings"), F.count_distinct("user_id").alias("subjects"), F.round(F.sum("impact"), 2).alias("impact"))


@query(_SCORED + " SELECT user_id, layer, layers, score FROM sc")
def x06_weighted_score(lake: Lake) -> DataFrame:
    """X-02 to X-06, F-40: weighted mean over the layers that count, floor of rule hits, damped bonus, rounded half to even."""
    return _scored(lake).select("user_id", "layer", "layers", "score")


@query(_DISMISSED + " SELECT user_id, layer, suppressed FROM su")
def x09_expiring_suppression(lake: Lake) -> DataFrame:
    """X-09, ST-07: a dismissal holds for six runs and until the impact has grown by more than a quarter."""
    return _suppressed(lake).select("user_id", "layer", "suppressed")


@query(_BANDED + " SELECT user_id, layer, score, suppressed, band FROM bd")
def x10_queue_bands(lake: Lake) -> DataFrame:
    """X-10, O-04: bands of limited size with floors; suppressed rows take no slot, what a band leaves free goes on."""
    return _banded(lake).select("user_id", "layer", "score", "suppressed", "band")


@query(_BANDED + " SELECT band, count(*) AS n, count(*) FILTER (WHERE suppressed) AS suppressed, min(score) AS threshold FROM bd GROUP BY band")
def x10_thresholds(lake: Lake) -> DataFrame:
    """X-10: the thresholds that the queue has come to, as recorded with a run."""
    return _banded(lake).groupBy("band").agg(F.count("*").alias("n"), F.count_if("suppressed").alias("suppressed"), F.min("score").alias("threshold"))


@query(_BANDED + """, i AS (SELECT *, row_number() OVER (ORDER BY user_id, layer) AS k, row_number() OVER (PARTITION BY band ORDER BY impact DESC, score DESC, user_id, layer) AS n FROM bd) SELECT 'ALT-' || lpad(CAST(k AS varchar), 6, '0') AS alert_id, user_id, layer, band, n AS rank_in_band FROM i""")
def x11_alert_order(lake: Lake) -> DataFrame:
    """X-11, W-16, ST-06, O-05: sticky ids in the order of keys, and the rank of each alert in its band."""
    banded = cut(_banded(lake))
    empty = banded.sparkSession.createDataFrame([], "user_id long, layer string, number long, id string")
    ids = store.register_ids(empty, banded.select(F.col("user_id").cast("long").alias("user_id"), "layer"), ["user_id", "layer"])
    order = [F.col("impact").desc(), F.col("score").desc(), F.col("user_id"), F.col("layer")]
    ranked = windows.rank_within(banded, "band", order, "rank_in_band")
    return ranked.join(ids.select("user_id", "layer", F.col("id").alias("alert_id")), ["user_id", "layer"]).select("alert_id", "user_id", "layer", "band", "rank_in_band")


@query(_BANDED + """ SELECT user_id, layer, to_json(struct_pack(subject := 'U' || user_id, layer := layer, band := band, score := CAST(score AS int), impact_cents := CAST(round(impact * 100) AS bigint), suppressed := suppressed))::VARCHAR AS bundle FROM bd""")
def x15_bundles(lake: Lake) -> DataFrame:
    """X-15, F-33: one checked JSON bundle an alert; a bundle with a missing or unknown value raises."""
    b = _banded(lake)
    parts = {"subject": F.concat(F.lit("U"), F.col("user_id").cast("string")), "layer": F.col("layer"), "band": F.col("band"), "score": F.col("score").cast("int"), "impact_cents": F.round(F.col("impact") * 100).cast("long"), "suppressed": F.col("suppressed")}
    wrong = evidence.faults(parts, {"band": (F.col("band"), [*[n for n, _, _ in BANDS], "WATCHLIST"]), "layer": (F.col("layer"), list(WEIGHTS))})
    return b.select("user_id", "layer", evidence.checked(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])), wrong).alias("bundle"))


_HITS = composite.query.sql["p05_rules"]
_TRUTH = """lb AS (SELECT employee_id, 'Q01' AS code, min(period) AS f, max(period) AS t FROM fact_payroll_monthly WHERE overtime_hours > 50 AND NOT isnan(overtime_hours) GROUP BY employee_id UNION ALL SELECT employee_id, 'Q02', min(period), max(period) FROM fact_payroll_monthly WHERE absence_deduction > 500 GROUP BY employee_id)"""


@query(f"""WITH hits AS ({_HITS}), {_TRUTH}, j AS (SELECT h.*, l.employee_id AS le, h.period_from <= l.t AND h.period_to >= l.f AS meets FROM hits h LEFT JOIN lb l ON l.employee_id = h.employee_id AND l.code = h.code), a AS (SELECT code, count(*) AS raised, count(le) AS right_windows, count(DISTINCT le) AS found, count(DISTINCT CASE WHEN meets THEN le END) AS in_window FROM j GROUP BY code),
n AS (SELECT code, count(*) AS labelled FROM lb GROUP BY code) SELECT code, raised, right_windows, found, in_window, labelled, round(found / labelled, 9) AS recall, round(right_windows / raised, 9) AS precision, round(in_window / nullif(found, 0), 9) AS window_agreement FROM a JOIN n USING (code)""")
def e01_window_agreement(lake: Lake) -> DataFrame:
    """E-01: recall over subjects, precision over windows, and how many found subjects are found at the right time."""
    hits = rules.run_rules(composite._DEMO_RULES, lake.fact_payroll_monthly, "employee_id", "period")
    p = lake.fact_payroll_monthly
    marks = F.array_compact(F.array(F.when((F.col("overtime_hours") > 50) & ~F.isnan("overtime_hours"), "Q01"), F.when(F.col("absence_deduction") > 500, "Q02")))
    labels = cut(p.select("employee_id", "period", F.explode(marks).alias("code")).groupBy("employee_id", "code").agg(F.min("period").alias("f"), F.max("period").alias("t"), F.lit(True).alias("known")))
    meets = F.col("known") & (F.col("period_from") <= F.col("t")) & (F.col("period_to") >= F.col("f"))
    # One row a subject and code first, so that distinct subjects are counted without a distinct.
    each = hits.join(labels, ["employee_id", "code"], "left").groupBy("employee_id", "code").agg(F.count("*").alias("n"), F.count("known").alias("right"), F.coalesce(F.bool_or(meets), F.lit(False)).alias("met"))
    found = each.groupBy("code").agg(F.sum("n").alias("raised"), F.sum("right").alias("right_windows"), F.count_if(F.col("right") > 0).alias("found"), F.count_if("met").alias("in_window"))
    both = found.join(labels.groupBy("code").agg(F.count("*").alias("labelled")), "code")
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 9)
    return both.select("code", "raised", "right_windows", "found", "in_window", "labelled", share("found", "labelled").alias("recall"), share("right_windows", "raised").alias("precision"), share("in_window", "found").alias("window_agreement"))


@query(f"""WITH {features._MASTER}, {features._MONTHS}, l AS (SELECT e, count(*) AS months, max(period) AS last_period, round(sum(net), 2) AS net FROM pm GROUP BY e), mv AS (SELECT {features._ID('employee_id')} AS e, count(DISTINCT effective_from) AS moves FROM fact_assignment_history WHERE effective_from IS NOT NULL GROUP BY 1),
ac AS (SELECT {features._ID('employee_id')} AS e, count(DISTINCT iban) AS accounts FROM fact_bank_account GROUP BY 1), hits AS ({_HITS}), fi AS (SELECT {features._ID('employee_id')} AS e, count(*) AS findings FROM hits GROUP BY 1)
SELECT m.e AS employee_id, m.grade, m.org_unit_id, coalesce(l.months, 0) AS months, l.last_period, l.net, coalesce(mv.moves, 0) AS moves, coalesce(ac.accounts, 0) AS accounts, coalesce(fi.findings, 0) AS findings FROM m LEFT JOIN l ON l.e = m.e LEFT JOIN mv ON mv.e = m.e LEFT JOIN ac ON ac.e = m.e LEFT JOIN fi ON fi.e = m.e""")
def k02_employee_360(lake: Lake) -> DataFrame:
    """K-02: one row an employee from master, pay, moves, accounts and findings, each aggregated before it is joined."""
    m = lake.employee_master.withColumn("e", K.norm_id("employee_id")).where("e is not null")
    people = windows.latest_row(m.select("e", *features._LATEST), ["e"], list(features._LATEST)).select("e", "grade", "org_unit_id")
    pay = features.pay_months(lake).groupBy("e").agg(F.count("*").alias("months"), F.max("period").alias("last_period"), F.round(F.sum("net"), 2).alias("net"))
    moves = lake.fact_assignment_history.where("effective_from is not null").groupBy(K.norm_id("employee_id").alias("e")).agg(F.count_distinct("effective_from").alias("moves"))
    accounts = lake.fact_bank_account.groupBy(K.norm_id("employee_id").alias("e")).agg(F.count_distinct("iban").alias("accounts"))
    found = rules.run_rules(composite._DEMO_RULES, lake.fact_payroll_monthly, "employee_id", "period").groupBy(K.norm_id("employee_id").alias("e")).agg(F.count("*").alias("findings"))
    for part in (pay, moves, accounts, found):
        people = people.join(part, "e", "left")
    none = F.lit(0).cast("long")
    return people.select(F.col("e").alias("employee_id"), "grade", "org_unit_id", *[F.coalesce(c, none).alias(c) if c not in ("last_period", "net") else F.col(c) for c in ("months", "last_period", "net", "moves", "accounts", "findings")])
