"""Scores of single signals and the numeric severity ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bind import AS_OF, Views
from ..functions import ranks as R
from ..functions import scores as C
from ..functions import text as X
from ..operators import basic as B
from .core import RANK4, S
from .registry import query

NOW = f"TIMESTAMP '{AS_OF}'"
AGE = f"date_sub('second', created_at, {NOW}) / 3600.0"


def age(v: Views):
    return F.timestamp_diff("SECOND", F.col("created_at"), v.as_of) / F.lit(3600.0)


@query(
    "s14_risk_score",
    f"""r AS (SELECT id, CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 30 WHEN 'medium' THEN 18 WHEN 'low' THEN 8 ELSE 2 END
        + CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, reliability)) * 25 + 0.5) AS INT) + CASE WHEN source_count >= 4 THEN 20 WHEN source_count = 3 THEN 15 WHEN source_count = 2 THEN 10 ELSE 5 END
        + CASE WHEN {AGE} <= 1 THEN 15 WHEN {AGE} <= 6 THEN 12 WHEN {AGE} <= 24 THEN 8 WHEN {AGE} <= 168 THEN 4 ELSE 1 END AS score FROM signals)
    SELECT id, CAST(least(100, greatest(0, score)) AS BIGINT) AS score, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM r""",
    S,
)
def _(v: Views):
    score = C.risk(F.col("severity"), F.col("reliability"), F.col("source_count"), age(v))
    return v.signals.select("id", score.alias("score")).withColumn("level", C.risk_level(F.col("score")))


@query(
    "s15_reliability_score",
    """t AS (SELECT id, reliability + 0.02 + CASE WHEN k % 2 = 0 THEN 0.02 ELSE 0.0 END + CASE WHEN k % 5 >= 3 THEN 0.01 WHEN k % 5 = 0 THEN -0.02 ELSE 0.0 END
        + 0.0 + CASE WHEN k % 11 = 0 AND category IN ('conflict', 'security') THEN -0.10 WHEN k % 11 = 0 THEN -0.03 ELSE 0.0 END
        + CASE WHEN source_count <= 1 AND severity = 'critical' THEN -0.15 WHEN source_count <= 1 AND severity = 'high' THEN -0.08 WHEN source_count <= 1 AND severity = 'medium' THEN -0.03 ELSE 0.0 END
        + CASE WHEN source_count >= 3 THEN 0.05 WHEN source_count >= 2 THEN 0.02 ELSE 0.0 END + (k % 5 % 7) * 0.005::DOUBLE + CASE WHEN k % 2 = 0 THEN 0.01 ELSE 0.0 END + CASE WHEN k % 3 = 0 THEN -0.01 ELSE 0.0 END AS s FROM signals)
    SELECT id, round(floor(least(0.99::DOUBLE, greatest(0.05::DOUBLE, s)) * 1000 + 0.5 + 1e-7) / 1000, 3) AS score FROM t""",
    S,
)
def _(v: Views):
    k = F.col("k")
    score = C.reliability(
        F.col("reliability") + 1e-10, F.col("severity"), F.col("category"), F.lit(True), k % 2 == 0, k % 5, k % 11 == 0, F.col("source_count"), F.when(k % 3 == 0, "fr").otherwise("en")
    )
    return v.signals.select("id", F.round(score, 3).alias("score"))


CAP = "CASE WHEN source_count >= 3 THEN 4 WHEN source_count >= 2 THEN 3 WHEN category IN ('disaster', 'health', 'security') THEN 3 ELSE 2 END"


@query("s16_severity_cap", f"SELECT id, ['info', 'low', 'medium', 'high', 'critical'][1 + least({RANK4}, {CAP})] AS severity FROM signals", S)
def _(v: Views):
    return v.signals.select("id", C.capped_severity(F.col("severity"), F.col("source_count"), F.col("category")).alias("severity"))


TIER = "CASE WHEN severity = 'critical' AND (reliability >= 0.65 OR category = 'breaking') THEN 'FLASH' WHEN severity IN ('critical', 'high') OR category IN ('breaking', 'conflict', 'disaster') THEN 'PRIORITY' ELSE 'ROUTINE' END"


@query("s17_alert_tier", f"SELECT {TIER} AS tier, count(*) AS n, min(id) AS first_id FROM signals GROUP BY 1", S)
def _(v: Views):
    return v.signals.withColumn("tier", C.alert_tier(F.col("severity"), F.col("reliability"), F.col("category"))).groupBy("tier").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    "s18_corroboration",
    f"""c AS (SELECT country_code, count(DISTINCT source_id) AS sources, count(DISTINCT category) AS categories, max({RANK4}) AS rank, avg(reliability) AS rel FROM signals WHERE created_at > {NOW} - INTERVAL 1 HOUR GROUP BY country_code),
    b AS (SELECT *, least(0.07 * (sources - 1), 0.20)::DOUBLE AS base FROM c),
    d AS (SELECT *, CASE WHEN categories >= 3 THEN least(base + 0.05, 0.25) WHEN categories >= 2 THEN least(base + 0.03, 0.20) ELSE base END AS cat FROM b),
    e AS (SELECT *, CASE WHEN sources < 2 THEN 0 ELSE least(cat * CASE rank WHEN 4 THEN 1.15 WHEN 3 THEN 1.10 ELSE 1.0 END, 0.30) END AS boost FROM d)
    SELECT country_code, sources, round(boost, 6) AS boost, round(least(rel + boost, 1.0), 6) AS reliability, rel + boost >= 0.65 AS promoted FROM e""",
    S,
)
def _(v: Views):
    c = B.within_hours(v.signals, v.as_of, 1).groupBy("country_code").agg(
        F.countDistinct("source_id").alias("sources"), F.countDistinct("category").alias("categories"), F.max(R.by_severity(R.RANK_4)).alias("rank"), F.avg("reliability").alias("rel")
    )
    boosted = c.withColumn("boost", C.corroboration_boost(F.col("sources"), F.col("categories"), R.severity_of(F.col("rank"))))
    return boosted.select("country_code", "sources", F.round("boost", 6).alias("boost"), F.round(F.least(F.col("rel") + F.col("boost"), F.lit(1.0)), 6).alias("reliability"), (F.col("rel") + F.col("boost") >= 0.65).alias("promoted"))


@query("s19_virality", f"SELECT id, CASE WHEN k % 10 >= 8 THEN 'viral' WHEN k % 10 >= 3 AND {AGE} < 4 THEN 'spreading' WHEN k % 10 >= 3 THEN 'multi_source' END AS virality FROM signals", S)
def _(v: Views):
    return v.signals.select("id", C.virality(F.col("k") % 10, age(v)).alias("virality"))


@query("s7_haversine", "h AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, power(sin(radians((a.n_nationkey - b.n_nationkey) * 3) / 2), 2) + cos(radians(b.n_nationkey * 3)) * cos(radians(a.n_nationkey * 3)) * power(sin(radians((a.n_nationkey - b.n_nationkey) * 7) / 2), 2) AS h FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey) SELECT a, b, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM h".replace("h AS (", "WITH h AS (", 1))
def _(v: Views):
    n = v.table("nation").select(F.col("n_nationkey").alias("a"))
    pairs = n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(B.haversine_km(F.col("a") * 3, F.col("a") * 7, F.col("b") * 3, F.col("b") * 7), 6).alias("km"))


@query("s8_s9_decay_scores", f"SELECT id, round(CASE WHEN {AGE} <= 1 THEN 1.0 WHEN {AGE} >= 24 THEN 0.0 ELSE 1 - ({AGE} - 1) / 23 END, 6) AS temporal, round(CASE WHEN value >= 200 THEN 0.0 WHEN value <= 10 THEN 1.0 ELSE 1 - (value - 10) / 190 END, 6) AS geo FROM signals WHERE created_at > {NOW} - INTERVAL 30 HOURS", S)
def _(v: Views):
    return B.within_hours(v.signals, v.as_of, 30).select("id", F.round(C.temporal(age(v)), 6).alias("temporal"), F.round(C.geographic(F.col("value")), 6).alias("geo"))


@query("s52_bands", "SELECT id, CASE WHEN value >= 80 THEN 'Critical' WHEN value >= 60 THEN 'High' WHEN value >= 40 THEN 'Elevated' WHEN value >= 20 THEN 'Moderate' ELSE 'Low' END AS band FROM signals", S)
def _(v: Views):
    return v.signals.select("id", C.band(F.col("value")).alias("band"))


#: Numeric severity ladders of feeds: the least values that are critical, high and medium (None: never); fixed values.
LADDERS = {
    "seismic": (7.0, 6.0, 5.0), "vix": (40, 30, 25), "index_change": (6, 4, 2), "crypto_change": (None, 20, 10), "commodity_change": (None, 10, 5),
    "fire_power": (1000, 400, 100), "internet_outage": (500, 100, 30), "radiation": (1000, 350, 100), "customers_out": (500_000, 100_000, 25_000), "jamming_share": (None, 0.9, 0.7),
    "negative_goldstein": (7, 4, 0),
}
_never = 1e300


@query(
    "s39_severity_ladders",
    "f(feed, a, b, c) AS (VALUES " + ", ".join("('" + k + "', " + ", ".join(f"{_never if x is None else float(x)}::DOUBLE" for x in v) + ")" for k, v in LADDERS.items()) + "), w AS (SELECT (value - 20) / s AS x FROM signals, (VALUES (1.0::DOUBLE), (20.0), (0.001)) t(s))"
    " SELECT feed, CASE WHEN x >= a THEN 'critical' WHEN x >= b THEN 'high' WHEN x >= c THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM w, f GROUP BY 1, 2",
    S,
)
def _(v: Views):
    """One rule table for all feeds, sent to the executors as literals; values are tried on three scales."""
    bounds = [F.struct(F.lit(k).alias("feed"), *[F.lit(_never if x is None else float(x)).alias(n) for n, x in zip("abc", steps)]) for k, steps in LADDERS.items()]
    scale = F.explode(F.array(F.lit(1.0), F.lit(20.0), F.lit(0.001)))
    x = v.signals.select("value", scale.alias("s")).select(((F.col("value") - 20) / F.col("s")).alias("x"), F.explode(F.array(*bounds)).alias("r"))
    level = F.when(F.col("x") >= F.col("r.a"), "critical").when(F.col("x") >= F.col("r.b"), "high").when(F.col("x") >= F.col("r.c"), "medium").otherwise("low")
    return x.groupBy("r.feed", level.alias("level")).agg(F.count("*").alias("n"))


#: Labels and categories of the event root codes 1 to 20; fixed values.
CAMEO = [
    ("Public statement", "geopolitics"), ("Appeal", "geopolitics"), ("Intent to cooperate", "geopolitics"), ("Consultation", "geopolitics"), ("Diplomatic cooperation", "geopolitics"),
    ("Material cooperation", "economy"), ("Humanitarian aid", "other"), ("Concession", "geopolitics"), ("Investigation", "security"), ("Demand", "conflict"),
    ("Disapproval", "geopolitics"), ("Rejection", "geopolitics"), ("Threat", "conflict"), ("Protest", "elections"), ("Military show of force", "conflict"),
    ("Diplomatic reduction", "geopolitics"), ("Coercion", "conflict"), ("Assault", "conflict"), ("Armed conflict", "conflict"), ("Mass atrocity", "conflict"),
]


@query("s40_code_labels", "m(code, label, category) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(CAMEO)) + ") SELECT label, m.category, count(*) AS n FROM signals JOIN m ON k % 20 = code GROUP BY 1, 2", S)
def _(v: Views):
    entry = F.element_at(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("category")) for a, b in CAMEO]), (F.col("k") % 20 + 1).cast("int"))
    return v.signals.select(entry.alias("e")).groupBy("e.label", "e.category").agg(F.count("*").alias("n"))


@query("s41_jamming", "SELECT id, CASE WHEN value >= 110 THEN 'spoofing' WHEN value >= 60 THEN 'jamming' ELSE 'interference' END AS kind, CASE WHEN severity = 'critical' THEN 300 WHEN severity = 'high' THEN 200 WHEN severity = 'medium' THEN 120 ELSE 60 END AS radius_km, round(least(0.95, 0.5 + 0.1 * source_count), 6) AS confidence FROM signals", S)
def _(v: Views):
    kind = R.ladder(F.col("value"), [(110, "spoofing"), (60, "jamming")], "interference")
    radius = F.when(F.col("severity") == "critical", 300).when(F.col("severity") == "high", 200).when(F.col("severity") == "medium", 120).otherwise(60)
    return v.signals.select("id", kind.alias("kind"), radius.alias("radius_km"), F.round(F.least(F.lit(0.95), 0.5 + 0.1 * F.col("source_count")), 6).alias("confidence"))


@query("s46_formatters", "SELECT id, CASE WHEN value > 35 THEN 'up' WHEN value < 35 THEN 'down' ELSE 'flat' END AS direction, printf('%.2f', value) AS shown FROM signals", S)
def _(v: Views):
    direction = F.when(F.col("value") > 35, "up").when(F.col("value") < 35, "down").otherwise("flat")
    return v.signals.select("id", direction.alias("direction"), F.format_string("%.2f", "value").alias("shown"))


@query("s53_best_market", "SELECT user_id, arg_max(id, (value, id)) AS market_id, least(1.0, greatest(0.0, round(max(value) / 200, 6))) AS probability FROM signals GROUP BY user_id", S)
def _(v: Views):
    return v.signals.groupBy("user_id").agg(F.max_by("id", F.struct("value", "id")).alias("market_id"), R.clamp(F.round(F.max("value") / 200, 6), 0.0, 1.0).alias("probability"))


@query("s54_attribution", "SELECT country_code, 'Based on ' || len(s) || ' sources: ' || array_to_string(s[1:3], ', ') || CASE WHEN len(s) > 3 THEN ' and ' || (len(s) - 3) || ' more' ELSE '' END AS line FROM (SELECT country_code, list_sort(list(DISTINCT source_id)) AS s FROM signals GROUP BY country_code)", S)
def _(v: Views):
    return v.signals.groupBy("country_code").agg(F.array_sort(F.collect_set("source_id")).alias("s")).select("country_code", X.attribution("s", 3).alias("line"))


@query("s56_dots", "SELECT id, repeat('*', CAST(floor(reliability * 5 + 0.5) AS INT)) AS dots FROM signals", S)
def _(v: Views):
    return v.signals.select("id", F.repeat(F.lit("*"), R.js_round(F.col("reliability") * 5).cast("int")).alias("dots"))


@query("s57_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS doc FROM events")
def _(v: Views):
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query("s58_array_functions", "SELECT user_id, list_sort(list(id))[1:3] AS firsts, array_to_string(list_sort(list(DISTINCT country_code)), '|') AS countries, len(list(id)) AS n FROM signals GROUP BY user_id", S)
def _(v: Views):
    return v.signals.groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 3).alias("firsts"), F.concat_ws("|", F.array_sort(F.collect_set("country_code"))).alias("countries"), F.count("id").alias("n"))


@query("k7_lifecycle_a", f"SELECT country_code, CASE WHEN date_sub('second', max(created_at), {NOW}) / 3600.0 > 168 THEN 'resolved' WHEN count(*) FILTER (created_at > {NOW} - INTERVAL 6 HOURS) >= 5 THEN 'escalating' WHEN date_sub('second', max(created_at), {NOW}) / 3600.0 > 12 THEN 'stable' ELSE 'developing' END AS state FROM signals GROUP BY country_code", S)
def _(v: Views):
    quiet = F.timestamp_diff("SECOND", F.max("created_at"), v.as_of) / F.lit(3600.0)
    recent = F.count_if(F.col("created_at") > R.hours_before(v.as_of, 6))
    return v.signals.groupBy("country_code").agg(F.when(quiet > 168, "resolved").when(recent >= 5, "escalating").when(quiet > 12, "stable").otherwise("developing").alias("state"))
