"""Filters, counts, time series, top-k and pagination over signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bind import AS_OF, Views
from ..functions import ranks as R
from ..operators import basic as B
from .registry import query

S = "signals"
NOW = f"TIMESTAMP '{AS_OF}'"
RANK4 = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query("f1_equality_filters", "SELECT id, category, severity FROM signals WHERE category IN ('security', 'conflict') AND severity = 'high' AND country_code = 'C3' AND status = 'verified'", S)
def _(v: Views):
    return B.filter_list(v.signals, category=["security", "conflict"], severity=["high"], country_code=["C3"], status=["verified"]).select("id", "category", "severity")


@query("f2_time_window", f"SELECT id, created_at FROM signals WHERE created_at > {NOW} - INTERVAL 24 HOURS", S)
def _(v: Views):
    return B.within_hours(v.signals, v.as_of, 24).select("id", "created_at")


@query("f3_bbox", "SELECT id, lat, lng FROM signals WHERE lng > -20 AND lng < 60 AND lat > 0 AND lat < 55.5", S)
def _(v: Views):
    return B.in_box(v.signals, -20, 0, 60, 55.5).select("id", "lat", "lng")


DIST = "2 * 6371 * atan2(sqrt(h), sqrt(1 - h))"
HAV = "power(sin(radians({la} - {lb}) / 2), 2) + cos(radians({lb})) * cos(radians({la})) * power(sin(radians({oa} - {ob}) / 2), 2)"


@query(
    "f4_radius",
    f"hav AS (SELECT id, {HAV.format(la='lat', lb='20.0', oa='lng', ob='30.0')} AS h FROM signals) SELECT id, round({DIST}, 3) AS km FROM hav WHERE {DIST} <= 2500",
    S,
)
def _(v: Views):
    return B.within_km(v.signals, 20.0, 30.0, 2500).select("id", F.round("km", 3).alias("km"))


@query("f5_valid_coordinates", "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM signals WHERE isfinite(lat) AND isfinite(lng) AND abs(lat) <= 90 AND abs(lng) <= 180 AND NOT (lat = 0 AND lng = 0)", S)
def _(v: Views):
    return v.signals.filter(B.valid_coordinates()).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("f6_array_filters", "SELECT id FROM signals WHERE list_contains(tags, 'k3') AND list_has_any(tags, ['u1', 'u2']) AND list_has_all(tags, ['error', 'k3'])", S)
def _(v: Views):
    return v.signals.filter(F.array_contains("tags", "k3") & B.overlaps("tags", ["u1", "u2"]) & B.contains_all("tags", ["error", "k3"])).select("id")


@query("f7_keyword_filter", "SELECT id FROM signals WHERE title ILIKE '%place7%' OR title ILIKE '%UNIT4%'", S)
def _(v: Views):
    return v.signals.filter(B.any_keyword("title", ["place7", "UNIT4"])).select("id")


@query("f8_minimum_severity", f"SELECT id, severity FROM signals WHERE {RANK4} >= 3", S)
def _(v: Views):
    return v.signals.filter(R.by_severity(R.RANK_4) >= 3).select("id", "severity")


@query("f9_nullity", "SELECT doc_id FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x WHERE quality IS NULL")
def _(v: Views):
    return v.table("documents").select("doc_id").join(v.table("labels").select("doc_id", "quality"), "doc_id", "left").filter("quality is null").select("doc_id")


@query("f10_anti_filters", "SELECT id FROM signals WHERE category NOT IN ('health', 'economy') AND user_id NOT IN (SELECT user_id FROM events WHERE value > 180)", S)
def _(v: Views):
    loud = v.table("events").filter("value > 180").select("user_id").distinct()
    return v.signals.filter(~F.col("category").isin("health", "economy")).join(loud, "user_id", "left_anti").select("id")


@query("f11_virtual_category", "SELECT severity, count(*) AS n FROM signals WHERE severity IN ('critical', 'high') GROUP BY severity", S)
def _(v: Views):
    return v.signals.filter(B.category_filter("breaking")).groupBy("severity").agg(F.count("*").alias("n"))


F12_SQL = """SELECT id FROM signals WHERE category NOT IN ('culture', 'sports', 'other') AND (
    severity = 'critical' AND reliability >= 0.55 AND source_count >= 3 OR severity = 'critical' AND reliability >= 0.70 AND category IN ('disaster', 'health', 'security', 'conflict')
    OR severity = 'high' AND reliability >= 0.55 AND source_count >= 2 OR severity = 'high' AND reliability >= 0.70 AND category IN ('conflict', 'security', 'disaster', 'health')
    OR severity = 'medium' AND reliability >= 0.75 AND category IN ('conflict', 'security', 'disaster', 'health', 'economy'))"""


@query("f12_quality_gate", F12_SQL, S)
def _(v: Views):
    return v.signals.filter(B.quality_gate()).select("id")


@query("f13_emit_filter", "SELECT id, value FROM signals WHERE value <= 30 AND user_id % 2 = 0 ORDER BY value, id LIMIT 50", S)
def _(v: Views):
    return v.signals.filter("value <= 30 and user_id % 2 = 0").orderBy("value", "id").limit(50).select("id", "value")


@query(
    "f14_market_guard",
    "SELECT id FROM signals WHERE CASE category WHEN 'economy' THEN abs(value - 35) >= 60 WHEN 'security' THEN abs(value - 35) >= 40 WHEN 'health' THEN abs(value - 35) >= 80 ELSE abs(value - 35) >= 100 END",
    S,
)
def _(v: Views):
    return v.signals.filter(B.emit_guard(F.abs(F.col("value") - 35), {"economy": 60, "security": 40, "health": 80}, 100)).select("id")


@query(
    "f15_suspicious",
    f"SELECT id, severity, reliability FROM signals WHERE severity IN ('critical', 'high') AND (reliability < 0.6 OR source_count < 2) AND created_at > {NOW} - INTERVAL 48 HOURS ORDER BY reliability, id LIMIT 10",
    S,
)
def _(v: Views):
    return B.suspicious(B.within_hours(v.signals, v.as_of, 48)).select("id", "severity", "reliability")


RULES = [
    ("r1", "high", ["security", "conflict"], [], [], 60, "2024-01-30 23:30:00"),
    ("r2", "medium", [], ["C1", "C2", "C3"], ["place4"], 30, None),
    ("r3", "low", ["health"], [], ["unit5", "unit6"], 1440, "2024-01-30 01:00:00"),
    ("r4", "critical", [], [], [], 15, "2024-01-30 23:50:00"),
]
RULES_DDL = "rule_id string, min_severity string, categories array<string>, country_codes array<string>, keywords array<string>, cooldown int, last_at string"
RULES_SQL = """rules AS (SELECT * FROM (VALUES
    ('r1', 3, ['security', 'conflict'], []::VARCHAR[], []::VARCHAR[], 60, TIMESTAMP '2024-01-30 23:30:00'),
    ('r2', 2, []::VARCHAR[], ['C1', 'C2', 'C3'], ['place4'], 30, NULL),
    ('r3', 1, ['health'], []::VARCHAR[], ['unit5', 'unit6'], 1440, TIMESTAMP '2024-01-30 01:00:00'),
    ('r4', 4, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], 15, TIMESTAMP '2024-01-30 23:50:00')
) t(rule_id, min_rank, categories, country_codes, keywords, cooldown, last_at))"""
MATCH = f"""{RANK4} >= min_rank AND (len(categories) = 0 OR list_contains(categories, category)) AND (len(country_codes) = 0 OR list_contains(country_codes, country_code))
    AND (len(keywords) = 0 OR len(list_filter(keywords, lambda w: contains(lower(title), lower(w)))) > 0)"""


@query("f16_alert_rule_match", f"{RULES_SQL} SELECT rule_id, id FROM rules JOIN signals ON {MATCH}", S)
def _(v: Views):
    return B.match_rules(v.signals, v.spark.createDataFrame(RULES, RULES_DDL)).select("rule_id", "id")


@query(
    "f17_subscription_match",
    f"{RULES_SQL}, s AS (SELECT *, nullif(country_code, 'C1') AS cc, title || ' ' || category AS hay FROM signals) SELECT rule_id, count(*) AS n FROM rules JOIN s ON {RANK4} >= min_rank AND (len(categories) = 0 OR list_contains(categories, category)) AND (len(country_codes) = 0 OR cc IS NULL OR list_contains(country_codes, cc)) AND (len(keywords) = 0 OR len(list_filter(keywords, lambda w: contains(lower(hay), lower(w)))) > 0) GROUP BY rule_id",
    S,
)
def _(v: Views):
    s = v.signals.withColumn("country_code", F.nullif("country_code", F.lit("C1"))).withColumn("title", F.concat_ws(" ", "title", "category"))
    return B.match_rules(s, v.spark.createDataFrame(RULES, RULES_DDL), null_country_passes=True).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("f18_cooldown", f"{RULES_SQL} SELECT rule_id, last_at IS NOT NULL AND last_at + to_minutes(cooldown) > {NOW} AS cooling FROM rules", S)
def _(v: Views):
    rules = v.spark.createDataFrame(RULES, RULES_DDL).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))
    return rules.select("rule_id", B.cooling(v.as_of).alias("cooling"))


@query("f19_composite", "SELECT id FROM signals WHERE category IN ('security', 'conflict', 'disaster', 'economy') AND list_has_any(tags, ['k1', 'k2', 'k5']) OR (category = 'health' AND severity = 'critical')", S)
def _(v: Views):
    sea = F.col("category").isin("security", "conflict", "disaster", "economy") & B.overlaps("tags", ["k1", "k2", "k5"])
    return v.signals.filter(sea | ((F.col("category") == "health") & (F.col("severity") == "critical"))).select("id")


@query("f21_sanitise", "SELECT doc_id, substr(trim(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')), 1, 500) AS clean FROM documents")
def _(v: Views):
    return v.table("documents").select("doc_id", B.sanitise(F.col("text"), 500).alias("clean"))


F22 = [r"(?i)\bunion\s+select\b", r"(?i)\bdrop\s+table\b", r"(?i)<script", r"(?i)javascript:", r"(?i)\bon(?:error|load)\s*="]


@query("f22_attack_patterns", "SELECT page_id, " + " OR ".join(f"regexp_matches(html, '{p}')" for p in F22) + " AS attack FROM pages")
def _(v: Views):
    return v.table("pages").select("page_id", B.matches_any("html", F22).alias("attack"))


@query("a1_category_breakdown", "SELECT category, count(*) AS n FROM signals GROUP BY category", S)
def _(v: Views):
    return B.count_by(v.signals, "category")


@query("a1_severity_counts", "SELECT severity, status, count(*) AS n FROM signals GROUP BY severity, status", S)
def _(v: Views):
    return B.count_by(v.signals, "severity", "status")


@query("a2_signal_counts", f"SELECT count(*) AS total, count(*) FILTER (created_at > {NOW} - INTERVAL 24 HOURS) AS last_24h, count(*) FILTER (created_at > {NOW} - INTERVAL 1 HOUR) AS last_1h FROM signals", S)
def _(v: Views):
    return B.window_counts(v.signals, v.as_of, {"last_24h": 24, "last_1h": 1})


@query(
    "a3_conditional_counts",
    "SELECT region, count(*) FILTER (severity IN ('critical', 'high')) AS severe, count(*) FILTER (status = 'verified') AS verified, avg(reliability) FILTER (status = 'verified') AS avg_reliability, count(DISTINCT user_id) FILTER (severity = 'critical') AS critical_users FROM (SELECT * FROM signals) GROUP BY region".replace("avg(reliability) FILTER (status = 'verified')", "round(avg(reliability) FILTER (status = 'verified'), 6)"),
    S,
)
def _(v: Views):
    verified = F.col("status") == "verified"
    return v.signals.groupBy("region").agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("severe"), F.count_if(verified).alias("verified"),
        F.round(F.avg(F.when(verified, F.col("reliability"))), 6).alias("avg_reliability"),
        F.countDistinct(F.when(F.col("severity") == "critical", F.col("user_id"))).alias("critical_users"),
    )


@query(
    "a4_volume_zero_fill",
    f"""days AS (SELECT CAST(unnest(generate_series(CAST({NOW} AS DATE) - 44, CAST({NOW} AS DATE), INTERVAL 1 DAY)) AS DATE) AS day),
    counts AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical FROM signals GROUP BY 1)
    SELECT days.day, coalesce(n, 0) AS n, coalesce(critical, 0) AS critical FROM days LEFT JOIN counts ON days.day = counts.day""",
    S,
)
def _(v: Views):
    daily = v.signals.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return B.calendar_fill(daily, v.as_of, 45)


@query("a12_mode", "c AS (SELECT category, severity, count(*) AS n FROM signals GROUP BY ALL) SELECT category, severity AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, severity) = 1", S)
def _(v: Views):
    return B.mode_by(v.signals, ["category"], "severity").withColumnRenamed("value", "mode")


@query(
    "a16_weighted_distincts",
    "SELECT category, count(DISTINCT CASE WHEN severity = 'critical' THEN country_code END) AS critical_countries, count(DISTINCT CASE WHEN severity IN ('critical', 'high') THEN user_id END) AS severe_users, count(DISTINCT country_code) AS countries FROM signals GROUP BY category",
    S,
)
def _(v: Views):
    return v.signals.groupBy("category").agg(
        F.countDistinct(F.when(F.col("severity") == "critical", F.col("country_code"))).alias("critical_countries"),
        F.countDistinct(F.when(F.col("severity").isin("critical", "high"), F.col("user_id"))).alias("severe_users"), F.countDistinct("country_code").alias("countries"),
    )


@query("a17_geo_severity", f"SELECT region, country_code, count(*) AS n, round(avg({RANK4} + 1), 6) AS severity_score FROM signals GROUP BY region, country_code HAVING count(*) >= 3", S)
def _(v: Views):
    return v.signals.groupBy("region", "country_code").agg(F.count("*").alias("n"), F.round(F.avg(R.by_severity(R.RANK_5)), 6).alias("severity_score")).filter("n >= 3")


@query("a34_score_anomaly", "SELECT reliability, count(*) AS n, list_sort(list(id))[1:5] AS ids FROM signals WHERE severity IN ('critical', 'high') GROUP BY reliability HAVING count(*) >= 5", S)
def _(v: Views):
    return v.signals.filter(F.col("severity").isin("critical", "high")).groupBy("reliability").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("id")), 1, 5).alias("ids")).filter("n >= 5")


@query(
    "a42_facets",
    "hits AS (SELECT * FROM signals WHERE title ILIKE '%place1%') SELECT CASE WHEN grouping(category) = 0 THEN 'category' ELSE 'severity' END AS facet, coalesce(category, severity) AS value, count(*) AS n FROM hits GROUP BY GROUPING SETS ((category), (severity))",
    S,
)
def _(v: Views):
    return B.facets(v.signals.filter(B.any_keyword("title", ["place1"])), ["category", "severity"])


@query("a44_heat_weight", "SELECT CAST(floor(lat) AS BIGINT) AS lat_cell, CAST(floor(lng) AS BIGINT) AS lng_cell, sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0.5 END)::DOUBLE AS heat FROM signals GROUP BY ALL", S)
def _(v: Views):
    return v.signals.groupBy(F.floor("lat").alias("lat_cell"), F.floor("lng").alias("lng_cell")).agg(F.sum(R.by_severity(R.WEIGHT_HEAT)).alias("heat"))


@query("a48_geo_coverage", "SELECT count(DISTINCT country_code) AS countries, CASE WHEN count(DISTINCT country_code) >= 20 THEN 'global' WHEN count(DISTINCT country_code) >= 5 THEN 'regional' ELSE 'sparse' END AS coverage FROM signals", S)
def _(v: Views):
    return v.signals.agg(F.countDistinct("country_code").alias("countries")).withColumn("coverage", R.ladder(F.col("countries"), [(20, "global"), (5, "regional")], "sparse"))


@query("t1_severity_order", f"SELECT id, severity, created_at FROM signals WHERE created_at > {NOW} - INTERVAL 7 DAYS ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, created_at DESC, id LIMIT 25", S)
def _(v: Views):
    return B.headlines(B.within_hours(v.signals, v.as_of, 168), 25).select("id", "severity", "created_at")


@query(
    "t2_keyset_page",
    "SELECT s.id, s.created_at, row_number() OVER (ORDER BY s.created_at DESC, s.id DESC) <= 20 AS on_page FROM signals s, (SELECT created_at AS c, id AS i FROM signals WHERE id = 500) WHERE (s.created_at, s.id) < (c, i) ORDER BY created_at DESC, id DESC LIMIT 21",
    S,
)
def _(v: Views):
    return B.keyset_page(v.signals, cursor=500, size=20).select("id", "created_at", "on_page")


@query("t3_offset_page", "SELECT id, reliability, (SELECT count(*) FROM signals) AS total FROM signals ORDER BY reliability DESC, id LIMIT 20 OFFSET 40", S)
def _(v: Views):
    return B.offset_page(v.signals, [F.desc("reliability"), F.asc("id")], 40, 20).select("id", "reliability", "total")


@query("t4_filter_then_limit", "SELECT id FROM signals WHERE severity = 'critical' AND list_contains(tags, 'k1') ORDER BY created_at DESC, id LIMIT 10", S)
def _(v: Views):
    return v.signals.filter((F.col("severity") == "critical") & F.array_contains("tags", "k1")).orderBy(F.desc("created_at"), "id").limit(10).select("id")


@query("t5_top_n_per_group", "SELECT category, id, value, row_number() OVER (PARTITION BY category ORDER BY value DESC, id) AS place FROM signals QUALIFY place <= 5", S)
def _(v: Views):
    return B.top_n(v.signals, ["category"], [F.desc("value"), F.asc("id")], 5, "place").select("category", "id", "value", "place")


@query("t6_multi_key_sort", "SELECT id, severity, reliability FROM signals ORDER BY reliability DESC, severity, value DESC, id LIMIT 30", S)
def _(v: Views):
    return v.signals.orderBy(F.desc("reliability"), "severity", F.desc("value"), "id").limit(30).select("id", "severity", "reliability")


@query("t7_tier_schedule", "SELECT source_id, tier, due FROM (SELECT source_id, CASE WHEN CAST(substr(source_id, 2) AS INT) % 3 = 0 THEN 'wire' WHEN CAST(substr(source_id, 2) AS INT) % 3 = 1 THEN 'national' ELSE 'regional' END AS tier, max(created_at) + INTERVAL 30 MINUTES <= TIMESTAMP '2024-01-31 00:00:00' AS due FROM signals GROUP BY source_id) WHERE due", S)
def _(v: Views):
    number = F.substring("source_id", 2, 9).cast("int") % 3
    tier = F.when(number == 0, "wire").when(number == 1, "national").otherwise("regional")
    seen = v.signals.groupBy("source_id").agg(F.max("created_at").alias("last_at")).withColumn("tier", tier)
    return B.due_sources(seen, v.as_of, 30).select("source_id", "tier", "due")


@query("o2_union_distinct", "SELECT count(*) AS n FROM (SELECT user_id FROM signals WHERE severity = 'critical' UNION SELECT user_id FROM signals WHERE category = 'health')", S)
def _(v: Views):
    a, b = v.signals.filter("severity = 'critical'").select("user_id"), v.signals.filter("category = 'health'").select("user_id")
    return a.union(b).distinct().agg(F.count("*").alias("n"))


@query("o4_set_similarity", "SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags))), 6) AS jaccard FROM signals a JOIN signals b ON b.id = a.id + 1", S)
def _(v: Views):
    a, b = v.signals.select(F.col("id").alias("a"), F.col("tags").alias("x")), v.signals.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("tags").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(B.jaccard("x", "y"), 6).alias("jaccard"))


@query("o5_distinct_tags", "SELECT DISTINCT unnest(tags) AS tag FROM signals", S)
def _(v: Views):
    return v.signals.select(F.explode("tags").alias("tag")).distinct()


@query("o6_new_ids", "SELECT id FROM signals WHERE severity = 'critical' EXCEPT SELECT id FROM signals WHERE status = 'verified'", S)
def _(v: Views):
    return v.signals.filter("severity = 'critical'").select("id").join(v.signals.filter("status = 'verified'").select("id"), "id", "left_anti").distinct()


@query("o7_capped_merge", "SELECT user_id, list_sort(list(DISTINCT id))[-5:] AS last_ids FROM signals GROUP BY user_id", S)
def _(v: Views):
    return v.signals.groupBy("user_id").agg(B.last_distinct("id", 5).alias("last_ids"))


@query("w1_cell_counts", "SELECT id, count(*) OVER (PARTITION BY category, severity, floor(lat / 2), floor(lng / 2)) AS n FROM signals", S)
def _(v: Views):
    cell = Window.partitionBy("category", "severity", F.floor(F.col("lat") / 2), F.floor(F.col("lng") / 2))
    return v.signals.select("id", F.count("*").over(cell).alias("n"))


@query("w15_first_seen", "SELECT title, id FROM signals QUALIFY row_number() OVER (PARTITION BY title ORDER BY created_at, id) = 1", S)
def _(v: Views):
    return B.top_n(v.signals, ["title"], [F.asc("created_at"), F.asc("id")], 1).select("title", "id")


@query("w16_latest_per_key", "SELECT source_id, arg_max(id, (created_at, id)) AS id FROM signals GROUP BY source_id", S)
def _(v: Views):
    return v.signals.groupBy("source_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("w17_decay_ranking", f"SELECT id, round((CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.4 WHEN 'low' THEN 0.15 ELSE 0.05 END + 0.1 * source_count) * power(0.5, date_sub('second', created_at, {NOW}) / 3600.0 / 4), 6) AS score FROM signals WHERE created_at > {NOW} - INTERVAL 48 HOURS ORDER BY score DESC, id LIMIT 50", S)
def _(v: Views):
    return B.decay_ranked(B.within_hours(v.signals, v.as_of, 48), v.as_of, half_life=4).orderBy(F.desc("score"), "id").limit(50).select("id", "score")


@query("w18_bucket_sort", f"SELECT id, CAST(floor(epoch(created_at) / 7200) AS BIGINT) AS bucket FROM signals ORDER BY bucket DESC, {RANK4} DESC, id LIMIT 40", S)
def _(v: Views):
    return v.signals.withColumn("bucket", F.floor(B.epoch("created_at") / 7200)).orderBy(F.desc("bucket"), R.by_severity(R.RANK_4).desc(), "id").limit(40).select("id", "bucket")


@query("s47_time_buckets", "SELECT time_bucket(INTERVAL 6 HOURS, created_at, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n FROM signals GROUP BY 1", S)
def _(v: Views):
    return v.signals.groupBy(B.time_bucket("created_at", 21600).alias("bucket")).agg(F.count("*").alias("n"))


@query("g3_timeline", "b AS (SELECT id, created_at, time_bucket(INTERVAL 6 HOURS, created_at, TIMESTAMP '1970-01-01') AS bucket FROM signals), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY created_at DESC, id) AS place, count(*) OVER (PARTITION BY bucket) AS n FROM b) SELECT bucket, id, n FROM r WHERE place <= 50", S)
def _(v: Views):
    return B.timeline(v.signals, 21600, 50).select("bucket", "id", "n")


G6 = f"SELECT CAST(round(lat) AS BIGINT) AS lat_cell, CAST(round(lng) AS BIGINT) AS lng_cell, count(*) AS n, count(DISTINCT category) AS categories, list_sort(list(DISTINCT category)) AS names, round(avg(reliability), 6) AS reliability, max({RANK4}) AS worst FROM signals WHERE created_at > {NOW} - INTERVAL 7 DAYS GROUP BY ALL HAVING count(DISTINCT category) >= 3 ORDER BY categories DESC, n DESC, lat_cell, lng_cell LIMIT 20"


@query("g6_hotspot_cells", G6, S)
def _(v: Views):
    return B.hotspot_cells(B.within_hours(v.signals, v.as_of, 168), min_categories=3, limit=20)


@query("g4_map_points", "SELECT id, lat, lng FROM signals WHERE lat IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 500", S)
def _(v: Views):
    return v.signals.filter("lat is not null and lng is not null").orderBy(F.desc("created_at"), F.desc("id")).limit(500).select("id", "lat", "lng")


@query("g5_overlay", f"SELECT id, lat, lng FROM signals WHERE category = 'conflict' AND created_at > {NOW} - INTERVAL 168 HOURS AND lat <> 0 AND lng <> 0 ORDER BY created_at DESC, id DESC LIMIT 300", S)
def _(v: Views):
    return B.within_hours(v.signals, v.as_of, 168).filter("category = 'conflict' and lat <> 0 and lng <> 0").orderBy(F.desc("created_at"), F.desc("id")).limit(300).select("id", "lat", "lng")


@query("g1_floor_grid", "SELECT CAST(floor(lat) AS BIGINT) AS a, CAST(floor(lng) AS BIGINT) AS b, count(*) AS n, max(value) AS strongest, arg_max(id, (value, id)) AS strongest_id, floor(lat) + 0.5 AS lat, floor(lng) + 0.5 AS lng FROM signals GROUP BY floor(lat), floor(lng) ORDER BY n DESC, a, b LIMIT 10", S)
def _(v: Views):
    return B.floor_grid(v.signals, limit=10)


@query("g2_round_key", "SELECT CAST(floor(lat + 0.5) AS BIGINT) AS lat_key, CAST(floor(lng + 0.5) AS BIGINT) AS lng_key, min(id) AS id FROM signals GROUP BY ALL", S)
def _(v: Views):
    return v.signals.groupBy(R.js_round(F.col("lat")).alias("lat_key"), R.js_round(F.col("lng")).alias("lng_key")).agg(F.min("id").alias("id"))


@query("x17_wind_grid", "SELECT count(*) AS cells, round(min(u), 6) AS min_u, round(max(u), 6) AS max_u, round(sum(v), 4) AS sum_v FROM (SELECT 10 * cos(radians(3 * lat)) + 2 * sin(radians(2 * lng)) AS u, 3 * sin(radians(2 * lat)) * cos(radians(3 * lng)) AS v FROM (SELECT 90 - (i + 0.5) * 180 / 128 AS lat, j * 360.0 / 256 - 180 AS lng FROM range(128) a(i), range(256) b(j)))")
def _(v: Views):
    grid = B.wind_grid(v.spark, 128, 256)
    return grid.agg(F.count("*").alias("cells"), F.round(F.min("u"), 6).alias("min_u"), F.round(F.max("u"), 6).alias("max_u"), F.round(F.sum("v"), 4).alias("sum_v"))
