"""Indices, dashboards, baselines, anomalies and trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bind import AS_OF, Views
from ..functions import ranks as R
from ..functions import scores as C
from ..operators import basic as B
from ..operators import indices as I
from .core import RANK4, S
from .registry import query

O = "orders_s"
NOW = f"TIMESTAMP '{AS_OF}'"
WCOUNTRY = "CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 70 WHEN 'medium' THEN 40 WHEN 'low' THEN 15 ELSE 5 END"
BAND = "CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Elevated' WHEN score >= 20 THEN 'Moderate' ELSE 'Low' END"


@query(
    "a5_country_index",
    f"""t AS (SELECT country_code, count(*) AS n, sum({WCOUNTRY}) AS raw, max({RANK4}) AS worst, list_sort(list(DISTINCT category)) AS categories, round(avg(reliability), 2) AS reliability,
        count(*) FILTER (created_at > {NOW} - INTERVAL 6 HOURS) AS n6 FROM signals WHERE created_at > {NOW} - INTERVAL 24 HOURS GROUP BY country_code ORDER BY raw DESC, country_code LIMIT 20),
    s AS (SELECT *, CAST(floor((raw - min(raw) OVER ()) / coalesce(nullif(max(raw) OVER () - min(raw) OVER (), 0), 1)::DOUBLE * 85 + 10 + 0.5) AS BIGINT) AS score FROM t)
    SELECT country_code, n, score, {BAND} AS band, worst, categories, reliability, CASE WHEN n6 > n * 0.5 THEN 'rising' WHEN n6 > n * 0.25 THEN 'stable' ELSE 'falling' END AS trend FROM s""",
    S,
)
def _(v: Views):
    return I.country_index(B.within_hours(v.signals, v.as_of, 24), v.as_of, 20)


@query(
    "a6_country_detail",
    f"c AS (SELECT country_code, category, count(*) AS n, max({RANK4}) AS worst FROM signals GROUP BY 1, 2), r AS (SELECT country_code, sum(n * [0, 15, 40, 70, 100][1 + worst]) AS raw, sum(n) AS n FROM c GROUP BY 1), s AS (SELECT country_code, CAST(n AS BIGINT) AS n, least(95, CAST(floor(ln(raw + 1) / ln(5001) * 85 + 10 + 0.5) AS BIGINT)) AS score FROM r) SELECT country_code, n, score, {BAND} AS band FROM s",
    S,
)
def _(v: Views):
    return I.country_detail(v.signals)


DIM = {"conflict": "security", "economy": "economic", "disaster": "environmental", "health": "environmental"}
DIMW = {"security": 0.25, "political": 0.20, "economic": 0.20, "environmental": 0.15, "infrastructure": 0.10, "cyber": 0.10}
_dims = "dims(dim, weight) AS (VALUES " + ", ".join(f"('{d}', {w}::DOUBLE)" for d, w in DIMW.items()) + ")"
_map = "m(category, dim) AS (VALUES " + ", ".join(f"('{c}', '{d}')" for c, d in DIM.items()) + ")"


@query(
    "a7_resilience_rankings",
    f"""{_dims}, {_map}, c AS (SELECT country_code, category, sum({WCOUNTRY}) AS risk FROM signals GROUP BY 1, 2),
    k AS (SELECT DISTINCT country_code FROM signals),
    d AS (SELECT k.country_code, dims.dim, any_value(weight) AS weight, coalesce(sum(CASE WHEN m.dim = dims.dim THEN risk * 1.0::DOUBLE WHEN m.dim IS NULL THEN risk * 0.2::DOUBLE ELSE 0 END), 0) AS risk
        FROM k CROSS JOIN dims JOIN c ON c.country_code = k.country_code LEFT JOIN m ON m.category = c.category GROUP BY 1, 2),
    s AS (SELECT *, greatest(0, 100 - CASE WHEN risk > 0 THEN least(100, floor(ln(risk + 1) / ln(10001) * 100 + 0.5)) ELSE 0 END) AS score FROM d)
    SELECT country_code, CAST(floor(sum(score * weight) / sum(weight) + 0.5 + 1e-9) AS BIGINT) AS composite, CAST(max(CASE WHEN dim = 'security' THEN score END) AS BIGINT) AS security, CAST(max(CASE WHEN dim = 'environmental' THEN score END) AS BIGINT) AS environmental FROM s GROUP BY country_code""",
    S,
)
def _(v: Views):
    return I.resilience(v.signals, DIM, DIMW).select("country_code", "composite", "security", "environmental")


@query(
    "a8_threat_index",
    f"SELECT count(*) AS n, CAST(least(5, greatest(1, floor(1 + 4 * sum(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 3 WHEN 'medium' THEN 1.5 WHEN 'low' THEN 0.5 ELSE 0.1 END::DOUBLE) / (5 * count(*)) + 0.5))) AS BIGINT) AS level FROM signals WHERE created_at > {NOW} - INTERVAL 24 HOURS AND status = 'verified'",
    S,
)
def _(v: Views):
    return I.threat_index(B.within_hours(v.signals, v.as_of, 24).filter("status = 'verified'"))


def _esc(w):
    return f"CASE WHEN {w}n = 0 THEN 0 ELSE least(100, greatest(0, floor(least(3.0::DOUBLE, {w}n / greatest({w}p, 1)::DOUBLE) / 3 * 40 + {w}w / ({w}n * 4.0::DOUBLE) * 60 + 0.5))) END"


@query(
    "a9_escalation_index",
    f"""c AS (SELECT country_code, count(*) FILTER (created_at > {NOW} - INTERVAL 72 HOURS) AS an, count(*) FILTER (created_at <= {NOW} - INTERVAL 72 HOURS AND created_at > {NOW} - INTERVAL 144 HOURS) AS ap,
        coalesce(sum({RANK4}) FILTER (created_at > {NOW} - INTERVAL 72 HOURS), 0) AS aw, count(*) FILTER (created_at <= {NOW} - INTERVAL 72 HOURS AND created_at > {NOW} - INTERVAL 144 HOURS) AS bn,
        count(*) FILTER (created_at <= {NOW} - INTERVAL 144 HOURS) AS bp, coalesce(sum({RANK4}) FILTER (created_at <= {NOW} - INTERVAL 72 HOURS AND created_at > {NOW} - INTERVAL 144 HOURS), 0) AS bw
        FROM signals WHERE created_at > {NOW} - INTERVAL 216 HOURS GROUP BY country_code),
    s AS (SELECT country_code, CAST({_esc('a')} AS BIGINT) AS score, CAST({_esc('b')} AS BIGINT) AS before FROM c)
    SELECT country_code, score, before, CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Elevated' WHEN score >= 20 THEN 'Moderate' ELSE 'Calm' END AS level, CASE WHEN score > before + 5 THEN 'rising' WHEN score < before - 5 THEN 'falling' ELSE 'stable' END AS trend FROM s""",
    S,
)
def _(v: Views):
    return I.escalation_index(v.signals, v.as_of, 72)


@query("a10_trend_direction", f"c AS (SELECT category, count(*) FILTER (created_at > {NOW} - INTERVAL 6 HOURS) AS n6, count(*) AS n FROM signals WHERE created_at > {NOW} - INTERVAL 7 DAYS GROUP BY category) SELECT category, n6, n, CASE WHEN n6 / 6.0 > 2 * n / 168.0 AND n6 >= 3 THEN 'increasing' WHEN n6 / 6.0 < 0.5 * n / 168.0 THEN 'decreasing' ELSE 'stable' END AS trend FROM c", S)
def _(v: Views):
    return I.rate_trend(B.within_hours(v.signals, v.as_of, 168), v.as_of, "category", 6, 168)


@query("a11_convergence", f"SELECT CAST(floor(lat / 2) AS BIGINT) AS a, CAST(floor(lng / 2) AS BIGINT) AS b, count(*) AS n, count(DISTINCT category) AS categories, list(id ORDER BY created_at DESC, id DESC)[1:3] AS newest, max(created_at) AS last_at FROM signals GROUP BY ALL HAVING count(*) >= 5", S)
def _(v: Views):
    return I.convergence(v.signals, 2, 5)


@query("a13_worst_of", f"SELECT source_id, CASE WHEN bool_or(severity = 'critical') THEN 'outage' WHEN bool_or(severity = 'high') THEN 'degraded' ELSE 'operational' END AS status FROM signals WHERE created_at > {NOW} - INTERVAL 6 HOURS GROUP BY source_id", S)
def _(v: Views):
    return B.within_hours(v.signals, v.as_of, 6).groupBy("source_id").agg(F.when(F.bool_or(F.col("severity") == "critical"), "outage").when(F.bool_or(F.col("severity") == "high"), "degraded").otherwise("operational").alias("status"))


@query(
    "a14_topic_groups",
    """t AS (SELECT title, source_id, reliability, CAST(substr(source_id, 2) AS INT) % 3 AS m FROM signals),
    g AS (SELECT title, count(*) AS n, count(DISTINCT source_id) AS sources, sum(reliability * CASE m WHEN 0 THEN 1.5 WHEN 1 THEN 1.3 ELSE 1.0 END::DOUBLE) / sum(CASE m WHEN 0 THEN 1.5 WHEN 1 THEN 1.3 ELSE 1.0 END::DOUBLE) AS trust,
        min(m) AS top, count(DISTINCT m) AS tiers, max(reliability) AS best FROM t GROUP BY title)
    SELECT title, n, sources, round(least(1.0, 0.30 * least(n / 3.0::DOUBLE, 1.0) + 0.30 * trust + CASE WHEN top = 0 THEN 0.25 WHEN top = 1 THEN 0.20 WHEN best >= 0.8 THEN 0.12 ELSE 0.05 END::DOUBLE + CASE WHEN tiers >= 3 THEN 0.15 WHEN tiers >= 2 THEN 0.10 ELSE 0.03 END::DOUBLE) + 1e-9, 4) AS initial FROM g WHERE n >= 3""",
    S,
)
def _(v: Views):
    return I.topic_groups(v.signals).filter("n >= 3")


@query(
    "a15_verification",
    f"""c AS (SELECT country_code, category, count(DISTINCT source_id) AS sources, avg(reliability) AS trust, max({RANK4}) AS worst, count(DISTINCT region) AS regions FROM signals WHERE created_at > {NOW} - INTERVAL 48 HOURS GROUP BY 1, 2),
    s AS (SELECT *, 0.35 * least(sources / 3.0, 1.0) + 0.35 * trust + 0.15 * CASE WHEN sources >= 2 THEN 1 ELSE 0 END + 0.15 * least(regions / 2.0, 1.0) AS score FROM c)
    SELECT country_code, category, round(score, 4) AS score, CASE WHEN score >= CASE worst WHEN 4 THEN 0.80 WHEN 3 THEN 0.75 ELSE 0.70 END THEN 'verified' WHEN score >= CASE worst WHEN 4 THEN 0.20 WHEN 3 THEN 0.25 ELSE 0.30 END THEN 'pending' ELSE 'disputed' END AS status FROM s""",
    S,
)
def _(v: Views):
    return I.verification(B.within_hours(v.signals, v.as_of, 48))


@query("a18_threat_summary", "SELECT 'severity' AS part, severity AS name, count(*) AS n FROM signals WHERE category IN ('security', 'conflict') GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM signals WHERE category IN ('security', 'conflict') GROUP BY category UNION ALL (SELECT 'origin', country_code, count(*) FROM signals WHERE category IN ('security', 'conflict') GROUP BY country_code ORDER BY 3 DESC, 2 LIMIT 5)", S)
def _(v: Views):
    return I.summary_parts(v.signals.filter(F.col("category").isin("security", "conflict")), {"severity": ("severity", None), "category": ("category", None), "origin": ("country_code", 5)})


@query("a19_source_attribution", "SELECT CASE WHEN list_contains(tags, 'k1') THEN 'kev' WHEN list_contains(tags, 'k2') THEN 'otx' WHEN list_contains(tags, 'error') THEN 'cert' ELSE 'other' END AS feed, count(*) AS n, count(*) FILTER (severity IN ('critical', 'high')) AS severe FROM signals GROUP BY 1", S)
def _(v: Views):
    feed = F.when(F.array_contains("tags", "k1"), "kev").when(F.array_contains("tags", "k2"), "otx").when(F.array_contains("tags", "error"), "cert").otherwise("other")
    return v.signals.groupBy(feed.alias("feed")).agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe"))


@query("a20_level_by_pattern", "SELECT user_id % 5 AS g, max(CAST(regexp_extract(title, 'unit([0-9])', 1) AS INTEGER)) AS level FROM signals GROUP BY 1", S)
def _(v: Views):
    return v.signals.groupBy((F.col("user_id") % 5).alias("g")).agg(F.max(F.regexp_extract("title", "unit([0-9])", 1).cast("int")).alias("level"))


@query("a21_subcategories", "SELECT CASE WHEN list_contains(tags, 'k0') THEN 'crypto' WHEN regexp_matches(title, 'place1[0-9]?') THEN 'markets' WHEN regexp_matches(title, 'unit[5-8]') THEN 'banking' ELSE 'general' END AS sub, count(*) AS n FROM signals GROUP BY 1", S)
def _(v: Views):
    sub = F.when(F.array_contains("tags", "k0"), "crypto").when(F.col("title").rlike("place1[0-9]?"), "markets").when(F.col("title").rlike("unit[5-8]"), "banking").otherwise("general")
    return v.signals.groupBy(sub.alias("sub")).agg(F.count("*").alias("n"))


@query("a22_daily_by_class", "SELECT CAST(created_at AS DATE) AS day, regexp_extract(title, '(place[0-9]+)', 1) AS class, count(*) AS n FROM signals WHERE category = 'economy' GROUP BY 1, 2", S)
def _(v: Views):
    return v.signals.filter("category = 'economy'").groupBy(F.to_date("created_at").alias("day"), F.regexp_extract("title", "(place[0-9]+)", 1).alias("class")).agg(F.count("*").alias("n"))


@query("a23_registry_summary", "SELECT r_name AS region, count(*) AS suppliers, count(*) FILTER (s_acctbal < 0) AS in_debt, round(avg(s_acctbal), 4) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(v: Views):
    s = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") < 0).alias("in_debt"), F.round(F.avg("s_acctbal"), 4).alias("balance"))


@query("a24_nested_arrays", "SELECT owner, count(DISTINCT p_partkey) AS parts, list_sort(list(DISTINCT b)) AS brands FROM (SELECT p_partkey, p_brand AS b, unnest(string_split(p_name, ' ')) AS owner FROM part) GROUP BY owner")
def _(v: Views):
    nested = v.table("part").select("p_partkey", F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("owner"), F.col("p_brand").alias("b"))).alias("points"))
    return nested.select("p_partkey", F.inline("points")).groupBy("owner").agg(F.countDistinct("p_partkey").alias("parts"), F.array_sort(F.collect_set("b")).alias("brands"))


@query("a25_infra_summary", "SELECT p_type AS operator, sum(coalesce(nullif(p_size, 1), 0))::BIGINT AS capacity, round(sum(p_retailprice), 2) AS cost FROM part GROUP BY p_type ORDER BY capacity DESC, operator LIMIT 10")
def _(v: Views):
    return v.table("part").groupBy(F.col("p_type").alias("operator")).agg(F.sum(F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(0))).alias("capacity"), F.round(F.sum("p_retailprice"), 2).alias("cost")).orderBy(F.desc("capacity"), "operator").limit(10)


@query("a26_trust_tiers", "SELECT CASE WHEN reliability >= 0.8 THEN 'trusted' WHEN reliability >= 0.5 THEN 'mixed' ELSE 'weak' END AS tier, status, count(*) AS n, round(avg(reliability), 6) AS mean FROM signals GROUP BY 1, 2", S)
def _(v: Views):
    tier = R.ladder(F.col("reliability"), [(0.8, "trusted"), (0.5, "mixed")], "weak")
    return v.signals.groupBy(tier.alias("tier"), "status").agg(F.count("*").alias("n"), F.round(F.avg("reliability"), 6).alias("mean"))


@query("a27_weighted_mean", "SELECT country_code, round(sum(reliability * w) / sum(w), 6) AS credibility FROM (SELECT country_code, reliability, CASE category WHEN 'security' THEN 1.2 WHEN 'conflict' THEN 1.1 WHEN 'economy' THEN 1.0 ELSE 0.8 END::DOUBLE AS w FROM signals) GROUP BY country_code", S)
def _(v: Views):
    return I.weighted_mean(v.signals, "country_code", "reliability", F.when(F.col("category") == "security", 1.2).when(F.col("category") == "conflict", 1.1).when(F.col("category") == "economy", 1.0).otherwise(0.8), "credibility")


@query("a28_claim_summary", "SELECT category AS kind, status, count(*) AS n, count(DISTINCT user_id) AS speakers FROM signals GROUP BY 1, 2", S)
def _(v: Views):
    return v.signals.groupBy(F.col("category").alias("kind"), "status").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("speakers"))


@query(
    "a29_source_reputation",
    f"""b AS (SELECT source_id, count(*) AS n, avg(reliability) AS rel, count(*) FILTER (status = 'disputed') / count(*)::DOUBLE AS d, count(*) FILTER (source_count >= 2) / count(*)::DOUBLE AS c FROM signals WHERE created_at > {NOW} - INTERVAL 30 DAYS GROUP BY source_id HAVING count(*) >= 3),
    x AS (SELECT *, CASE WHEN d > 0.15 THEN greatest(-0.15, -(d - 0.15) * 0.5) ELSE 0 END AS a1 FROM b), y AS (SELECT *, CASE WHEN c < 0.05 AND n >= 20 THEN greatest(-0.15, a1 - 0.03) ELSE a1 END AS a2 FROM x),
    z AS (SELECT *, CASE WHEN c > 0.30 THEN least(0.05, a2 + least(0.05, (c - 0.30) * 0.1)) ELSE a2 END AS a3 FROM y)
    SELECT source_id, n, round(least(0.99, greatest(0.05, rel + CASE WHEN n >= 10 THEN a3 ELSE 0 END)), 4)::DOUBLE AS reputation FROM z""",
    S,
)
def _(v: Views):
    return I.source_reputation(B.within_hours(v.signals, v.as_of, 720))


@query(
    "a30_quality_composite",
    "SELECT CAST(floor(least(100, 20 * least(count(*) / 1000.0, 1) + 15 * avg(reliability) + 15 * avg(CASE WHEN source_count >= 2 THEN 1 ELSE 0 END) + 15 * avg(CASE WHEN status = 'verified' THEN 1 ELSE 0 END) + 15 * least(count(DISTINCT country_code) / 25.0, 1) + 10 * least(count(DISTINCT category) / 5.0, 1) + 10 * least(count(DISTINCT source_id) / 20.0, 1)) + 0.5) AS BIGINT) AS quality FROM signals",
    S,
)
def _(v: Views):
    return I.quality_composite(v.signals)


@query(
    "a31_implicit_interests",
    f"""c AS (SELECT user_id, category, count(*) AS n, count(*) FILTER (created_at > {NOW} - INTERVAL 7 DAYS) AS recent FROM signals GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, n + recent AS w FROM c)
    SELECT user_id, category, round(w / max(w) OVER (PARTITION BY user_id)::DOUBLE, 3) AS weight FROM t WHERE total >= 50""",
    S,
)
def _(v: Views):
    return I.implicit_interests(v.signals, v.as_of, 50)


@query("a32_disputes", "SELECT source_id, category, count(*) AS votes, count(*) >= 3 AS resolved FROM signals WHERE status = 'disputed' GROUP BY 1, 2", S)
def _(v: Views):
    return v.signals.filter("status = 'disputed'").groupBy("source_id", "category").agg(F.count("*").alias("votes")).withColumn("resolved", F.col("votes") >= 3)


@query("a33_votes", "v AS (SELECT country_code, count(*) FILTER (k % 3 > 0) AS up, count(*) FILTER (k % 3 = 0) AS down FROM signals GROUP BY 1) SELECT country_code, up, down, up - down AS net, up / (up + down)::DOUBLE >= 0.7 AND up - down >= 10 AS consensus FROM v", S)
def _(v: Views):
    votes = v.signals.groupBy("country_code").agg(F.count_if(F.col("k") % 3 > 0).alias("up"), F.count_if(F.col("k") % 3 == 0).alias("down"))
    return votes.withColumn("net", F.col("up") - F.col("down")).withColumn("consensus", (F.col("up") / (F.col("up") + F.col("down")) >= 0.7) & (F.col("net") >= 10))


@query("a35_personal", "SELECT user_id, count(*) AS posts, round(sum(k) / count(*)::DOUBLE, 6) AS engagement, count(DISTINCT CAST(created_at AS DATE)) AS active_days FROM signals GROUP BY user_id ORDER BY posts DESC, user_id LIMIT 5", S)
def _(v: Views):
    return v.signals.groupBy("user_id").agg(F.count("*").alias("posts"), F.round(F.sum("k") / F.count("*"), 6).alias("engagement"), F.countDistinct(F.to_date("created_at")).alias("active_days")).orderBy(F.desc("posts"), "user_id").limit(5)


@query("a36_publish_stats", "SELECT event_type, count(*) AS n, sum(length(props))::BIGINT AS tokens FROM events GROUP BY event_type")
def _(v: Views):
    return v.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("tokens"))


@query(
    "a37_latency_percentiles",
    "l AS (SELECT source_id, value, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, id DESC) AS r FROM signals QUALIFY r <= 200) SELECT source_id, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM l GROUP BY source_id",
    S,
)
def _(v: Views):
    return I.latency_percentiles(v.signals, 200)


@query("a37_ema", "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), e AS (SELECT user_id, r, value AS ema FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, 0.1 * o.value + 0.9 * e.ema FROM e JOIN o ON o.user_id = e.user_id AND o.r = e.r + 1) SELECT user_id, round(arg_max(ema, r), 6) AS ema FROM e GROUP BY user_id")
def _(v: Views):
    return I.ema(v.table("events"), "user_id", F.struct("ts", "event_id", "value"), 0.1)


@query("a38_lag", "SELECT user_id % 8 AS partition, greatest(0, max(event_id) - max(event_id) FILTER (value < 100)) AS lag, CASE WHEN greatest(0, max(event_id) - max(event_id) FILTER (value < 100)) >= 2000 THEN 'critical' WHEN greatest(0, max(event_id) - max(event_id) FILTER (value < 100)) >= 500 THEN 'warn' ELSE 'ok' END AS status FROM events GROUP BY 1")
def _(v: Views):
    return I.consumer_lag(v.table("events").withColumn("partition", F.col("user_id") % 8), F.col("event_id"), F.when(F.col("value") < 100, F.col("event_id")))


@query("a39_source_health", f"SELECT source_id, count(*) AS n, round(count(*) FILTER (status <> 'disputed') / count(*)::DOUBLE, 6) AS success, CASE WHEN count(*) >= 5 AND count(*) FILTER (status <> 'disputed') / count(*)::DOUBLE < 0.5 THEN 'failed' WHEN max(created_at) < {NOW} - INTERVAL 30 MINUTES THEN 'stale' ELSE 'healthy' END AS health FROM signals GROUP BY source_id", S)
def _(v: Views):
    return I.source_health(v.signals, v.as_of)


@query("a40_fleet", "c AS (SELECT source_id, bool_or(severity = 'critical' AND status = 'disputed') AS open FROM signals GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (open) AS open, CASE WHEN count(*) FILTER (open) / count(*)::DOUBLE >= 0.4 THEN 'halt' WHEN count(*) FILTER (open) / count(*)::DOUBLE >= 0.2 THEN 'throttle' ELSE 'normal' END AS state FROM c", S)
def _(v: Views):
    c = v.signals.groupBy("source_id").agg(F.bool_or((F.col("severity") == "critical") & (F.col("status") == "disputed")).alias("open"))
    return c.agg(F.count("*").alias("n"), F.count_if("open").alias("open")).withColumn("state", R.ladder(F.col("open") / F.col("n"), [(0.4, "halt"), (0.2, "throttle")], "normal"))


@query("a41_rollup_status", "s AS (SELECT source_id, CASE WHEN max(value) >= 200 THEN 2 WHEN max(value) >= 150 THEN 1 ELSE 0 END AS r FROM signals GROUP BY 1) SELECT CASE WHEN count(*) FILTER (r = 2) >= 3 THEN 'outage' WHEN max(r) >= 1 THEN 'degraded' ELSE 'operational' END AS status FROM s", S)
def _(v: Views):
    s = v.signals.groupBy("source_id").agg(F.max("value").alias("m")).withColumn("r", R.ladder(F.col("m"), [(200, 2), (150, 1)], 0))
    return s.agg(F.when(F.count_if(F.col("r") == 2) >= 3, "outage").when(F.max("r") >= 1, "degraded").otherwise("operational").alias("status"))


A43 = """g AS (SELECT CAST(created_at AS DATE) AS date, category, coalesce(region, 'global') AS region, severity, count(*) AS n, round(avg(reliability), 6) AS reliability, count(*) FILTER (source_count >= 2) AS corroborated, grouping(region) AS gr, grouping(severity) AS gs
    FROM {view} GROUP BY GROUPING SETS ((CAST(created_at AS DATE), category, region, severity), (CAST(created_at AS DATE), category, region), (CAST(created_at AS DATE), category)))
    SELECT date, category, CASE WHEN gr = 1 THEN 'global' ELSE region END AS region, CASE WHEN gs = 1 THEN 'all' ELSE severity END AS severity, n, reliability, corroborated FROM g"""


@query("a43_baselines_grouping_sets", A43.format(view="orders_s"), O)
def _(v: Views):
    return I.baselines(v.orders)


@query("a43_event_baselines", A43.format(view="signals"), S)
def _(v: Views):
    return I.baselines(v.signals)


@query("a45_poll_tally", "SELECT user_id AS poll, k % 4 AS option, count(*) AS votes FROM signals GROUP BY 1, 2", S)
def _(v: Views):
    return v.signals.groupBy(F.col("user_id").alias("poll"), (F.col("k") % 4).alias("option")).agg(F.count("*").alias("votes"))


@query("a46_trending_communities", f"SELECT n_name AS community, count(id) AS posts, any_value(n_nationkey) AS members FROM nation LEFT JOIN (SELECT * FROM signals WHERE created_at > {NOW} - INTERVAL 24 HOURS) s ON 'C' || n_nationkey = country_code GROUP BY n_name", S)
def _(v: Views):
    recent = B.within_hours(v.signals, v.as_of, 24).groupBy("country_code").agg(F.count("*").alias("posts"))
    n = v.table("nation").withColumn("country_code", F.concat(F.lit("C"), F.col("n_nationkey").cast("string")))
    return n.join(recent, "country_code", "left").select(F.col("n_name").alias("community"), F.coalesce("posts", F.lit(0)).alias("posts"), F.col("n_nationkey").alias("members"))


@query("a47_log_page", "SELECT id, status, count(*) OVER () AS total FROM (SELECT * FROM signals WHERE user_id = 7) ORDER BY created_at DESC, id LIMIT 10 OFFSET 5", S)
def _(v: Views):
    return B.offset_page(v.signals.filter("user_id = 7"), [F.desc("created_at"), F.asc("id")], 5, 10).select("id", "status", "total")


DAILY = "d AS (SELECT category, region, CAST(created_at AS DATE) AS date, count(*) AS n FROM orders_s GROUP BY ALL)"


@query(
    "w2_rolling_baselines",
    f"""{DAILY}, w AS (SELECT *, avg(n) OVER w7 AS avg7, stddev_samp(n) OVER w7 AS std7, avg(n) OVER w30 AS avg30, stddev_samp(n) OVER w30 AS std30, avg(n) OVER w3 AS last3, avg(n) OVER p3 AS prev3
        FROM d WINDOW w7 AS (PARTITION BY category, region ORDER BY date ROWS 6 PRECEDING), w30 AS (PARTITION BY category, region ORDER BY date ROWS 29 PRECEDING), w3 AS (PARTITION BY category, region ORDER BY date ROWS 2 PRECEDING), p3 AS (PARTITION BY category, region ORDER BY date ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING))
    SELECT category, region, date, n, round(avg7, 4) AS avg7, round(std7, 4) AS std7, round(avg30, 4) AS avg30, round(std30, 4) AS std30, CASE WHEN std30 > 0 THEN round((n - avg30) / std30, 4) ELSE 0 END AS z30, CASE WHEN last3 > prev3 * 1.15 THEN 'rising' WHEN last3 < prev3 * 0.85 THEN 'falling' ELSE 'stable' END AS trend FROM w""",
    O,
)
def _(v: Views):
    return I.rolling_baselines(I.daily(v.orders))


@query(
    "w3_anomalies_zscore",
    f"""{DAILY}, w AS (SELECT *, count(*) OVER h AS rows, avg(n) OVER h AS mean, stddev_samp(n) OVER h AS std FROM d WINDOW h AS (PARTITION BY category, region ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
    SELECT category, region, date, n, round((n - mean) / std, 4) AS z, CASE WHEN n > mean THEN 'above' ELSE 'below' END AS direction FROM w WHERE rows >= 5 AND std > 1e-9 AND abs((n - mean) / std) >= 2""",
    O,
)
def _(v: Views):
    return I.anomalies(I.daily(v.orders), days=30, least=5, z=2.0)


@query(
    "w4_region_zscore",
    f"""r AS (SELECT * FROM signals WHERE created_at > {NOW} - INTERVAL 7 DAYS AND status IN ('verified', 'pending')), m AS (SELECT country_code, category, count(*) AS many FROM r GROUP BY 1, 2),
    c AS (SELECT country_code, count(*) AS n, avg({RANK4} + 1) AS severity FROM r GROUP BY 1 HAVING count(*) >= 5), z AS (SELECT *, (n - avg(n) OVER ()) / coalesce(nullif(stddev_pop(n) OVER (), 0), 1) AS z, count(*) OVER () AS regions FROM c),
    h AS (SELECT * FROM z WHERE z >= 1 AND regions >= 3 ORDER BY z DESC, country_code LIMIT 20)
    SELECT h.country_code, n, floor(severity * 100 + 0.5) / 100 AS severity, (SELECT arg_max(category, (many, -ascii(category))) FROM m WHERE m.country_code = h.country_code) AS category, floor(z * 100 + 0.5) / 100 AS z,
        (SELECT list(id ORDER BY {RANK4} DESC, created_at DESC, id DESC)[1:5] FROM r WHERE r.country_code = h.country_code) AS signals FROM h""",
    S,
)
def _(v: Views):
    """The threshold is one deviation here, not two: invented reports are spread evenly."""
    return I.region_hotspots(B.within_hours(v.signals, v.as_of, 168), 1.0, 20)


@query(
    "w5_w6_escalation_acceleration",
    f"""r AS (SELECT category, country_code, created_at, {RANK4} AS rank, row_number() OVER (PARTITION BY category, country_code ORDER BY created_at DESC, id DESC) AS d FROM signals QUALIFY d <= 10),
    o AS (SELECT *, row_number() OVER (PARTITION BY category, country_code ORDER BY d DESC) - 1 AS i, count(*) OVER (PARTITION BY category, country_code) AS n FROM r),
    g AS (SELECT category, country_code, any_value(n) AS n, avg(rank) FILTER (i < n // 2) AS a, avg(rank) FILTER (i >= n // 2) AS b, date_sub('second', min(created_at) FILTER (i < n // 2), max(created_at) FILTER (i < n // 2)) AS g1, date_sub('second', min(created_at) FILTER (i >= n // 2), max(created_at) FILTER (i >= n // 2)) AS g2 FROM o GROUP BY 1, 2)
    SELECT category, country_code, n, b > a + 0.5 AS escalating, n >= 4 AND g2 < g1 * 0.6 AS accelerating FROM g WHERE n >= 3""",
    S,
)
def _(v: Views):
    return I.escalation_acceleration(v.signals, 10)


@query("w8_entity_trend", f"SELECT source_id AS entity, count(*) FILTER (created_at > {NOW} - INTERVAL 7 DAYS) AS now_n, count(*) FILTER (created_at <= {NOW} - INTERVAL 7 DAYS) AS before_n, CASE WHEN count(*) FILTER (created_at > {NOW} - INTERVAL 7 DAYS) > 1.3 * count(*) FILTER (created_at <= {NOW} - INTERVAL 7 DAYS) THEN 'rising' WHEN count(*) FILTER (created_at > {NOW} - INTERVAL 7 DAYS) < 0.7 * count(*) FILTER (created_at <= {NOW} - INTERVAL 7 DAYS) THEN 'declining' ELSE 'stable' END AS trend FROM signals WHERE created_at > {NOW} - INTERVAL 14 DAYS GROUP BY 1", S)
def _(v: Views):
    return I.entity_trend(B.within_hours(v.signals, v.as_of, 336), v.as_of, "source_id", 168)


@query("w9_min_max", "SELECT country_code, n, round((n - min(n) OVER ()) / coalesce(nullif(max(n) OVER () - min(n) OVER (), 0), 1)::DOUBLE, 6) AS scaled FROM (SELECT country_code, count(*) AS n FROM signals GROUP BY 1)", S)
def _(v: Views):
    return I.min_max(B.count_by(v.signals, "country_code"), "n").select("country_code", "n", F.round("scaled", 6).alias("scaled"))


@query(
    "w12_clean_hour_streak",
    "h AS (SELECT source_id, date_trunc('hour', created_at) AS hour, count(*) AS n, count(*) FILTER (status = 'disputed') AS bad FROM signals GROUP BY 1, 2), f AS (SELECT *, sum(CASE WHEN bad > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY hour) AS island FROM h), s AS (SELECT source_id, island, count(*) FILTER (bad = 0) AS streak FROM f GROUP BY 1, 2) SELECT source_id, max(streak) AS longest, max(streak) >= 336 AS gate FROM s GROUP BY 1",
    S,
)
def _(v: Views):
    return I.clean_streaks(v.signals, 336)


@query("w14_category_cap", f"r AS (SELECT id, category, value, row_number() OVER (PARTITION BY category ORDER BY value DESC, id) AS r FROM signals WHERE created_at > {NOW} - INTERVAL 48 HOURS) SELECT id, category FROM r WHERE r <= 4 ORDER BY value DESC, id LIMIT 15", S)
def _(v: Views):
    return B.top_n(B.within_hours(v.signals, v.as_of, 48), ["category"], [F.desc("value"), F.asc("id")], 4).orderBy(F.desc("value"), "id").limit(15).select("id", "category")


@query(
    "k10_pulse_trends",
    f"""c AS (SELECT category, country_code, count(*) AS n, max({RANK4}) AS peak, max(created_at) AS last_at, list(id ORDER BY created_at DESC, id DESC)[1:5] AS ids FROM signals WHERE created_at > {NOW} - INTERVAL 24 HOURS AND status IN ('verified', 'pending') GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT category, country_code, n, CAST(floor(((peak / 4.0) * 0.4 + least(n / 10.0, 1) * 0.4 + greatest(0, 1 - date_sub('second', last_at, {NOW}) / 3600.0 / 24) * 0.2) * 100 + 0.5) AS BIGINT) AS score, ids FROM c ORDER BY score DESC, category, country_code LIMIT 20""",
    S,
)
def _(v: Views):
    return I.pulse_trends(B.within_hours(v.signals, v.as_of, 24), v.as_of, 24, 20)


@query("k12_cross_beat", f"h AS (SELECT region, category FROM signals WHERE created_at > {NOW} - INTERVAL 24 HOURS AND severity IN ('critical', 'high') GROUP BY 1, 2 HAVING count(*) >= 2) SELECT region, count(*) AS beats, list_sort(list(category)) AS categories FROM h GROUP BY region HAVING count(*) >= 3", S)
def _(v: Views):
    return I.cross_beat(B.within_hours(v.signals, v.as_of, 24), 2, 3)


@query(
    "z12_trending_tags",
    f"""t AS (SELECT unnest(tags) AS tag, category, created_at, k FROM signals WHERE status = 'verified' AND created_at >= {NOW} - INTERVAL 48 HOURS),
    c AS (SELECT tag, count(*) AS n, sum(k) AS eng FROM t WHERE created_at > {NOW} - INTERVAL 24 HOURS GROUP BY tag HAVING count(*) >= 2), p AS (SELECT tag, count(*) AS n FROM t WHERE created_at <= {NOW} - INTERVAL 24 HOURS GROUP BY tag),
    j AS (SELECT c.tag, c.n, c.eng, CASE WHEN coalesce(p.n, 0) = 0 THEN 100.0 ELSE (c.n - p.n) / p.n::DOUBLE * 100 END AS delta FROM c LEFT JOIN p ON c.tag = p.tag)
    SELECT tag, n, round(floor((n * 10 + ln(1 + eng) * 5) * 10 + 0.5) / 10, 1) AS score, round(floor(delta * 10 + 0.5) / 10, 1) AS delta, CASE WHEN delta > 100 THEN 'surging' WHEN delta > 30 THEN 'rising' WHEN delta > -20 THEN 'steady' ELSE 'cooling' END AS momentum FROM j ORDER BY score DESC, tag LIMIT 15""",
    S,
)
def _(v: Views):
    return I.trending_tags(v.signals.filter("status = 'verified'"), v.as_of, 24, 15)
