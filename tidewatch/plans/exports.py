"""Sources and sinks: readers, merges, snapshots, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..bind import AS_OF, Views
from ..functions import ranks as R
from ..operators import basic as B
from ..operators import pages as P
from ..session import ensure_checkpoint_dir
from ..sources import readers as In
from ..sources import sinks as Out
from .core import RANK4, S
from .registry import query

NOW = f"TIMESTAMP '{AS_OF}'"


@query("x3_insert_if_absent", "SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 1)")
def _(v: Views):
    pages = v.table("pages")
    return Out.insert_absent(pages.filter("page_id % 3 = 1").select("url"), pages.filter("page_id % 3 = 0").select("url"), ["url"])


LINE = "CASE WHEN event_id % 10 = 0 THEN 'short' ELSE array_to_string(list_transform(range(61), lambda i: CASE i WHEN 0 THEN event_id::VARCHAR WHEN 30 THEN CASE WHEN event_id % 7 = 0 THEN 'x' ELSE ((event_id % 21) - 10)::VARCHAR END WHEN 53 THEN 'C' || (user_id % 25) ELSE 'f' || i END), chr(9)) END"


@query("x4_event_lines", "WITH r AS (SELECT event_id, (event_id % 21) - 10 AS g, user_id FROM events WHERE event_id % 10 <> 0) SELECT event_id::VARCHAR AS global_event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE g END::DOUBLE AS goldstein, 'C' || (user_id % 25) AS country_code FROM r")
def _(v: Views):
    e = v.table("events")
    fields = [F.lit(f"f{i}") for i in range(61)]
    fields[0], fields[53] = F.col("event_id").cast("string"), F.concat(F.lit("C"), (F.col("user_id") % 25).cast("string"))
    fields[30] = F.when(F.col("event_id") % 7 == 0, "x").otherwise(((F.col("event_id") % 21) - 10).cast("string"))
    lines = e.select(F.when(F.col("event_id") % 10 == 0, "short").otherwise(F.concat_ws("\t", *fields)).alias("value"))
    return In.event_lines(lines).select("global_event_id", "goldstein", "country_code")


@query("x7_quakes", "SELECT event_id::VARCHAR AS id, value / 50 AS mag FROM events WHERE value / 50 >= 4.5")
def _(v: Views):
    e = v.table("events")
    feature = F.struct(F.col("event_id").cast("string").alias("id"), F.struct((F.col("value") / 50).alias("mag"), F.lit("p").alias("place"), F.lit(0).alias("time")).alias("properties"), F.struct(F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")).alias("geometry"))
    texts = e.groupBy((F.col("event_id") % 50).alias("g")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    return In.quakes(texts).select("id", "mag")


@query("x9_centroids", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE (n_nationkey * 3 + 4) / 4.0 END::DOUBLE AS lng, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END::DOUBLE AS lat FROM nation")
def _(v: Views):
    k = F.col("n_nationkey").cast("string")
    point = F.concat(F.lit('{"type":"Point","coordinates":['), k, F.lit(",2]}"))
    ring = F.concat(F.lit('{"type":"Polygon","coordinates":[[['), k, F.lit(",0],["), k, F.lit(",2],["), k, F.lit(",1],[4,1]]]}"))
    return In.centroids(v.table("nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, point).otherwise(ring).alias("geometry"))).select("id", "lng", "lat")


@query("x2_feed_items", "SELECT n_name AS source, i::INTEGER AS position, n_name || ' item ' || i AS title, 'http://e.example/' || n_nationkey || '/' || i AS link FROM nation, range(3) t(i)")
def _(v: Views):
    item = lambda i: F.concat(F.lit("<item><title><![CDATA["), F.col("n_name"), F.lit(f" item {i}]]></title><link>http://e.example/"), F.col("n_nationkey").cast("string"), F.lit(f"/{i}</link></item>"))
    feeds = v.table("nation").select(F.col("n_name").alias("source"), F.concat(F.lit("<rss><channel><title>c</title>"), *[item(i) for i in range(3)], F.lit("</channel></rss>")).alias("xml"))
    return P.feed_items(feeds)


@query("x1_due_sources", "SELECT source_id, max(created_at) AS last_at FROM signals GROUP BY source_id HAVING max(created_at) + INTERVAL 45 MINUTES <= TIMESTAMP '2024-01-31 00:00:00'", S)
def _(v: Views):
    seen = v.signals.groupBy("source_id").agg(F.max("created_at").alias("last_at")).withColumn("tier", F.lit("wire"))
    return B.due_sources(seen, v.as_of, 45).select("source_id", "last_at")


@query("x8_distress", "SELECT event_id FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 16 AS status FROM events) WHERE status IN (7, 14)")
def _(v: Views):
    frames = v.table("events").select("event_id", (F.get_json_object("props", "$.k").cast("int") % 16).alias("status"))
    return In.distress(frames).select("event_id")


@query("x14_registry_filter", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 'p'))) > 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def _(v: Views):
    parts = v.table("part").filter(F.col("p_size").between(10, 20) & F.exists(F.split("p_name", " "), lambda w: w.startswith("p")))
    return parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_name")


@query("y1_upsert", "SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey <= 1000) o FULL JOIN (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey > 900) n ON o.k = n.k")
def _(v: Views):
    c = v.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return Out.merged(c.filter("k <= 1000"), c.filter("k > 900").withColumn("v", F.col("v") + 1), ["k"])


@query("y3_snapshot_retention", f"SELECT category, count(*) AS n FROM signals WHERE created_at > {NOW} - INTERVAL 3 HOURS GROUP BY 1", S)
def _(v: Views):
    return B.count_by(Out.retained(v.signals, "created_at", v.as_of, 3), "category")


@query("y4_search_docs", f"SELECT id, title, category, severity, country_code, reliability, CAST(floor(epoch(created_at)) AS BIGINT) AS created_s FROM signals WHERE created_at > {NOW} - INTERVAL 12 MINUTES", S)
def _(v: Views):
    return Out.search_docs(v.signals, R.hours_before(v.as_of, 0.2))


@query("y5_query_log", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(v: Views):
    return v.table("events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


@query("y5_written_log", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END)::BIGINT AS empty FROM events WHERE ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2")
def _(v: Views):
    """Two appends to a log of searches that is partitioned by month, read back by its months."""
    ensure_checkpoint_dir(v.spark)
    path = f"{v.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/log-{uuid.uuid4().hex}"
    asked = v.table("events").select("ts", "event_type", (F.col("value") < 10).alias("empty"))
    for later in (False, True):
        Out.write_log(asked.filter((F.dayofmonth("ts") > 15) == later), path)
    log = v.spark.read.schema(f"ts {asked.schema['ts'].dataType.simpleString()}, event_type string, empty boolean, month string").parquet(path)
    return log.filter("month < '2024-02'").groupBy("month", "event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("empty"), 1).otherwise(0)).alias("empty"))


@query("y7_stix", "SELECT id, CAST(least(100, greatest(0, CASE severity WHEN 'critical' THEN 95 WHEN 'high' THEN 80 WHEN 'medium' THEN 60 WHEN 'low' THEN 30 ELSE 15 END + floor((reliability - 0.5) * 20 + 0.5))) AS BIGINT) AS confidence FROM signals", S)
def _(v: Views):
    return v.signals.select("id", Out.stix_confidence(F.col("severity"), F.col("reliability")).alias("confidence"))


@query("y8_row_digests", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS digest FROM nation")
def _(v: Views):
    return v.table("nation").select("n_nationkey", Out.canonical_digest(["n_nationkey", "n_name"]).alias("digest"))


@query("y9_geojson", "SELECT id, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || (user_id % 90) || ',' || (user_id % 45) || ']},\"properties\":{\"category\":\"' || category || '\"}}' AS feature FROM signals WHERE severity = 'critical'", S)
def _(v: Views):
    s = v.signals.filter("severity = 'critical'").withColumn("x", F.col("user_id") % 90).withColumn("y", F.col("user_id") % 45)
    return s.select("id", Out.geojson_feature("y", "x", ["category"]).alias("feature"))


HOOKS = [("h1", 3, ["security"], []), ("h2", 4, [], []), ("h3", 2, [], ["C1", "C9"])]
HOOKS_SQL = "hooks(hook, min_rank, h_categories, h_countries) AS (VALUES ('h1', 3, ['security'], []::VARCHAR[]), ('h2', 4, []::VARCHAR[], []::VARCHAR[]), ('h3', 2, []::VARCHAR[], ['C1', 'C9']))"


@query("y10_webhook_fan_out", f"{HOOKS_SQL} SELECT hook, count(*) AS deliveries, max(id) AS last_id FROM signals JOIN hooks ON {RANK4} >= min_rank AND (len(h_categories) = 0 OR list_contains(h_categories, category)) AND (len(h_countries) = 0 OR list_contains(h_countries, country_code)) GROUP BY hook", S)
def _(v: Views):
    hooks = v.spark.createDataFrame(HOOKS, "hook string, min_rank int, h_categories array<string>, h_countries array<string>")
    return Out.fan_out(v.signals, hooks).groupBy("hook").agg(F.count("*").alias("deliveries"), F.max("id").alias("last_id"))


@query("y11_broadcast", "c(client, client_user, subscribed) AS (VALUES ('a', 3, ['health']), ('b', 40, ['economy', 'security']), ('c', 77, []::VARCHAR[])) SELECT client, count(*) AS n FROM signals JOIN c ON severity = 'critical' OR list_contains(subscribed, category) OR user_id = client_user GROUP BY client", S)
def _(v: Views):
    clients = v.spark.createDataFrame([("a", 3, ["health"]), ("b", 40, ["economy", "security"]), ("c", 77, [])], "client string, client_user int, subscribed array<string>")
    return Out.broadcast_targets(v.signals, clients).groupBy("client").agg(F.count("*").alias("n"))


@query("y12_dead_letters", "SELECT event_id AS id, user_id % 5 + 1 AS attempts FROM (SELECT * FROM events WHERE value < 10 ORDER BY ts DESC, event_id DESC LIMIT 1000) WHERE user_id % 5 + 1 < 4")
def _(v: Views):
    failed = v.table("events").filter("value < 10").select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 5).alias("attempts"))
    return Out.dead_letters(failed, 1000, 4).select("id", "attempts")


@query("s55_wkb_points")
def _(v: Views):
    """WKB points written in hexadecimal and read back; held against struct in tests."""
    points = v.spark.createDataFrame([(1, "0101000000000000000000F03F0000000000000040"), (2, "0101000020E6100000000000000000F0BF0000000000C05240"), (3, "010100000000000000000000000000000000000000")], "id long, geom string")
    return In.wkb_points(points).select("id", "lng", "lat")
