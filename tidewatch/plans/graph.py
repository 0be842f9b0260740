"""The entity graph and threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bind import AS_OF, Views
from ..functions import ranks as R
from ..functions import text as X
from ..operators import basic as B
from ..operators import graph as G
from ..operators import joins as J
from .core import RANK4, S
from .registry import query

M = "mentions"
NOW = f"TIMESTAMP '{AS_OF}'"
def trajectories(signals, thread, most: int):
    """The ranks of each thread's newest signals, the newest first: they are cut before they are collected."""
    rows = signals.select(thread.alias("thread"), "created_at", "id", R.by_severity(R.RANK_4).alias("rank"))
    newest = B.top_n(rows, ["thread"], [F.desc("created_at"), F.desc("id")], most, "i")
    return newest.groupBy("thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rank"))), lambda x: x["rank"]).alias("x"))


D = "d AS (SELECT DISTINCT signal_id, entity_id FROM mentions)"
E = "e AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n, round(least(1.0, count(*) / 10.0), 6)::DOUBLE AS weight FROM d a JOIN d b ON a.signal_id = b.signal_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"
W = "w AS (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e)"
LAST = "2001-08-02"


def edges(v: Views, size=None):
    return G.cooccurrence(v.mentions, 1, F.least(F.lit(1.0), F.col("n") / 10), size=size)


@query("e1_node_upsert", "SELECT entity_id, type, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS mentions, list_sort(list(DISTINCT signal_id))[-20:] AS signals FROM mentions GROUP BY 1, 2", M)
def _(v: Views):
    return G.node_upsert(v.mentions, 20)


@query("e2_edge_upsert", "x AS (SELECT entity_id AS a, 'T' || (signal_id % 50) AS b FROM mentions) SELECT a, b, count(*) AS n, round(least(1.0, 0.5 + 0.05 * (count(*) - 1)), 6)::DOUBLE AS weight FROM x GROUP BY 1, 2", M)
def _(v: Views):
    return G.edge_upsert(v.mentions.select(F.col("entity_id").alias("a"), F.concat(F.lit("T"), (F.col("signal_id") % 50).cast("string")).alias("b")), 0.5, 0.05)


@query("e3_entity_spikes", f"g AS (SELECT entity_id, count(*) FILTER (date_sub('day', seen_at, TIMESTAMP '{LAST}') >= 0 AND date_sub('day', seen_at, TIMESTAMP '{LAST}') < 60) AS recent, count(*) FILTER (date_sub('day', seen_at, TIMESTAMP '{LAST}') >= 60 AND date_sub('day', seen_at, TIMESTAMP '{LAST}') < 420) AS before FROM mentions GROUP BY 1) SELECT entity_id, recent, before, round(recent / greatest(before / 360.0 * 60, 1.0), 6)::DOUBLE AS spike FROM g WHERE recent > 0", M)
def _(v: Views):
    return G.spikes(v.mentions, F.lit(f"{LAST} 00:00:00").cast("timestamp_ntz"), 60, 360)


@query("e4_trending_tags_map", f"t AS (SELECT unnest(tags) AS tag, category, country_code FROM signals WHERE created_at > {NOW} - INTERVAL 72 HOURS) SELECT tag, count(*) AS n, list_sort(list(DISTINCT category)) AS categories, count(DISTINCT country_code) AS countries FROM t WHERE tag NOT IN ('click', 'view') GROUP BY tag ORDER BY n DESC, tag LIMIT 10", S)
def _(v: Views):
    t = B.within_hours(v.signals, v.as_of, 72).select(F.explode("tags").alias("tag"), "category", "country_code").filter(~F.col("tag").isin("click", "view"))
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("category")).alias("categories"), F.countDistinct("country_code").alias("countries")).orderBy(F.desc("n"), "tag").limit(10)


@query("e5_cooccurrence_edges", f"{D}, {E} SELECT a, b, n, weight FROM e", M)
def _(v: Views):
    return edges(v)


@query("e6_strong_edges", f"{D}, {E} SELECT a, b, n, round(least(0.9, 0.1 * n), 6)::DOUBLE AS weight FROM e WHERE n >= 3", M)
def _(v: Views):
    return G.cooccurrence(v.mentions, 3, F.least(F.lit(0.9), 0.1 * F.col("n")))


@query("o1_degrees", f"{D}, {E}, {W} SELECT node, count(*) AS degree, round(sum(weight), 6) AS weighted FROM w GROUP BY node", M)
def _(v: Views):
    return G.degrees(edges(v)).withColumn("weighted", F.round("weighted", 6))


@query("e9_w10_importance", f"{D}, {E}, {W}, n AS (SELECT entity_id AS node, count(*) AS mentions FROM mentions GROUP BY 1), r AS (SELECT w.node, count(*) AS degree, sum(weight) + 0.1 * any_value(mentions) AS raw FROM w JOIN n ON n.node = w.node GROUP BY 1) SELECT node, degree, round(raw / max(raw) OVER (), 6) AS importance FROM r ORDER BY importance DESC, node LIMIT 50", M)
def _(v: Views):
    return G.importance(edges(v), v.mentions.groupBy("entity_id").agg(F.count("*").alias("mentions")), 50)


@query("e8_merge_apply", f"{D}, {E}, m AS (SELECT a, b, weight, CASE WHEN CAST(substr(a, 2) AS INT) % 10 = 0 THEN 'S1' ELSE a END AS x, CASE WHEN CAST(substr(b, 2) AS INT) % 10 = 0 THEN 'S1' ELSE b END AS y FROM e) SELECT least(x, y) AS a, greatest(x, y) AS b, max(weight) AS weight FROM m WHERE x <> y GROUP BY 1, 2", M)
def _(v: Views):
    merges = v.mentions.select(F.col("entity_id").alias("node")).distinct().filter(F.substring("node", 2, 9).cast("int") % 10 == 0).withColumn("kept", F.lit("S1"))
    size = G.sized(v.mentions)
    return G.redirect(edges(v, size), merges, size[0])


@query("e10_entity_search", "SELECT entity_id, count(*) AS mentions FROM mentions WHERE entity_id LIKE 'S1%' OR entity_id IN ('S7', 'S8') GROUP BY 1 ORDER BY mentions DESC, entity_id LIMIT 25", M)
def _(v: Views):
    return v.mentions.filter(F.col("entity_id").startswith("S1") | F.col("entity_id").isin("S7", "S8")).groupBy("entity_id").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity_id").limit(25)


@query("e11_graph_stats", f"{D}, {E} SELECT (SELECT count(DISTINCT entity_id) FROM mentions) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT round(avg(weight), 6) FROM e) AS weight, (SELECT count(DISTINCT type) FROM mentions) AS types", M)
def _(v: Views):
    n = v.mentions.agg(F.countDistinct("entity_id").alias("nodes"), F.countDistinct("type").alias("types"))
    return n.crossJoin(F.broadcast(edges(v).agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 6).alias("weight"))))


@query("e12_mention_rate", "SELECT entity_id, count(*) AS mentions, round(count(*) / greatest(date_sub('day', min(seen_at), max(seen_at)), 1)::DOUBLE, 6) AS rate FROM mentions GROUP BY 1 ORDER BY rate DESC, entity_id LIMIT 20", M)
def _(v: Views):
    days = F.greatest(F.timestamp_diff("DAY", F.min("seen_at"), F.max("seen_at")), F.lit(1))
    return v.mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.round(F.count("*") / days, 6).alias("rate")).orderBy(F.desc("rate"), "entity_id").limit(20)


@query("e13_entity_signals", "SELECT DISTINCT o_orderkey AS id, o_orderdate AS created_at FROM mentions JOIN orders ON o_orderkey = signal_id WHERE entity_id = 'S5' ORDER BY created_at DESC, id LIMIT 20", M)
def _(v: Views):
    own = v.mentions.filter("entity_id = 'S5'").select(F.col("signal_id").alias("o_orderkey"))
    return v.table("orders").join(own, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")).orderBy(F.desc("created_at"), "id").limit(20)


@query("j16_edge_names", f"{D}, {E} SELECT e.a, e.b, sa.s_name AS name_a, sb.s_name AS name_b FROM e LEFT JOIN supplier sa ON 'S' || sa.s_suppkey = e.a LEFT JOIN supplier sb ON 'S' || sb.s_suppkey = e.b WHERE n >= 3", M)
def _(v: Views):
    s = v.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("key"), "s_name")
    size, few = G.sized(v.mentions), s.count() <= 100_000
    e = edges(v, size).filter("n >= 3").select("a", "b")
    for side in "ab":
        names = s.withColumnsRenamed({"key": side, "s_name": f"name_{side}"})
        e = e.join(F.broadcast(names), side, "left") if few else e.repartition(size[0], side).join(names, side, "left")
    return e.select("a", "b", "name_a", "name_b")


@query("j17_two_hops", f"{D}, {E}, b AS (SELECT a, b FROM e WHERE n >= 12 UNION ALL SELECT b, a FROM e WHERE n >= 12), one AS (SELECT DISTINCT b AS node FROM b WHERE a = 'S1'), two AS (SELECT DISTINCT b.b AS node FROM one JOIN b ON b.a = one.node) SELECT node, min(steps) AS steps FROM (SELECT node, 1 AS steps FROM one UNION ALL SELECT node, 2 FROM two) WHERE node <> 'S1' GROUP BY node", M)
def _(v: Views):
    return J.neighbours(edges(v).filter("n >= 12"), "S1", 2)


@query("j18_connected_signals", "o AS (SELECT DISTINCT entity_id FROM mentions WHERE signal_id = 7) SELECT signal_id, count(DISTINCT entity_id) AS shared, list_sort(list(DISTINCT entity_id)) AS entities FROM mentions JOIN o USING (entity_id) WHERE signal_id <> 7 GROUP BY 1", M)
def _(v: Views):
    return G.connected_signals(v.mentions, 7)


@query("s28_entity_ids", "SELECT DISTINCT n_name, substr(sha256('location::' || lower(trim(n_name))), 1, 16) AS id FROM nation")
def _(v: Views):
    return v.table("nation").select("n_name", F.substring(F.sha2(F.concat(F.lit("location::"), F.lower(F.trim("n_name"))), 256), 1, 16).alias("id")).distinct()


@query("k3_recent_clusters", "SELECT title, max(created_at) AS last_at, count(*) AS n FROM signals GROUP BY title ORDER BY last_at DESC, title LIMIT 100", S)
def _(v: Views):
    return v.signals.groupBy("title").agg(F.max("created_at").alias("last_at"), F.count("*").alias("n")).orderBy(F.desc("last_at"), "title").limit(100)


@query("k8_lifecycle_b", f"g AS (SELECT title, count(*) AS n, date_sub('second', max(created_at), {NOW}) / 3600.0 AS quiet FROM signals GROUP BY 1) SELECT title, n, CASE WHEN quiet >= 168 THEN 'resolved' WHEN quiet >= 48 THEN 'stable' ELSE 'developing' END AS state, n >= 3 AS promoted FROM g", S)
def _(v: Views):
    quiet = F.timestamp_diff("SECOND", F.max("created_at"), v.as_of) / F.lit(3600.0)
    g = v.signals.groupBy("title").agg(F.count("*").alias("n"), R.ladder(quiet, [(168, "resolved"), (48, "stable")], "developing").alias("state"))
    return g.withColumn("promoted", F.col("n") >= 3)


@query("w7_thread_status", f"t AS (SELECT country_code AS thread, list({RANK4} ORDER BY created_at DESC, id DESC)[1:6] AS x FROM signals GROUP BY 1) SELECT thread, CASE WHEN list_avg(x[1:3]) > 1.2 * list_avg(x[4:6]) THEN 'escalating' WHEN list_avg(x[1:3]) < 0.8 * list_avg(x[4:6]) THEN 'easing' ELSE 'stable' END AS status FROM t", S)
def _(v: Views):
    mean = lambda start: F.aggregate(F.slice("x", start, 3), F.lit(0.0), lambda a, y: a + y) / 3
    t = trajectories(v.signals, F.col("country_code"), 6)
    return t.select("thread", F.when(mean(1) > 1.2 * mean(4), "escalating").when(mean(1) < 0.8 * mean(4), "easing").otherwise("stable").alias("status"))


@query("k14_cross_cluster", "t AS (SELECT id, unnest([country_code, region]) AS thread, tags FROM signals WHERE severity = 'critical'), x AS (SELECT a.thread AS a, b.thread AS b, count(*) AS n FROM t a JOIN t b ON a.id = b.id AND a.thread < b.thread GROUP BY 1, 2) SELECT a, b, n, round(least(1.0, 0.3 + 0.15 * n), 6)::DOUBLE AS score FROM x WHERE n >= 2", S)
def _(v: Views):
    t = v.signals.filter("severity = 'critical'").select("id", F.explode(F.array("country_code", "region")).alias("thread"))
    x = J.suffixed(t, "_a").join(J.suffixed(t, "_b"), (F.col("id_a") == F.col("id_b")) & (F.col("thread_a") < F.col("thread_b")))
    g = x.groupBy(F.col("thread_a").alias("a"), F.col("thread_b").alias("b")).agg(F.count("*").alias("n")).filter("n >= 2")
    return g.withColumn("score", F.round(F.least(F.lit(1.0), 0.3 + 0.15 * F.col("n")), 6))


@query("k18_briefing", f"r AS (SELECT category, title, severity, {RANK4} AS rank, row_number() OVER (PARTITION BY category ORDER BY {RANK4} DESC, created_at DESC, id) AS i FROM signals WHERE created_at > {NOW} - INTERVAL 24 HOURS) SELECT category, count(*) AS n, max(rank) AS worst, list(title ORDER BY i) FILTER (i <= 3) AS headlines FROM r GROUP BY category", S)
def _(v: Views):
    day = B.within_hours(v.signals, v.as_of, 24).withColumn("rank", R.by_severity(R.RANK_4))
    top = B.top_n(day, ["category"], [F.desc("rank"), F.desc("created_at"), F.asc("id")], 3, "i").groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda x: x["title"]).alias("headlines"))
    return day.groupBy("category").agg(F.count("*").alias("n"), F.max("rank").alias("worst")).join(top, "category")


@query("t8_thread_order", f"g AS (SELECT country_code AS thread, max(created_at) AS last_at, CASE WHEN max(created_at) > {NOW} - INTERVAL 1 HOUR THEN 'escalating' WHEN max(created_at) > {NOW} - INTERVAL 4 HOURS THEN 'developing' ELSE 'stable' END AS state FROM signals GROUP BY 1) SELECT thread, state, row_number() OVER (ORDER BY CASE state WHEN 'escalating' THEN 0 WHEN 'developing' THEN 1 ELSE 2 END, last_at DESC, thread) AS place FROM g", S)
def _(v: Views):
    last = F.max("created_at")
    g = v.signals.groupBy(F.col("country_code").alias("thread")).agg(last.alias("last_at"), F.when(last > R.hours_before(v.as_of, 1), "escalating").when(last > R.hours_before(v.as_of, 4), "developing").otherwise("stable").alias("state"))
    from pyspark.sql import Window

    order = Window.orderBy(F.when(F.col("state") == "escalating", 0).when(F.col("state") == "developing", 1).otherwise(2), F.desc("last_at"), "thread")
    return g.select("thread", "state", F.row_number().over(order).alias("place"))


@query("g7_cell_anomaly", "c AS (SELECT CAST(floor(lat / 2) AS BIGINT) AS a, CAST(floor(lng / 2) AS BIGINT) AS b, category, severity, count(*) AS n FROM signals GROUP BY ALL), g AS (SELECT a, b, sum(n) AS n, count(DISTINCT category) AS categories, sum(n) FILTER (severity IN ('critical', 'high')) AS severe FROM c GROUP BY 1, 2 HAVING sum(n) >= 5 AND count(DISTINCT category) >= 2) SELECT a, b, CAST(n AS BIGINT) AS n, categories, round(coalesce(severe, 0) / n * categories, 6)::DOUBLE AS anomaly FROM g", S)
def _(v: Views):
    g = v.signals.groupBy(F.floor(F.col("lat") / 2).alias("a"), F.floor(F.col("lng") / 2).alias("b")).agg(
        F.count("*").alias("n"), F.countDistinct("category").alias("categories"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe")
    )
    return g.filter("n >= 5 and categories >= 2").select("a", "b", "n", "categories", F.round(F.col("severe") / F.col("n") * F.col("categories"), 6).alias("anomaly"))


@query("g9_tile_clusters", "p AS (SELECT id, (lng + 180) / 360 * 256 AS x, (0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 AS y FROM signals WHERE abs(lat) < 85) SELECT CAST(floor(x / 40) AS BIGINT) AS tx, CAST(floor(y / 40) AS BIGINT) AS ty, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM p GROUP BY 1, 2", S)
def _(v: Views):
    sine = F.sin(F.radians("lat"))
    p = v.signals.filter(F.abs("lat") < 85).select(((F.col("lng") + 180) / 360 * 256).alias("x"), ((0.5 - F.log((1 + sine) / (1 - sine)) / (4 * F.pi())) * 256).alias("y"))
    return p.groupBy(F.floor(F.col("x") / 40).alias("tx"), F.floor(F.col("y") / 40).alias("ty")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))
