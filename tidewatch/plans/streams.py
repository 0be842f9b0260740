"""Streaming operators and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..bind import AS_OF, Views
from ..functions import ranks as R
from ..functions import text as X
from ..operators import basic as B
from ..operators import stateful as Z
from ..session import ensure_checkpoint_dir
from ..sources import readers as In
from ..sources.polled import polled
from ..streaming import streams as ST
from .core import RANK4, S
from .registry import query
from .scoring import TIER

NOW = f"TIMESTAMP '{AS_OF}'"


TTL = """WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
    g AS (SELECT user_id, event_type, r, event_id, ts AS kept, true AS first FROM o WHERE r = 1
        UNION ALL SELECT o.user_id, o.event_type, o.r, o.event_id, CASE WHEN date_sub('second', g.kept, o.ts) >= 86400 THEN o.ts ELSE g.kept END, date_sub('second', g.kept, o.ts) >= 86400 FROM g JOIN o ON o.user_id = g.user_id AND o.event_type = g.event_type AND o.r = g.r + 1)
    SELECT {columns} FROM g WHERE first"""


@query("z1_url_dedup_ttl", TTL.format(columns="event_id"))
def _(v: Views):
    return Z.ttl_first(v.table("events"), ["user_id", "event_type"], "ts", "event_id", 86400)


@query("z4_hour_bucket_dedup", "SELECT source_id, category, date_trunc('hour', created_at) AS hour, min(id) AS id FROM signals GROUP BY ALL", S)
def _(v: Views):
    return v.signals.groupBy("source_id", "category", F.date_trunc("hour", "created_at").alias("hour")).agg(F.min("id").alias("id"))


@query("z5_day_direction_dedup", "SELECT user_id, CAST(created_at AS DATE) AS day, CASE WHEN value >= 35 THEN 'up' ELSE 'down' END AS direction, min(id) AS id FROM signals GROUP BY ALL", S)
def _(v: Views):
    return v.signals.groupBy("user_id", F.to_date("created_at").alias("day"), F.when(F.col("value") >= 35, "up").otherwise("down").alias("direction")).agg(F.min("id").alias("id"))


@query("z6_sliding_rate_limit")
def _(v: Views):
    """Admission depends on what was admitted before; held against a plain loop in tests."""
    return Z.rate_limited(v.table("events").filter("value >= 35"), ["user_id"], "ts", "event_id", 2, 86400)


@query("z7_tumbling_limits", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) <= 12")
def _(v: Views):
    day = v.table("events").withColumn("day", F.to_date("ts"))
    return B.top_n(day, ["event_type", "day"], [F.asc("ts"), F.asc("event_id")], 12).select("event_id")


@query("z8_cadence", "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def _(v: Views):
    return v.table("events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).filter("n > 2")


@query("z9_second_windows", "SELECT date_trunc('second', ts) AS second, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def _(v: Views):
    return v.table("events").groupBy(F.date_trunc("second", "ts").alias("second")).agg(F.count("*").alias("n")).filter("n > 1")


@query("z10_circuit_breaker")
def _(v: Views):
    """A state machine by key; the stream and a plain loop are held against it in tests."""
    return Z.breaker_changes(v.table("events").withColumn("bad", F.col("value") >= 35), "user_id", "ts", "bad", "event_id", 4)


@query("z11_heartbeat", f"SELECT source_id, max(created_at) AS last_at, max(created_at) <= {NOW} - INTERVAL 8 MINUTES AS stale FROM signals GROUP BY 1", S)
def _(v: Views):
    return v.signals.groupBy("source_id").agg(F.max("created_at").alias("last_at")).withColumn("stale", F.col("last_at") <= R.hours_before(v.as_of, 8 / 60))


@query("z13_session_bursts", "l AS (SELECT user_id, ts, CASE WHEN date_sub('second', lag(ts) OVER w, ts) < 21600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM l) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run".replace("l AS (", "WITH l AS (", 1))
def _(v: Views):
    return Z.session_runs(v.table("events"), "user_id", "ts", 21600)


@query("z14_tier_dispatch", f"SELECT id, CASE WHEN {TIER} = 'FLASH' THEN 'now' WHEN {TIER} = 'PRIORITY' AND reliability >= 0.6 THEN 'now' ELSE 'poll' END AS route FROM signals", S)
def _(v: Views):
    from ..functions import scores as C

    tier = C.alert_tier(F.col("severity"), F.col("reliability"), F.col("category"))
    return v.signals.select("id", F.when((tier == "FLASH") | ((tier == "PRIORITY") & (F.col("reliability") >= 0.6)), "now").otherwise("poll").alias("route"))


@query("z15_breaking_gate", "SELECT id, title FROM signals WHERE severity IN ('critical', 'high') AND reliability >= 0.6 QUALIFY row_number() OVER (PARTITION BY title, date_trunc('day', created_at) ORDER BY created_at, id) = 1", S)
def _(v: Views):
    gate = v.signals.filter(F.col("severity").isin("critical", "high") & (F.col("reliability") >= 0.6)).withColumn("day", F.to_date("created_at"))
    return B.top_n(gate, ["title", "day"], [F.asc("created_at"), F.asc("id")], 1).select("id", "title")


@query("z17_topic_sources", "SELECT title, CAST(created_at AS DATE) AS day, min(id) AS signal_id, count(*) AS reports, count(DISTINCT source_id) AS sources FROM signals GROUP BY 1, 2", S)
def _(v: Views):
    return v.signals.groupBy("title", F.to_date("created_at").alias("day")).agg(F.min("id").alias("signal_id"), F.count("*").alias("reports"), F.countDistinct("source_id").alias("sources"))


@query("z18_incremental_sync", f"SELECT id FROM signals WHERE created_at > {NOW} - INTERVAL 7 MINUTES - INTERVAL 2 HOURS AND created_at <= {NOW}", S)
def _(v: Views):
    """What a run since two hours ago reads: seven minutes more, so that late rows are seen; its sink is keyed, so doubles do no harm."""
    return v.signals.filter((F.col("created_at") > R.hours_before(v.as_of, 2 + 7 / 60)) & (F.col("created_at") <= v.as_of)).select("id")


@query("z19_adaptive_polling", f"SELECT source_id, count(*) AS n, CASE WHEN count(*) >= 5 THEN 300 * 0.5 WHEN count(*) = 0 THEN 600 ELSE 300 END::DOUBLE AS seconds FROM signals WHERE created_at > {NOW} - INTERVAL 6 HOURS GROUP BY 1", S)
def _(v: Views):
    return B.count_by(B.within_hours(v.signals, v.as_of, 6), "source_id").withColumn("seconds", F.when(F.col("n") >= 5, 150.0).otherwise(300.0))


@query("z12_stream_sliding_counts", "WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTES, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 30 MINUTES, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTES]) AS start FROM events) SELECT start AS start, event_type, count(*) AS n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES GROUP BY 1, 2")
def _(v: Views):
    """A real stream: sliding windows that the watermark has closed."""
    out = ST.run_available(ST.sliding_counts(ST.read_events(v.spark, v.folder), "event_type", "1 hour", "30 minutes", "10 minutes"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("z13_stream_sessions", "WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM l), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS \"end\", count(*) AS n FROM r GROUP BY user_id, run) SELECT * FROM g WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES")
def _(v: Views):
    out = ST.run_available(ST.sessions(ST.read_events(v.spark, v.folder), "user_id", "6 hours", "10 minutes"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("z1_stream_dedup", TTL.format(columns="event_id, user_id, event_type"))
def _(v: Views):
    """A real stream of twelve micro-batches: the first event of a user and type within a day of event time, equal to the batch twin."""
    return ST.run_available(ST.first_within(ST.replayed(v.table("events")), ["user_id", "event_type"], "event_id", 86400))


QUIET = """WITH l AS (SELECT user_id, epoch_us(ts) AS now, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events), c AS (SELECT user_id, (now + 480000000 + 239999999) // 240000000 * 240000000 AS checked, next FROM l)
    SELECT user_id, make_timestamp(checked) AS "at" FROM c WHERE checked < coalesce(next, (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events))"""


@query("z11_quiet_spells", QUIET)
def _(v: Views):
    """Checks every four minutes that first find a user's last event eight minutes old."""
    events = v.table("events")
    last = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return Z.quiet_spells(events, "user_id", "ts", 480, 240, last // 1000 * 1000 - 600_000_000 if last is not None else None)


@query("z11_stream_watchdog", QUIET)
def _(v: Views):
    """A real stream with timers of event time, equal to the batch twin up to the last watermark."""
    out = ST.run_available(ST.gone_quiet(ST.replayed(v.table("events")), "user_id", 480, 240))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("z20_maintained_counts", "SELECT user_id, sum(CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 ELSE 1 END)::BIGINT AS n FROM events GROUP BY 1")
def _(v: Views):
    """A real stream of twelve micro-batches that keeps each user's followers: errors take one away, views none, other events add one."""
    ensure_checkpoint_dir(v.spark)
    base = f"{v.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/counts-{uuid.uuid4().hex}"
    change = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 0).otherwise(1)
    stream = ST.replayed(v.table("events")).select("user_id", change.alias("change"))
    ST.count_each_batch(stream, ["user_id"], "change", base, f"{base}-log").awaitTermination()
    return ST.maintained_counts(v.spark, base, ["user_id"])


def _polls(v: Views, columns: list[str], polls: int = 5, overlap: int = 6 * 3600):
    """The events as they come in, polled so many times by runs that each go on where the one before stopped: yields a run's stream and its checkpoint.

    Every third event of the last hours before a poll comes after it, late by less than the overlap.
    """
    ensure_checkpoint_dir(v.spark)
    base = f"{v.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/polls-{uuid.uuid4().hex}"
    events = v.table("events").select(*columns).withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null")
    at = F.unix_micros("ts")
    timed = events.withColumn("at", at)
    last = timed.agg(F.max("at")).first()[0]
    if last is None:
        return
    moments = [*(int(m) for m in sorted(set(timed.approxQuantile("at", [i / polls for i in range(1, polls)], 0.001)))), last]
    poll = F.lit(len(moments) - 1)
    for i in reversed(range(len(moments) - 1)):
        late = (F.pmod("event_id", F.lit(3)) == 0) & (at > moments[i] - overlap * 1_000_000)
        poll = F.when(at <= moments[i], F.when(late, i + 1).otherwise(i)).otherwise(poll)
    events.withColumn("poll", poll).write.partitionBy("poll").parquet(f"{base}/all")
    for i, moment in enumerate(moments):
        v.spark.read.schema(events.schema).parquet(f"{base}/all/poll={i}").write.mode("append").parquet(f"{base}/feed")
        yield polled(v.spark, f"{base}/feed", events.schema, "ts", overlap, moment), base


@query("z18_polled_sync", "SELECT event_id, user_id, value, ts FROM events WHERE ts IS NOT NULL")
def _(v: Views):
    """Five polls of what has come, each a run of its own from the offsets of the last; late rows are found by the overlap, and none is there twice."""
    base = None
    for stream, base in _polls(v, ["event_id", "user_id", "value", "ts"]):
        ST.sync_each_batch(stream, ["event_id"], "ts", f"{base}/table", f"{base}/log").awaitTermination()
    out = ST.synced(v.spark, f"{base}/table", ["event_id"]) if base else v.table("events").select("event_id", "user_id", "value", "ts").limit(0)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("x8_polled_distress", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 16 AS status FROM events WHERE ts IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 16 IN (7, 14)")
def _(v: Views):
    """Frames of a polled stream: those that tell of distress are brought into a table with keys."""
    base = None
    for stream, base in _polls(v, ["event_id", "props", "ts"], 3):
        frames = stream.select("event_id", "ts", (F.get_json_object("props", "$.k").cast("int") % 16).alias("status"))
        ST.sync_each_batch(In.distress(frames), ["event_id"], "ts", f"{base}/table", f"{base}/log").awaitTermination()
    out = ST.synced(v.spark, f"{base}/table", ["event_id"]) if base else v.table("events").select("event_id", F.lit(0).alias("status")).limit(0)
    return out.select("event_id", "status")


@query("z10_stream_breaker")
def _(v: Views):
    """A real stream with keyed state: circuit breakers' changes."""
    events = ST.read_events(v.spark, v.folder).select("user_id", "ts", (F.col("value") >= 35).alias("bad"), F.col("event_id").alias("row"))
    return ST.run_available(ST.breakers(events, "user_id", "bad", 4), mode="append")


@query("w13_diversity")
def _(v: Views):
    """The newest 200 signals, thinned out by category; held against a plain loop in tests."""
    page = v.signals.orderBy(F.desc("created_at"), F.desc("id")).limit(200).select("id", "category", (-F.col("id")).alias("o"), "created_at")
    return Z.diverse(page.withColumn("o", -B.epoch("created_at") * 100000 - F.col("id")), "category", "o", 5, 2, 20)


@query("k11_greedy_clusters")
def _(v: Views):
    words = v.signals.withColumn("day", F.to_date("created_at")).withColumn("words", F.array_except(X.words(F.col("title")), F.array(*map(F.lit, ["event", "reported", "near"]))))
    return Z.greedy_clusters(words.filter("severity in ('critical', 'high')"), ["category", "day"], 2)


@query("k17_feed_dedup", f"l AS (SELECT category, country_code, created_at, reliability, id, CASE WHEN date_sub('second', lag(created_at) OVER w, created_at) < 21600 THEN 0 ELSE 1 END AS new FROM signals WINDOW w AS (PARTITION BY category, country_code ORDER BY created_at, id)), r AS (SELECT *, sum(new) OVER (PARTITION BY category, country_code ORDER BY created_at, id) AS run FROM l) SELECT category, country_code, arg_max(id, (reliability, -id)) AS id, count(*) - 1 AS related FROM r GROUP BY category, country_code, run", S)
def _(v: Views):
    from pyspark.sql import Window

    w = Window.partitionBy("category", "country_code").orderBy("created_at", "id")
    gap = F.timestamp_diff("SECOND", F.lag("created_at").over(w), F.col("created_at"))
    runs = v.signals.withColumn("new", F.when(gap < 21600, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("category", "country_code", "run").agg(F.max_by("id", F.struct(F.col("reliability"), -F.col("id"))).alias("id"), (F.count("*") - 1).alias("related")).drop("run")
