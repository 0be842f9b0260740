"""Feeds, bundles and file lists: whole documents in and out, and grouped backlogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bind import Views
from ..functions import feedrules as FR
from ..functions import text as X
from ..operators import graph as G
from ..operators import stateful as Z
from ..sources import adapters as A
from ..sources import readers as In
from ..sources import sinks as Out
from ..sources.adapters import Feed
from .core import S
from .registry import query

TOPIC = r"array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w: length(w) > 3)[1:5]), '_')"


@query("x12_backlog", f"SELECT {TOPIC} AS topic, count(*) AS n, count(DISTINCT source_id) AS sources, min(id) AS first_id FROM signals WHERE status = 'pending' AND title IS NOT NULL GROUP BY 1", S)
def _(v: Views):
    """What waits, grouped by topic, so that reports of one event are processed together."""
    waiting = v.signals.filter("status = 'pending' and title is not null").withColumn("topic", X.topic_key(F.col("title"), 5))
    return waiting.groupBy("topic").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.min("id").alias("first_id"))


@query("x13_z16_topic_batches", f"SELECT CAST(created_at AS DATE) AS day, {TOPIC} AS topic, count(*) AS n, count(DISTINCT source_id) AS sources, min(id) AS first_id FROM signals GROUP BY 1, 2", S)
def _(v: Views):
    """The batch twin of the micro-batches: a day is a batch, and its articles are grouped by topic."""
    rows = v.signals.select(F.to_date("created_at").alias("day"), X.topic_key(F.col("title"), 5).alias("topic"), "id", F.col("source_id").alias("source"))
    return rows.groupBy("day", "topic").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("id").alias("first_id"))


@query("x5_file_lists", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 > 0 THEN 'http://e.example/' || n_nationkey || '.export.CSV.zip' END AS url FROM nation")
def _(v: Views):
    k = F.col("n_nationkey").cast("string")
    line = lambda name: F.concat(F.lit("100 0abc http://e.example/"), k, F.lit(name))
    text = F.concat_ws("\n", line(".mentions.CSV.zip"), F.when(F.col("n_nationkey") % 3 > 0, line(".export.CSV.zip")), line(".gkg.csv.zip"), F.lit("short"))
    return In.export_urls(v.table("nation").select(F.col("n_nationkey").alias("id"), text.alias("value"))).select("id", "url")


FIRE_HEADER = "latitude,longitude,bright_ti4,confidence,acq_date,acq_time,frp"


@query("x6_fire_lines", "SELECT (user_id % 90)::DOUBLE AS latitude, -(user_id % 180)::DOUBLE AS longitude, (event_id % 50)::DOUBLE AS frp, ['n', 'h', ''][1 + event_id % 3] AS confidence FROM events WHERE event_id % 4 <> 0 AND event_id % 7 <> 0")
def _(v: Views):
    """Lines found by the header's names: low confidence (every fourth line) and numbers that aren't (every seventh) go."""
    text = lambda n: n.cast("string")
    confidence = F.when(F.col("event_id") % 4 == 0, " L").otherwise(F.element_at(F.array(F.lit("n"), F.lit("H"), F.lit("")), (1 + F.col("event_id") % 3).cast("int")))
    power = F.when(F.col("event_id") % 7 == 0, "NaN").otherwise(text(F.col("event_id") % 50))
    lines = v.table("events").select(F.concat_ws(",", text(F.col("user_id") % 90), text(-(F.col("user_id") % 180)), F.lit("300.1"), confidence, F.lit("2024-01-01"), F.lit("0042"), power).alias("value"))
    return In.fire_lines(lines, FIRE_HEADER).select("latitude", "longitude", "frp", F.coalesce("confidence", F.lit("")).alias("confidence"))


EDGES = "d AS (SELECT DISTINCT signal_id, entity_id FROM mentions), n AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM d a JOIN d b ON a.signal_id = b.signal_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"


@query(
    "y2_batched_edges",
    f"""{EDGES}, fresh AS (SELECT substr(sha256(a || '::co_occurs_with::' || b), 1, 16) AS id, a, b, round(least(1.0, n / 10.0), 6)::DOUBLE AS weight FROM n),
    old AS (SELECT id, a, b, 0.05::DOUBLE AS weight FROM fresh WHERE a = 'S1' UNION ALL SELECT 'kept', 'S0', 'S00', 0.7)
    SELECT id, coalesce(f.a, o.a) AS a, coalesce(f.b, o.b) AS b, coalesce(f.weight, o.weight) AS weight FROM fresh f FULL JOIN old o USING (id)""",
    "mentions",
)
def _(v: Views):
    """All edges of a run are written at once: new ones win over old ones of the same id."""
    size = G.sized(v.mentions)
    fresh = G.cooccurrence(v.mentions, 1, F.least(F.lit(1.0), F.col("n") / 10), size=size).select(F.substring(F.sha2(F.concat_ws("::co_occurs_with::", "a", "b"), 256), 1, 16).alias("id"), "a", "b", "weight").repartition(size[0], "id")
    kept = v.spark.createDataFrame([("kept", "S0", "S00", 0.7)], "id string, a string, b string, weight double")
    return Out.merged(fresh.filter("a = 'S1'").withColumn("weight", F.lit(0.05)).unionByName(kept), fresh, ["id"])


AT = "strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')"
PERCENT = "printf('%.0f', reliability * 100)"
ENTRY = (
    """'<entry><id>urn:signal:' || id || '</id><title>' || title || '</title><summary type="text">' || category || ' signal — severity: ' || severity || ' | reliability: ' || """
    + PERCENT
    + """ || '%</summary><updated>' || """
    + AT
    + """ || '</updated><category term="' || category || '"/><category term="severity:' || severity || '"/><category term="reliability:' || """
    + PERCENT
    + """ || '"/><country>' || country_code || '</country></entry>'"""
)
NEWEST = "newest AS (SELECT * FROM signals ORDER BY created_at DESC, id DESC LIMIT 100)"
SITE = "http://feed.example"
ENTRY_COLUMNS = ("id", "title", "created_at", "category", "severity", "reliability", "country_code")


@query("y6_atom", f"SELECT id, {ENTRY} AS entry FROM signals WHERE severity = 'critical'", S)
def _(v: Views):
    return v.signals.filter("severity = 'critical'").select("id", Out.atom_entry(*[F.col(c) for c in ENTRY_COLUMNS]).alias("entry"))


@query(
    "y6_atom_feed",
    f"""{NEWEST} SELECT '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<feed xmlns="http://www.w3.org/2005/Atom"><id>{SITE}</id><title>Signals</title><link href="{SITE}" rel="self"/><updated>'
    || strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ') || '</updated>' || string_agg({ENTRY}, '' ORDER BY created_at DESC, id DESC) || '</feed>' AS document FROM newest""",
    S,
)
def _(v: Views):
    return Out.atom_feed(v.signals, "Signals", SITE)


@query(
    "y6_json_feed",
    f"""{NEWEST} SELECT '{{"version":"https://jsonfeed.org/version/1.1","title":"Signals","feed_url":"{SITE}","items":[' || string_agg('{{"id":"urn:signal:' || id || '","title":"' || title || '","date_published":"' || {AT}
    || '","tags":["' || category || '","severity:' || severity || '","reliability:' || {PERCENT} || '","' || country_code || '"]}}', ',' ORDER BY created_at DESC, id DESC) || ']}}' AS document FROM newest""",
    S,
)
def _(v: Views):
    return Out.json_feed(v.signals, "Signals", SITE)


@query(
    "y6_opml",
    f"""cat AS (SELECT DISTINCT category AS c FROM signals) SELECT '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<opml version="2.0"><body>'
    || string_agg('<outline text="' || upper(c[1]) || c[2:] || '" type="rss" xmlUrl="{SITE}/category/' || c || '.xml"/>', '' ORDER BY c) || '</body></opml>' AS document FROM cat""",
    S,
)
def _(v: Views):
    return Out.opml(v.signals, "category", SITE)


CONFIDENCE = "CAST(least(100, greatest(0, CASE severity WHEN 'critical' THEN 95 WHEN 'high' THEN 80 WHEN 'medium' THEN 60 WHEN 'low' THEN 30 ELSE 15 END + floor((reliability - 0.5) * 20 + 0.5))) AS BIGINT)"


def stix_id(kind: str) -> str:
    h = f"md5('{kind}:' || id)"
    return f"'{kind}--' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def stix_head(kind: str) -> str:
    return f"""'{{"type":"{kind}","spec_version":"2.1","id":"' || {stix_id(kind)} || '","created":"' || {AT} || '","modified":"' || {AT} || '",' """


LABELS = """'"labels":["' || category || '","' || array_to_string(tags, '","') || '"],"confidence":' || confidence || '}'"""
INDICATOR = f"""{stix_head("indicator")} || '"name":"' || title || '","pattern":"[x-signal:value = ' || chr(39) || id || chr(39) || ']","pattern_type":"stix","valid_from":"' || {AT} || '",' || {LABELS}"""
LOCATION = f"""{stix_head("location")} || '"latitude":' || lat || ',"longitude":' || lng || ',"country":"' || country_code || '","region":"' || region || '"}}'"""
REPORT = f"""{stix_head("report")} || '"name":"' || title || '","report_types":["threat-report"],"published":"' || {AT} || '","object_refs":["' || {stix_id("indicator")} || '","' || {stix_id("location")} || '"],' || {LABELS}"""


@query(
    "y7_stix_bundle",
    f"""n AS (SELECT *, {CONFIDENCE} AS confidence FROM signals ORDER BY created_at DESC, id DESC LIMIT 100), o AS (SELECT id, created_at, {INDICATOR} || ',' || {LOCATION} || ',' || {REPORT} AS objects FROM n)
    SELECT '{{"type":"bundle","spec_version":"2.1","objects":[' || string_agg(objects, ',' ORDER BY created_at DESC, id DESC) || ']}}' AS document FROM o""",
    S,
)
def _(v: Views):
    """An indicator, a location and a report for each of the newest signals, in one bundle."""
    return Out.stix_bundle(v.signals)


@query(
    "y8_bundle",
    """n AS (SELECT * FROM signals WHERE status = 'verified' ORDER BY created_at DESC, id DESC LIMIT 50),
    t AS (SELECT count(*) AS total, '{"schema_version":"1.0","signals":[' || string_agg('{"category":"' || category || '","country_code":"' || country_code || '","id":' || id || ',"reliability":' || reliability || ',"severity":"' || severity || '","title":"' || title || '"}', ',' ORDER BY created_at DESC, id DESC) || '],"total_count":' || count(*) || '}' AS document FROM n)
    SELECT total, document, sha256(document) AS digest FROM t""",
    S,
)
def _(v: Views):
    """The 50 newest verified signals as canonical JSON with its digest; signing needs a key and is left out."""
    return Out.signed_bundle(v.signals)


#: Kinds of events stand for feeds; fires have the ladder of their detectors.
FEEDS = {
    "error": Feed("disaster", 10.0, ((1000, "critical"), (400, "high"), (100, "medium")), 1.0, 24, 100),
    "click": Feed("conflict", 20.0, ((150, "critical"), (110, "high"), (80, "medium")), 2.0, 12, 5),
    "view": Feed("health", 35.0, ((120, "high"), (60, "medium")), 5.0, 6, 3),
}
_feed = lambda value: "CASE feed " + " ".join(f"WHEN '{name}' THEN {value(f)}" for name, f in FEEDS.items()) + " END"
_ladder = lambda f: "CASE " + " ".join(f"WHEN measure >= {bound} THEN '{label}'" for bound, label in f.ladder) + " ELSE 'low' END"


@query(
    "x15_feed_reports",
    f"""rows_ AS (SELECT e.event_type AS feed, s.id, e.ts, s.lat, s.lng, e.value AS measure FROM signals s JOIN events e ON e.event_id = s.id), known AS (SELECT * FROM rows_ WHERE feed IN ({", ".join(f"'{n}'" for n in FEEDS)}) AND measure >= {_feed(lambda f: float(f.least))}),
    cells AS (SELECT feed, id, measure, CAST(floor(lat / {_feed(lambda f: float(f.degrees))}) AS BIGINT) AS cell_lat, CAST(floor(lng / {_feed(lambda f: float(f.degrees))}) AS BIGINT) AS cell_lng, CAST(floor(epoch_us(ts) / 1e6 / {_feed(lambda f: f.hours * 3600)}) AS BIGINT) AS span FROM known),
    found AS (SELECT feed, cell_lat, cell_lng, span, count(*) AS n, arg_max(id, (measure, -id)) AS id, max(measure) AS measure FROM cells GROUP BY 1, 2, 3, 4),
    best AS (SELECT *, row_number() OVER (PARTITION BY feed, span ORDER BY measure DESC, id) AS r FROM found)
    SELECT feed, cell_lat, cell_lng, span, n, measure, id, {_feed(_ladder)} AS severity, {_feed(lambda f: f"'{f.category}'")} AS category FROM best WHERE r <= {_feed(lambda f: f.most)} AND span % 3 <> 0""",
    S,
)
def _(v: Views):
    """Three feeds by one rule table; what came in every third span of time is known already."""
    rows = v.signals.select("id", "lat", "lng").join(v.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("feed"), "ts", F.col("value").alias("measure")), "id")
    found = A.reports(rows, FEEDS)
    return A.fresh(found, found.filter("span % 3 = 0"))


#: What the rows of the feeds say, in turn: most is met by some rule, some by none.
PHRASES = [
    "calm day", "battle near the town", "riot downtown", "violence against civilians", "airliner fire", "cargo flight", "Microsoft", "arms embargo", "terrorism", "asset list of Tunisia",
    "reactor shutdown", "INES level 3 event", "orphan source", "kidnapping", "Tornado Warning", "Flood Warning", "ransomware", "phishing", "hypersonic body", "dual-use optics", "earthquake", "drought",
    "GEOMAGNETIC STORM G4", "RADIO BLACKOUT R3", "SOLAR RADIATION STORM", "tsunami advisory", "information statement", "refugee crisis", "novel virus", "dengue cluster", None,
]
STATUSES = sorted({x for f in FR.FEEDS.values() for r in f.rules for x in r.status}) + ["other", None]
CODES = ["armed clash", "mass killing", "RED", "Yellow", "Immediate", "Future", "new designation", "G21J 1/00", "H04K 3/00", "H04L9/32", "other", None]
_texts = lambda xs: "[" + ", ".join("NULL" if x is None else "'" + x + "'" for x in xs) + "]::VARCHAR[]"


def _rule_sql(rule: FR.Rule) -> str:
    wanted = [
        rule.text is not None and f"regexp_matches(text, '{rule.text}')", bool(rule.status) and "status IN (" + ", ".join(f"'{x}'" for x in rule.status) + ")",
        rule.code is not None and f"regexp_matches(code, '{rule.code}')", rule.least is not None and f"measure >= {float(rule.least)}::DOUBLE",
        rule.above is not None and f"measure > {float(rule.above)}::DOUBLE", rule.places is not None and f"places >= {rule.places}", rule.days is not None and f"days <= {rule.days}",
    ]
    return " AND ".join(w for w in wanted if w)


def _feed_sql(feed: FR.FeedRules) -> str:
    gates = [f"WHEN NOT coalesce({x}, false) THEN NULL" for x in ([f"measure >= {float(feed.least)}::DOUBLE"] if feed.least is not None else []) + ([f"regexp_matches(text, '{feed.about}')"] if feed.about else [])]
    return "CASE " + " ".join(gates + [f"WHEN {_rule_sql(r)} THEN '{r.level}'" for r in feed.rules]) + (f" ELSE '{feed.otherwise}'" if feed.otherwise else "") + " END"


_each = lambda value: "CASE feed " + " ".join(f"WHEN '{n}' THEN {value(f)}" for n, f in FR.FEEDS.items()) + " END"


@query(
    "x15_feed_rules",
    f"""WITH RECURSIVE r AS (SELECT event_id AS id, ts, user_id % 50 AS key, ({_texts(FR.FEEDS)})[event_id % {len(FR.FEEDS)} + 1] AS feed, event_type || ' ' || ({_texts(PHRASES)})[event_id // 3 % {len(PHRASES)} + 1] AS text,
        ({_texts(STATUSES)})[event_id // 5 % {len(STATUSES)} + 1] AS status, ({_texts(CODES)})[event_id // 7 % {len(CODES)} + 1] AS code, value * ([0.01, 0.1, 1, 10, 1000, 1000000, 100000000]::DOUBLE[])[event_id // 2 % 7 + 1] AS measure, user_id % 10 AS places, user_id % 45 AS days FROM events),
    s AS (SELECT *, {_each(_feed_sql)} AS severity, CASE WHEN feed = 'aircraft_squawks' AND status = '7700' THEN 'disaster' ELSE {_each(lambda f: f"'{f.category}'")} END AS category, {_each(lambda f: int(f.hours * 3600))} AS ttl FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY feed, key ORDER BY ts, id) AS n FROM s WHERE severity IS NOT NULL),
    g AS (SELECT feed, key, n, id, severity, category, ts AS kept, ttl, true AS first FROM o WHERE n = 1 UNION ALL
        SELECT o.feed, o.key, o.n, o.id, o.severity, o.category, CASE WHEN date_sub('second', g.kept, o.ts) >= g.ttl THEN o.ts ELSE g.kept END, o.ttl, date_sub('second', g.kept, o.ts) >= g.ttl FROM g JOIN o ON o.feed = g.feed AND o.key = g.key AND o.n = g.n + 1)
    SELECT feed, id, category, severity FROM g WHERE first""",
)
def _(v: Views):
    """All feeds by the table of their rules: what they report, how severe it is, and no key again within a feed's time."""
    pick = lambda values, step: F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), (F.floor(F.col("event_id") / step) % len(values) + 1).cast("int"))
    scale = F.element_at(F.array(*map(F.lit, [0.01, 0.1, 1.0, 10.0, 1e3, 1e6, 1e8])), (F.floor(F.col("event_id") / 2) % 7 + 1).cast("int"))
    rows = v.table("events").select(
        F.col("event_id").alias("id"), "ts", (F.col("user_id") % 50).alias("key"), pick(FR.FEEDS, 1).alias("feed"), F.concat("event_type", F.lit(" "), pick(PHRASES, 3)).alias("text"),
        pick(STATUSES, 5).alias("status"), pick(CODES, 7).alias("code"), (F.col("value") * scale).alias("measure"), (F.col("user_id") % 10).alias("places"), (F.col("user_id") % 45).alias("days"),
    )
    rated = FR.reported(rows)
    first = Z.ttl_first(rated, ["feed", "key"], "ts", "id", FR.quiet_seconds())
    return rated.join(first, "id").select("feed", "id", "category", "severity")
