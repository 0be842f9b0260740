"""The event-intelligence tables, derived from the provided ones, as DataFrames and as SQL.

``Views`` builds each view lazily for a session and a folder; ``SQL`` has the same view
as a common table expression, so that a query and its oracle start from equal rows.
All derivations are whole-number or IEEE double arithmetic.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which queries over events and over orders are asked.
AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-08-02 00:00:00"

#: Categories of the event types and severities from values; fixed by the bindings.
CATEGORY = {"signup": "economy", "error": "security", "click": "conflict", "view": "disaster"}
SEVERITY = [(150, "critical"), (110, "high"), (80, "medium"), (35, "low")]


def _case(column, pairs, default):
    out = None
    for value, label in pairs:
        hit = column == value if isinstance(value, str) else column >= value
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")

    @cached_property
    def signals(self) -> DataFrame:
        e = self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
        return e.select(
            F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
            _case(F.col("event_type"), CATEGORY.items(), "health").alias("category"),
            _case(F.col("value"), SEVERITY, "info").alias("severity"),
            text("s", F.col("user_id") % 20).alias("source_id"),
            F.array(text("s", F.col("user_id") % 20), text("s", F.col("k") % 20)).alias("source_ids"),
            (1 + F.col("k") % 4).alias("source_count"),
            ((30 + (F.col("event_id") * 37) % 70) / F.lit(100.0)).alias("reliability"),
            (((F.col("user_id") * 7919) % 17000) / F.lit(100.0) - 85).alias("lat"),
            (((F.col("user_id") * 104729) % 36000) / F.lit(100.0) - 180).alias("lng"),
            text("C", F.col("user_id") % 25).alias("country_code"), text("R", F.col("user_id") % 6).alias("region"),
            F.when(F.col("event_id") % 10 < 7, "verified").when(F.col("event_id") % 10 < 9, "pending").otherwise("disputed").alias("status"),
            F.array("event_type", text("k", F.col("k") % 12), text("u", F.col("user_id") % 7)).alias("tags"),
            F.concat_ws(" ", F.col("event_type"), F.lit("event reported near"), text("place", F.col("user_id") % 40), F.lit("by"), text("unit", F.col("k") % 9)).alias("title"),
            "user_id", "value", "k",
        )

    @cached_property
    def orders(self) -> DataFrame:
        o, c, n, r = (self.table(t) for t in ("orders", "customer", "nation", "region"))
        joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        severity = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "high")
        severity = severity.when(F.col("o_orderpriority").startswith("3"), "medium").when(F.col("o_orderpriority").startswith("4"), "low").otherwise("info")
        status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "P", "pending").otherwise("disputed")
        return joined.select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("c_mktsegment").alias("category"), severity.alias("severity"),
            status.alias("status"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("o_custkey").alias("author_id"),
            ((30 + (F.col("o_orderkey") * 37) % 70) / F.lit(100.0)).alias("reliability"), (1 + F.col("o_orderkey") % 4).alias("source_count"),
            F.col("o_totalprice").alias("amount"),
        )

    @cached_property
    def docs(self) -> DataFrame:
        d, marks = self.table("documents"), self.table("labels")
        return d.join(marks, "doc_id", "left").select(
            F.col("doc_id").alias("id"), F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.col("text").alias("body"), F.col("lang").alias("language"),
            "source", (F.coalesce("toxic", F.lit(0)) == 1).alias("disputed"), (F.coalesce("quality", F.lit(0)) == 1).alias("corroborated"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("signal_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity_id"), F.col("l_shipdate").alias("seen_at"),
            F.when(F.col("l_suppkey") % 3 == 0, "person").when(F.col("l_suppkey") % 3 == 1, "organisation").otherwise("location").alias("type"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    @cached_property
    def segments(self) -> DataFrame:
        t = self.table("conversations")
        start = (F.col("turn") * 10 + F.col("conv_id") % 3).cast("long")
        return t.select("conv_id", "turn", F.col("role").alias("speaker"), "text", start.alias("start_s"), (start + 4 + F.length("text") % 9).cast("long").alias("end_s"))


SQL: dict[str, str] = {
    "signals": """signals AS (
    SELECT event_id AS id, ts AS created_at,
        CASE event_type WHEN 'signup' THEN 'economy' WHEN 'error' THEN 'security' WHEN 'click' THEN 'conflict' WHEN 'view' THEN 'disaster' ELSE 'health' END AS category,
        CASE WHEN value >= 150 THEN 'critical' WHEN value >= 110 THEN 'high' WHEN value >= 80 THEN 'medium' WHEN value >= 35 THEN 'low' ELSE 'info' END AS severity,
        's' || (user_id % 20) AS source_id, ['s' || (user_id % 20), 's' || (k % 20)] AS source_ids, 1 + k % 4 AS source_count,
        CAST(30 + (event_id * 37) % 70 AS DOUBLE) / 100 AS reliability,
        CAST((user_id * 7919) % 17000 AS DOUBLE) / 100 - 85 AS lat, CAST((user_id * 104729) % 36000 AS DOUBLE) / 100 - 180 AS lng,
        'C' || (user_id % 25) AS country_code, 'R' || (user_id % 6) AS region,
        CASE WHEN event_id % 10 < 7 THEN 'verified' WHEN event_id % 10 < 9 THEN 'pending' ELSE 'disputed' END AS status,
        [event_type, 'k' || (k % 12), 'u' || (user_id % 7)] AS tags,
        event_type || ' event reported near place' || (user_id % 40) || ' by unit' || (k % 9) AS title, user_id, value, k
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e)""",
    "orders_s": """orders_s AS (
    SELECT o_orderkey AS id, o_orderdate AS created_at, c_mktsegment AS category,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity,
        CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'P' THEN 'pending' ELSE 'disputed' END AS status,
        n_name AS country, r_name AS region, o_custkey AS author_id, CAST(30 + (o_orderkey * 37) % 70 AS DOUBLE) / 100 AS reliability,
        1 + o_orderkey % 4 AS source_count, o_totalprice AS amount
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "docs": """docs AS (
    SELECT d.doc_id AS id, substr(split_part(text, chr(10), 1), 1, 120) AS title, text AS body, lang AS language, source,
        coalesce(toxic, 0) = 1 AS disputed, coalesce(quality, 0) = 1 AS corroborated
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "mentions": """mentions AS (
    SELECT l_orderkey AS signal_id, 'S' || l_suppkey AS entity_id, l_shipdate AS seen_at,
        CASE l_suppkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organisation' ELSE 'location' END AS type FROM lineitem)""",
    "vectors": """vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)""",
    "segments": """segments AS (
    SELECT conv_id, turn, role AS speaker, text, turn * 10 + conv_id % 3 AS start_s, turn * 10 + conv_id % 3 + 4 + length(text) % 9 AS end_s FROM conversations)""",
}


def with_views(body: str, *views: str) -> str:
    """The SQL of a query over views; a body may begin with further expressions, each after a comma."""
    return "WITH " + ",\n".join(SQL[v] for v in views) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body.strip()
