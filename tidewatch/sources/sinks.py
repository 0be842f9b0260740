"""Sinks and exports: merges, snapshots, logs and document formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..operators.basic import top_n


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert: rows of ``new`` win, by key; columns that ``new`` has as null keep their old value."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest])
    return old.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"new_{c}", c).alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` does not have, each key once."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def retained(df: DataFrame, column: str, as_of: Column, hours: float) -> DataFrame:
    return df.filter(F.col(column) > R.hours_before(as_of, hours))


def write_log(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends to a log that is partitioned by month, so that old months can be dropped and scans pruned."""
    df.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def dead_letters(df: DataFrame, most_rows: int, most_attempts: int) -> DataFrame:
    """The newest failed rows, one attempt later; rows out of attempts go."""
    newest = df.orderBy(F.desc("ts"), F.desc("id")).limit(most_rows)
    return newest.withColumn("attempts", F.col("attempts") + 1).filter(F.col("attempts") < most_attempts)


def geojson_feature(lat: str, lng: str, properties: list[str]) -> Column:
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")).alias("geometry"),
            F.struct(*properties).alias("properties"),
        )
    )


def escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def atom_entry(id_: Column, title: Column, updated: Column, category: Column, severity: Column, reliability: Column, country: Column) -> Column:
    """A feed entry with its categories, severity and reliability."""
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    term = lambda *x: F.concat(F.lit('<category term="'), *x, F.lit('"/>'))
    percent = F.format_string("%.0f", reliability * 100)
    summary = F.concat(escaped(category), F.lit(" signal — severity: "), escaped(severity), F.lit(" | reliability: "), percent, F.lit("%"))
    return F.concat(
        F.lit("<entry>"), tag("id", F.concat(F.lit("urn:signal:"), id_.cast("string"))), tag("title", escaped(title)), F.lit('<summary type="text">'), summary, F.lit("</summary>"),
        tag("updated", F.date_format(updated, ISO)), term(escaped(category)), term(F.lit("severity:"), severity), term(F.lit("reliability:"), percent), tag("country", escaped(country)), F.lit("</entry>"),
    )


def _collected(rows: DataFrame, most: int, value: Column, *aggregates: Column) -> DataFrame:
    """The values of the newest rows, a page of bounded size, in one row: an array, newest first, and further aggregates."""
    page = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("created_at", "id", value.alias("value"))
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("at"), (-F.col("id")).alias("no"), "value")))
    return page.agg(F.transform(newest, lambda x: x["value"]).alias("items"), F.max("created_at").alias("updated"), *aggregates)


def atom_feed(rows: DataFrame, title: str, link: str, most: int = 100) -> DataFrame:
    """One Atom document of the newest rows."""
    entry = atom_entry(*[F.col(c) for c in ("id", "title", "created_at", "category", "severity", "reliability", "country_code")])
    feed = _collected(rows, most, entry)
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom"><id>{link}</id><title>{title}</title><link href="{link}" rel="self"/><updated>'
    return feed.select(F.concat(F.lit(head), F.coalesce(F.date_format("updated", ISO), F.lit("")), F.lit("</updated>"), F.array_join("items", ""), F.lit("</feed>")).alias("document"))


def json_feed(rows: DataFrame, title: str, link: str, most: int = 100) -> DataFrame:
    """One JSON Feed document of the newest rows."""
    tags = F.array(F.col("category"), F.concat(F.lit("severity:"), "severity"), F.concat(F.lit("reliability:"), F.format_string("%.0f", F.col("reliability") * 100)), F.col("country_code"))
    item = F.struct(F.concat(F.lit("urn:signal:"), F.col("id").cast("string")).alias("id"), F.col("title"), F.date_format("created_at", ISO).alias("date_published"), tags.alias("tags"))
    feed = _collected(rows, most, item)
    return feed.select(F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.lit(title).alias("title"), F.lit(link).alias("feed_url"), F.col("items"))).alias("document"))


def opml(categories: DataFrame, column: str, link: str) -> DataFrame:
    """One OPML document that lists a feed a category."""
    outline = F.concat(F.lit('<outline text="'), F.initcap(column), F.lit(f'" type="rss" xmlUrl="{link}/category/'), F.col(column), F.lit('.xml"/>'))
    lines = categories.select(column).distinct().agg(F.array_join(F.array_sort(F.collect_list(outline)), "").alias("lines"))
    return lines.select(F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<opml version="2.0"><body>'), "lines", F.lit("</body></opml>")).alias("document"))


def _stix_id(kind: str) -> Column:
    """An identifier that depends on the report alone, so that reruns agree."""
    h = F.md5(F.concat_ws(":", F.lit(kind), F.col("id").cast("string")))
    return F.concat_ws("-", F.lit(f"{kind}-"), F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def stix_objects(rows: DataFrame) -> DataFrame:
    """id, confidence and objects: the indicator, the location and the report that stand for a row, as JSON texts."""
    at = F.date_format("created_at", ISO)
    confidence = stix_confidence(F.col("severity"), F.col("reliability"))
    labels = F.concat(F.array("category"), F.col("tags"))
    common = lambda kind: [F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), _stix_id(kind).alias("id"), at.alias("created"), at.alias("modified")]
    pattern = F.concat(F.lit("[x-signal:value = '"), F.col("id").cast("string"), F.lit("']"))
    indicator = F.struct(*common("indicator"), F.col("title").alias("name"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), at.alias("valid_from"), labels.alias("labels"), confidence.alias("confidence"))
    location = F.struct(*common("location"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), F.col("country_code").alias("country"), F.col("region"))
    report = F.struct(
        *common("report"), F.col("title").alias("name"), F.array(F.lit("threat-report")).alias("report_types"), at.alias("published"),
        F.array(_stix_id("indicator"), _stix_id("location")).alias("object_refs"), labels.alias("labels"), confidence.alias("confidence"),
    )
    return rows.select("id", "created_at", confidence.alias("confidence"), F.array(F.to_json(indicator), F.to_json(location), F.to_json(report)).alias("objects"))


def stix_bundle(rows: DataFrame, most: int = 100) -> DataFrame:
    """One bundle of the newest rows' objects."""
    bundle = _collected(stix_objects(rows), most, F.array_join("objects", ","))
    return bundle.select(F.concat(F.lit('{"type":"bundle","spec_version":"2.1","objects":['), F.array_join("items", ","), F.lit("]}")).alias("document"))


def stix_confidence(severity: Column, reliability: Column) -> Column:
    base = R.by_severity(R.CONFIDENCE_STIX, severity, 15)
    return R.clamp(base + R.js_round((reliability - 0.5) * 20), 0, 100).cast("long")


def canonical_digest(columns: list[str]) -> Column:
    """SHA-256 of the row's canonical JSON: keys in order, no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def signed_bundle(rows: DataFrame, most: int = 50) -> DataFrame:
    """The newest verified rows as one canonical JSON text, and its SHA-256."""
    item = F.to_json(F.struct(*[F.col(c) for c in sorted(("id", "title", "severity", "category", "country_code", "reliability"))]))
    bundle = _collected(rows.filter("status = 'verified'"), most, item, F.count("*").alias("n"))
    text = F.concat(F.lit('{"schema_version":"1.0","signals":['), F.array_join("items", ","), F.lit('],"total_count":'), F.col("n").cast("string"), F.lit("}"))
    return bundle.select(F.col("n").alias("total"), text.alias("document"), F.sha2(text, 256).alias("digest"))


def fan_out(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Event x hook deliveries; an empty filter of a hook lets everything pass.  Hooks are few; Spark broadcasts them by size."""
    rank = R.by_severity(R.RANK_4, "severity", 0)
    hit = (rank >= F.col("min_rank")) & ((F.size("h_categories") == 0) | F.array_contains("h_categories", F.col("category"))) & ((F.size("h_countries") == 0) | F.array_contains("h_countries", F.col("country_code")))
    return events.join(hooks, hit)


def broadcast_targets(events: DataFrame, clients: DataFrame) -> DataFrame:
    """Event x client deliveries: subscribed categories, own events, and critical ones for all."""
    hit = (F.col("severity") == "critical") | F.array_contains("subscribed", F.col("category")) | (F.col("user_id") == F.col("client_user"))
    return events.join(clients, hit)


def search_docs(df: DataFrame, since: Column | None = None) -> DataFrame:
    """The search index's documents, with times in seconds, of all rows or of those since a moment."""
    rows = df.filter(F.col("created_at") > since) if since is not None else df
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at"))
    return rows.select("id", "title", "category", "severity", "country_code", "reliability", seconds.alias("created_s"))


def newest_per_key(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    return top_n(df, keys, [F.desc("created_at"), F.desc("id")], most).drop("place")
