"""Filters, counts, pages and grids over signals: DataFrame in, DataFrame (or Column) out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks as R


def filter_list(df: DataFrame, **allowed: Sequence) -> DataFrame:
    """Keeps rows whose columns are in the given lists; empty lists don't filter."""
    for column, values in allowed.items():
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    return df


def within_hours(df: DataFrame, as_of: Column, hours: float, column: str = "created_at") -> DataFrame:
    """Rows of the last hours; the boundary itself is out.  The column stays bare, so the filter reaches the scan."""
    return df.filter(F.col(column) > R.hours_before(as_of, hours))


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Strictly inside the box."""
    return df.filter((F.col("lng") > west) & (F.col("lng") < east) & (F.col("lat") > south) & (F.col("lat") < north))


def haversine_km(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    h = F.pow(F.sin(F.radians(lat_a - lat_b) / 2), F.lit(2)) + F.cos(F.radians(lat_b)) * F.cos(F.radians(lat_a)) * F.pow(F.sin(F.radians(lng_a - lng_b) / 2), F.lit(2))
    return 2 * 6371 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def within_km(df: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    """Rows within a radius, with the distance; a latitude band goes to the scan first."""
    band = km / 111.0 + 0.01
    near = df.filter(F.col("lat").between(lat - band, lat + band))
    return near.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng))).filter(F.col("km") <= km)


def valid_coordinates(lat: str = "lat", lng: str = "lng") -> Column:
    a, b = F.col(lat), F.col(lng)
    finite = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    return finite & (F.abs(a) <= 90) & (F.abs(b) <= 180) & ~((a == 0) & (b == 0))


def overlaps(column: str, values: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values)))


def contains_all(column: str, values: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, values)), F.col(column))) == 0


def any_keyword(column: str, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.col(column).ilike(f"%{word}%")
    return out


def category_filter(category: str) -> Column:
    """``breaking`` stands for the two upper severities; any other name is a category."""
    return F.col("severity").isin("critical", "high") if category == "breaking" else F.col("category") == category


def quality_gate() -> Column:
    """The tiered editorial gate: a signal with few sources needs a higher reliability and a strategic category."""
    s, r, n, c = (F.col(x) for x in ("severity", "reliability", "source_count", "category"))
    tiers = (
        ((s == "critical") & (r >= 0.55) & (n >= 3))
        | ((s == "critical") & (r >= 0.70) & c.isin("disaster", "health", "security", "conflict"))
        | ((s == "high") & (r >= 0.55) & (n >= 2))
        | ((s == "high") & (r >= 0.70) & c.isin("conflict", "geopolitics", "security", "disaster", "health", "breaking"))
        | ((s == "medium") & (r >= 0.75) & c.isin("conflict", "geopolitics", "security", "disaster", "health", "economy", "elections"))
    )
    return tiers & ~c.isin("culture", "sports", "other")


def emit_guard(change: Column, by_category: dict[str, float], default: float) -> Column:
    out = None
    for category, least in by_category.items():
        hit = F.col("category") == category
        out = F.when(hit, change >= least) if out is None else out.when(hit, change >= least)
    return out.otherwise(change >= default)


def suspicious(df: DataFrame, limit: int = 10) -> DataFrame:
    weak = (F.col("reliability") < 0.6) | (F.col("source_count") < 2)
    return df.filter(F.col("severity").isin("critical", "high") & weak).orderBy("reliability", "id").limit(limit)


def match_rules(signals: DataFrame, rules: DataFrame, null_country_passes: bool = False) -> DataFrame:
    """Rule x signal matches; an empty list of a rule matches everything.

    Rules are few and configured, so the join is by condition; Spark broadcasts them by their size.
    """
    rank = F.element_at(F.create_map(*[x for label, r in zip(R.SEVERITIES, R.RANK_4) for x in (F.lit(label), F.lit(r))]), F.col("min_severity"))
    r = rules.withColumn("min_rank", rank).withColumnsRenamed({"categories": "r_categories", "country_codes": "r_countries"})
    hay = F.lower(F.col("title"))
    country = F.array_contains("r_countries", F.col("country_code"))
    if null_country_passes:
        country = F.col("country_code").isNull() | country
    match = (
        (R.by_severity(R.RANK_4, default=0) >= F.col("min_rank"))
        & ((F.size("r_categories") == 0) | F.array_contains("r_categories", F.col("category")))
        & ((F.size("r_countries") == 0) | country)
        & ((F.size("keywords") == 0) | F.exists("keywords", lambda w: F.contains(hay, F.lower(w))))
    )
    return signals.join(r, match)


def cooling(as_of: Column) -> Column:
    """Whether a rule that fired at ``last_at`` still rests for its ``cooldown`` minutes."""
    until = F.timestamp_add("MINUTE", F.col("cooldown"), F.col("last_at"))
    return F.coalesce(until > as_of, F.lit(False))


def sanitise(text: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")), 1, most)


def matches_any(column: str, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | F.col(column).rlike(pattern)
    return out


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def window_counts(df: DataFrame, as_of: Column, hours: dict[str, float]) -> DataFrame:
    """The total and the counts of several trailing windows, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col("created_at") > R.hours_before(as_of, h)).alias(name) for name, h in hours.items()])


def calendar_fill(daily: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row for each of the last days, with zeros where ``daily`` (keyed by ``day``) has none."""
    last = F.to_date(as_of)
    calendar = daily.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in daily.columns if c != "day"]
    return calendar.join(daily, "day", "left").select("day", *counts)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows of each group; Spark limits groups before they are shuffled."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) <= n)


def mode_by(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value of a column in each group, with its count; ties go to the least value."""
    counts = df.groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return top_n(counts, keys, [F.desc("n"), F.asc("value")], 1).drop("place")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of each column, in one pass over grouping sets."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which = None
    for i, c in enumerate(columns):
        mask = (1 << len(columns)) - 1 - (1 << len(columns) - 1 - i)
        which = F.when(F.col("g") == mask, c) if which is None else which.when(F.col("g") == mask, c)
    return sets.select(which.alias("facet"), F.coalesce(*columns).alias("value"), "n")


def headlines(df: DataFrame, limit: int) -> DataFrame:
    place = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return df.orderBy(place, F.desc("created_at"), "id").limit(limit)


def keyset_page(df: DataFrame, cursor: int, size: int) -> DataFrame:
    """The page after a row, newest first; one row more than the page tells that there are more."""
    at = df.filter(F.col("id") == cursor).select(F.struct("created_at", "id").alias("cursor"))
    rest = df.join(F.broadcast(at), F.struct("created_at", "id") < F.col("cursor")).orderBy(F.desc("created_at"), F.desc("id")).limit(size + 1)
    return rest.withColumn("on_page", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))) <= size)


def offset_page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))


def due_sources(df: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Sources whose last visit is at least so long ago, by tier."""
    due = F.col("last_at") + F.expr(f"INTERVAL {minutes} MINUTES") <= as_of
    order = F.when(F.col("tier") == "wire", 0).when(F.col("tier") == "national", 1).otherwise(2)
    return df.withColumn("due", due).filter("due").orderBy(order, "source_id")


def jaccard(a: str, b: str) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def last_distinct(column: str, n: int) -> Column:
    """The n greatest distinct values, ascending."""
    values = F.array_sort(F.collect_set(column))
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def epoch(column: str) -> Column:
    """Seconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))


def time_bucket(column: str, seconds: int) -> Column:
    start = F.floor(epoch(column) / seconds) * seconds
    return F.timestamp_add("SECOND", start, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def decay_ranked(df: DataFrame, as_of: Column, half_life: float) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("created_at"), as_of) / F.lit(3600.0)
    worth = R.by_severity(R.WEIGHT_FEED) + 0.1 * F.col("source_count")
    return df.withColumn("score", F.round(worth * F.pow(F.lit(0.5), age / half_life), 6))


def timeline(df: DataFrame, seconds: int, most: int) -> DataFrame:
    """The newest rows of each time bucket, with the bucket's count."""
    bucketed = df.withColumn("bucket", time_bucket("created_at", seconds))
    counts = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    return top_n(bucketed, ["bucket"], [F.desc("created_at"), F.asc("id")], most).join(counts, "bucket")


def hotspot_cells(df: DataFrame, min_categories: int, limit: int) -> DataFrame:
    """Cells of one degree in which several categories meet."""
    cells = df.groupBy(F.round("lat").cast("long").alias("lat_cell"), F.round("lng").cast("long").alias("lng_cell")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("category")).alias("names"), F.round(F.avg("reliability"), 6).alias("reliability"), F.max(R.by_severity(R.RANK_4)).alias("worst")
    )
    cells = cells.withColumn("categories", F.size("names").cast("long")).filter(F.col("categories") >= min_categories)
    return cells.orderBy(F.desc("categories"), F.desc("n"), "lat_cell", "lng_cell").limit(limit)


def floor_grid(df: DataFrame, limit: int) -> DataFrame:
    cells = df.groupBy(F.floor("lat").alias("a"), F.floor("lng").alias("b")).agg(
        F.count("*").alias("n"), F.max("value").alias("strongest"), F.max_by("id", F.struct("value", "id")).alias("strongest_id")
    )
    return cells.withColumn("lat", F.col("a") + 0.5).withColumn("lng", F.col("b") + 0.5).orderBy(F.desc("n"), "a", "b").limit(limit)


def wind_grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """A synthetic circulation on a latitude x longitude grid."""
    i, j = F.floor(F.col("id") / columns), F.col("id") % columns
    grid = spark.range(rows * columns).select((90 - (i + 0.5) * 180 / rows).alias("lat"), (j * 360.0 / columns - 180).alias("lng"))
    u = 10 * F.cos(F.radians(3 * F.col("lat"))) + 2 * F.sin(F.radians(2 * F.col("lng")))
    w = 3 * F.sin(F.radians(2 * F.col("lat"))) * F.cos(F.radians(3 * F.col("lng")))
    return grid.select("lat", "lng", u.alias("u"), w.alias("v"))
