"""Indices, baselines, anomalies and trends as grouped and windowed aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions import scores as C
from .basic import top_n

def _all():
    return Window.partitionBy()


def _recent(as_of: Column, hours: float) -> Column:
    return F.count_if(F.col("created_at") > R.hours_before(as_of, hours))


def min_max(df: DataFrame, column: str) -> DataFrame:
    """``scaled``: the column between the least and the greatest of the result."""
    low, high = F.min(column).over(_all()), F.max(column).over(_all())
    return df.withColumn("scaled", (F.col(column) - low) / F.coalesce(F.nullif((high - low).cast("double"), F.lit(0.0)), F.lit(1.0)))


def country_index(df: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The riskiest countries, scored 10 to 95 within the result."""
    t = df.groupBy("country_code").agg(
        F.count("*").alias("n"), F.sum(R.by_severity(R.WEIGHT_COUNTRY)).alias("raw"), F.max(R.by_severity(R.RANK_4)).alias("worst"),
        F.array_sort(F.collect_set("category")).alias("categories"), F.round(F.avg("reliability"), 2).alias("reliability"), _recent(as_of, 6).alias("n6"),
    ).orderBy(F.desc("raw"), "country_code").limit(limit)
    scored = min_max(t, "raw").withColumn("score", R.js_round(F.col("scaled") * 85 + 10))
    trend = F.when(F.col("n6") > F.col("n") * 0.5, "rising").when(F.col("n6") > F.col("n") * 0.25, "stable").otherwise("falling")
    return scored.select("country_code", "n", "score", C.band(F.col("score")).alias("band"), "worst", "categories", "reliability", trend.alias("trend"))


def country_detail(df: DataFrame) -> DataFrame:
    """Countries scored on a logarithmic scale of their categories' worst severities."""
    by_category = df.groupBy("country_code", "category").agg(F.count("*").alias("n"), F.max(R.by_severity(R.RANK_4)).alias("worst"))
    weight = F.element_at(F.array(*[F.lit(x) for x in (0, 15, 40, 70, 100)]), F.col("worst") + 1)
    raw = by_category.groupBy("country_code").agg(F.sum(F.col("n") * weight).alias("raw"), F.sum("n").alias("n"))
    scored = raw.withColumn("score", F.least(F.lit(95), R.js_round(F.log(F.col("raw") + 1) / F.log(F.lit(5001)) * 85 + 10)))
    return scored.select("country_code", "n", "score", C.band(F.col("score")).alias("band"))


def resilience(df: DataFrame, dimension: dict[str, str], weights: dict[str, float]) -> DataFrame:
    """Six dimensions a country and their weighted composite; a category without a dimension adds a fifth of its risk to each."""
    risk = df.groupBy("country_code", "category").agg(F.sum(R.by_severity(R.WEIGHT_COUNTRY)).alias("risk"))
    known = F.create_map(*[F.lit(x) for pair in dimension.items() for x in pair])
    own = F.try_element_at(known, F.col("category"))
    sums = risk.groupBy("country_code").agg(*[F.sum(F.when(own == d, F.col("risk") * 1.0).when(own.isNull(), F.col("risk") * 0.2).otherwise(0.0)).alias(d) for d in weights])
    scores = {d: F.greatest(F.lit(0.0), 100 - F.when(F.col(d) > 0, F.least(F.lit(100), R.js_round(F.log(F.col(d) + 1) / F.log(F.lit(10001)) * 100))).otherwise(0)) for d in weights}
    composite = sum((scores[d] * w for d, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return sums.select("country_code", R.js_round(composite + 1e-9).alias("composite"), *[s.cast("long").alias(d) for d, s in scores.items()])


def threat_index(df: DataFrame) -> DataFrame:
    """One level from 1 to 5 for all rows; no rows give level 1."""
    n = F.count("*")
    level = 1 + 4 * F.sum(R.by_severity(R.WEIGHT_THREAT)) / (5 * F.nullif(n, F.lit(0)))
    return df.agg(n.alias("n"), F.coalesce(R.clamp(R.js_round(level), 1, 5), F.lit(1)).cast("long").alias("level"))


def escalation_index(df: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Each country's score for the last window against the one before, and that one's against its own."""
    edges = [R.hours_before(as_of, hours * i) for i in range(4)]
    rows = df.filter(F.col("created_at") > edges[3])
    inside = [(F.col("created_at") > edges[i + 1]) & ((F.col("created_at") <= edges[i]) if i else F.lit(True)) for i in range(3)]
    rank = R.by_severity(R.WEIGHT_ESCALATION)
    counts = rows.groupBy("country_code").agg(
        *[F.count_if(w).alias(f"n{i}") for i, w in enumerate(inside)], *[F.coalesce(F.sum(F.when(w, rank)), F.lit(0)).alias(f"w{i}") for i, w in enumerate(inside[:2])]
    )
    scored = counts.select("country_code", C.escalation(F.col("n0"), F.col("n1"), F.col("w0")).alias("score"), C.escalation(F.col("n1"), F.col("n2"), F.col("w1")).alias("before"))
    return scored.withColumn("level", C.escalation_level(F.col("score"))).withColumn("trend", C.trend(F.col("score"), F.col("before"), 5))


def rate_trend(df: DataFrame, as_of: Column, key: str, recent: int, whole: int) -> DataFrame:
    counts = df.groupBy(key).agg(_recent(as_of, recent).alias("n6"), F.count("*").alias("n"))
    rate, usual = F.col("n6") / recent, F.col("n") / whole
    return counts.withColumn("trend", F.when((rate > 2 * usual) & (F.col("n6") >= 3), "increasing").when(rate < 0.5 * usual, "decreasing").otherwise("stable"))


def convergence(df: DataFrame, degrees: float, least: int) -> DataFrame:
    newest = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id")))), 1, 3), lambda x: x["id"])
    cells = df.groupBy(F.floor(F.col("lat") / degrees).alias("a"), F.floor(F.col("lng") / degrees).alias("b"))
    return cells.agg(F.count("*").alias("n"), F.countDistinct("category").alias("categories"), newest.alias("newest"), F.max("created_at").alias("last_at")).filter(F.col("n") >= least)


def topic_groups(df: DataFrame) -> DataFrame:
    """Reports of one topic with an initial reliability: their number, their sources' trust by tier, authority and diversity.

    A source's tier follows from its number, as the bindings have none.
    """
    number = F.substring("source_id", 2, 9).cast("int") % 3
    tier = F.when(number == 0, "wire").when(number == 1, "institutional").otherwise("regional")
    weight = F.when(number == 0, 1.5).when(number == 1, 1.3).otherwise(1.0)
    g = df.groupBy("title").agg(
        F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), (F.sum(F.col("reliability") * weight) / F.sum(weight)).alias("trust"), F.collect_set(tier).alias("tiers"),
        F.max("reliability").alias("best"),
    )
    has = lambda name: F.array_contains("tiers", name)
    authority = F.when(has("wire"), 0.25).when(has("institutional"), 0.20).when(F.col("best") >= 0.8, 0.12).otherwise(0.05)
    diversity = F.when(F.size("tiers") >= 3, 0.15).when(F.size("tiers") >= 2, 0.10).otherwise(0.03)
    initial = 0.30 * F.least(F.col("n") / 3, F.lit(1.0)) + 0.30 * F.col("trust") + authority + diversity
    return g.select("title", "n", "sources", F.round(F.least(F.lit(1.0), initial) + 1e-9, 4).alias("initial"))


def verification(df: DataFrame) -> DataFrame:
    """Four weighted checks a country and category; the more severe, the higher the bar."""
    g = df.groupBy("country_code", "category").agg(
        F.countDistinct("source_id").alias("sources"), F.avg("reliability").alias("trust"), F.max(R.by_severity(R.RANK_4)).alias("worst"), F.countDistinct("region").alias("regions")
    )
    score = 0.35 * F.least(F.col("sources") / 3, F.lit(1.0)) + 0.35 * F.col("trust") + 0.15 * (F.col("sources") >= 2).cast("int") + 0.15 * F.least(F.col("regions") / 2, F.lit(1.0))
    bar = F.when(F.col("worst") == 4, 0.80).when(F.col("worst") == 3, 0.75).otherwise(0.70)
    floor = F.when(F.col("worst") == 4, 0.20).when(F.col("worst") == 3, 0.25).otherwise(0.30)
    g = g.withColumn("score", score)
    return g.select("country_code", "category", F.round("score", 4).alias("score"), F.when(F.col("score") >= bar, "verified").when(F.col("score") >= floor, "pending").otherwise("disputed").alias("status"))


def summary_parts(df: DataFrame, parts: dict[str, tuple[str, int | None]]) -> DataFrame:
    """Counts by several keys, one under the other; a number keeps a part's most frequent keys."""
    out = None
    for part, (key, most) in parts.items():
        counts = df.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n"))
        if most:
            counts = counts.orderBy(F.desc("n"), "name").limit(most)
        counts = counts.select(F.lit(part).alias("part"), "name", "n")
        out = counts if out is None else out.unionByName(counts)
    return out


def weighted_mean(df: DataFrame, key: str, value: str, weight: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.round(F.sum(F.col(value) * weight) / F.sum(weight), 6).alias(name))


def source_reputation(df: DataFrame, least: int = 3) -> DataFrame:
    """A source's reliability, adjusted from ten signals on: disputes and a lack of corroboration cost, corroboration pays a little."""
    b = df.groupBy("source_id").agg(
        F.count("*").alias("n"), F.avg("reliability").alias("rel"), F.avg((F.col("status") == "disputed").cast("int")).alias("d"), F.avg((F.col("source_count") >= 2).cast("int")).alias("c")
    ).filter(F.col("n") >= least)
    d, c = F.col("d"), F.col("c")
    disputes = F.when(d > 0.15, F.greatest(F.lit(-0.15), -(d - 0.15) * 0.5)).otherwise(0.0)
    alone = F.when((c < 0.05) & (F.col("n") >= 20), F.greatest(F.lit(-0.15), disputes - 0.03)).otherwise(disputes)
    total = F.when(c > 0.30, F.least(F.lit(0.05), alone + F.least(F.lit(0.05), (c - 0.30) * 0.1))).otherwise(alone)
    score = F.col("rel") + F.when(F.col("n") >= 10, total).otherwise(0.0)
    return b.select("source_id", "n", F.round(R.clamp(score, 0.05, 0.99), 4).alias("reputation"))


def quality_composite(df: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1).otherwise(0))
    distinct = lambda c, most: F.least(F.countDistinct(c) / most, F.lit(1.0))
    total = (
        20 * F.least(F.count("*") / 1000, F.lit(1.0)) + 15 * F.avg("reliability") + 15 * share(F.col("source_count") >= 2) + 15 * share(F.col("status") == "verified")
        + 15 * distinct("country_code", 25) + 10 * distinct("category", 5) + 10 * distinct("source_id", 20)
    )
    return df.agg(R.js_round(F.least(F.lit(100.0), total)).alias("quality"))


def implicit_interests(df: DataFrame, as_of: Column, active: int) -> DataFrame:
    c = df.groupBy("user_id", "category").agg(F.count("*").alias("n"), _recent(as_of, 168).alias("recent"))
    own = Window.partitionBy("user_id")
    w = c.withColumn("total", F.sum("n").over(own)).withColumn("w", F.col("n") + F.col("recent"))  # recent ones count twice
    return w.withColumn("weight", F.round(F.col("w") / F.max("w").over(own), 3)).filter(F.col("total") >= active).select("user_id", "category", "weight")


def latency_percentiles(df: DataFrame, last: int) -> DataFrame:
    """Nearest-rank percentiles of each source's last values."""
    rows = top_n(df, ["source_id"], [F.desc("created_at"), F.desc("id")], last)
    ordered = rows.groupBy("source_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    rank = lambda p: F.element_at("v", F.greatest(F.lit(1), F.ceil(F.size("v") * F.lit(p))).cast("int"))
    return ordered.select("source_id", rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"))


def ema(df: DataFrame, key: str, row: Column, alpha: float) -> DataFrame:
    """The exponential moving average of ``value`` in the order of the struct, by key."""
    values = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["value"])
    folded = F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(1))), F.element_at("v", 1), lambda a, x: alpha * x + (1 - alpha) * a)
    lists = df.groupBy(key).agg(values.alias("v"))
    return lists.select(key, F.round(F.when(F.size("v") > 1, folded).otherwise(F.element_at("v", 1)), 6).alias("ema"))


def consumer_lag(df: DataFrame, end: Column, committed: Column) -> DataFrame:
    lag = df.groupBy("partition").agg(F.greatest(F.lit(0), F.max(end) - F.max(committed)).alias("lag"))
    return lag.withColumn("status", R.ladder(F.col("lag"), [(2000, "critical"), (500, "warn")], "ok"))


def source_health(df: DataFrame, as_of: Column) -> DataFrame:
    g = df.groupBy("source_id").agg(F.count("*").alias("n"), (F.count_if(F.col("status") != "disputed") / F.count("*")).alias("rate"), F.max("created_at").alias("last_at"))
    health = F.when((F.col("n") >= 5) & (F.col("rate") < 0.5), "failed").when(F.col("last_at") < R.hours_before(as_of, 0.5), "stale").otherwise("healthy")
    return g.select("source_id", "n", F.round("rate", 6).alias("success"), health.alias("health"))


def baselines(df: DataFrame) -> DataFrame:
    """Daily counts by category, region and severity, with their roll-ups, in one pass."""
    sets = df.select(F.to_date("created_at").alias("date"), "category", F.coalesce("region", F.lit("global")).alias("region"), "severity", "reliability", "source_count")
    keys = ["date", "category", "region", "severity"]
    g = sets.groupingSets([keys, keys[:3], keys[:2]], *keys).agg(
        F.count("*").alias("n"), F.round(F.avg("reliability"), 6).alias("reliability"), F.count_if(F.col("source_count") >= 2).alias("corroborated"),
        F.grouping("region").alias("gr"), F.grouping("severity").alias("gs"),
    )
    return g.select(
        "date", "category", F.when(F.col("gr") == 1, "global").otherwise(F.col("region")).alias("region"), F.when(F.col("gs") == 1, "all").otherwise(F.col("severity")).alias("severity"),
        "n", "reliability", "corroborated",
    )


def daily(df: DataFrame) -> DataFrame:
    return df.groupBy("category", "region", F.to_date("created_at").alias("date")).agg(F.count("*").alias("n"))


def rolling_baselines(days: DataFrame) -> DataFrame:
    own = Window.partitionBy("category", "region").orderBy("date")
    last = lambda k: own.rowsBetween(1 - k, 0)
    w = days.select(
        "*", F.avg("n").over(last(7)).alias("avg7"), F.stddev_samp("n").over(last(7)).alias("std7"), F.avg("n").over(last(30)).alias("avg30"), F.stddev_samp("n").over(last(30)).alias("std30"),
        F.avg("n").over(last(3)).alias("last3"), F.avg("n").over(own.rowsBetween(-5, -3)).alias("prev3"),
    )
    z = F.when(F.col("std30") > 0, F.round((F.col("n") - F.col("avg30")) / F.nullif("std30", F.lit(0.0)), 4)).otherwise(0.0)
    trend = F.when(F.col("last3") > F.col("prev3") * 1.15, "rising").when(F.col("last3") < F.col("prev3") * 0.85, "falling").otherwise("stable")
    return w.select("category", "region", "date", "n", *[F.round(c, 4).alias(c) for c in ("avg7", "std7", "avg30", "std30")], z.alias("z30"), trend.alias("trend"))


def anomalies(daily_counts: DataFrame, days: int, least: int, z: float) -> DataFrame:
    """Days whose count is far from that of the days before, by category and region; one window, no query a row."""
    number = F.datediff("date", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("category", "region").orderBy("day").rangeBetween(-days, -1)
    w = daily_counts.withColumn("day", number).select(
        "category", "region", "date", "n", F.count("*").over(before).alias("rows"), F.avg("n").over(before).alias("mean"), F.stddev_samp("n").over(before).alias("std")
    )
    scored = w.filter((F.col("rows") >= least) & (F.col("std") > 1e-9)).withColumn("z", (F.col("n") - F.col("mean")) / F.col("std"))
    return scored.filter(F.abs("z") >= z).select("category", "region", "date", "n", F.round("z", 4).alias("z"), F.when(F.col("z") > 0, "above").otherwise("below").alias("direction"))


def region_hotspots(df: DataFrame, z: float, limit: int, least: int = 5, regions: int = 3, samples: int = 5) -> DataFrame:
    """Regions with far more reports than the others, with their main category and worst reports; none if there are too few regions to tell."""
    df = df.filter(F.col("status").isin("verified", "pending") & F.col("country_code").isNotNull())
    counted = df.groupBy("country_code", "category").agg(F.count("*").alias("many"), F.sum(R.by_severity(R.RANK_5)).alias("ranks"))
    mode = F.max_by("category", F.struct(F.col("many"), -F.ascii("category")))
    c = counted.groupBy("country_code").agg(F.sum("many").alias("n"), (F.sum("ranks") / F.sum("many")).alias("severity"), mode.alias("category")).filter(F.col("n") >= least)
    score = (F.col("n") - F.avg("n").over(_all())) / F.coalesce(F.nullif(F.stddev_pop("n").over(_all()), F.lit(0.0)), F.lit(1.0))
    hot = c.withColumn("z", score).withColumn("regions", F.count("*").over(_all())).filter((F.col("z") >= z) & (F.col("regions") >= regions))
    hot = hot.orderBy(F.desc("z"), "country_code").limit(limit)
    worst = df.join(hot.select("country_code"), "country_code", "left_semi").select("country_code", "id", "created_at", R.by_severity(R.RANK_4).alias("rank"))
    worst = top_n(worst, ["country_code"], [F.desc("rank"), F.desc("created_at"), F.desc("id")], samples, "i").groupBy("country_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("signals"))
    two = lambda x: F.floor(x * 100 + 0.5) / 100
    return hot.join(worst, "country_code").select("country_code", "n", two(F.col("severity")).alias("severity"), "category", two(F.col("z")).alias("z"), "signals")


def escalation_acceleration(df: DataFrame, last: int) -> DataFrame:
    """Whether the later half of a group's newest rows is more severe, or came faster, than the earlier half."""
    keys = ["category", "country_code"]
    rows = top_n(df.withColumn("rank", R.by_severity(R.RANK_4)), keys, [F.desc("created_at"), F.desc("id")], last, "d")
    own = Window.partitionBy(*keys)
    rows = rows.withColumn("n", F.count("*").over(own)).withColumn("late", F.col("d") <= F.col("n") - F.floor(F.col("n") / 2))
    part = lambda late: F.timestamp_diff("SECOND", F.min(F.when(late, F.col("created_at"))), F.max(F.when(late, F.col("created_at"))))
    early, late = ~F.col("late"), F.col("late")
    g = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.avg(F.when(early, F.col("rank"))).alias("a"), F.avg(F.when(late, F.col("rank"))).alias("b"), part(early).alias("g1"), part(late).alias("g2"))
    return g.filter("n >= 3").select(*keys, "n", (F.col("b") > F.col("a") + 0.5).alias("escalating"), ((F.col("n") >= 4) & (F.col("g2") < F.col("g1") * 0.6)).alias("accelerating"))


def entity_trend(df: DataFrame, as_of: Column, key: str, hours: int) -> DataFrame:
    now = F.col("created_at") > R.hours_before(as_of, hours)
    g = df.groupBy(F.col(key).alias("entity")).agg(F.count_if(now).alias("now_n"), F.count_if(~now).alias("before_n"))
    return g.withColumn("trend", F.when(F.col("now_n") > 1.3 * F.col("before_n"), "rising").when(F.col("now_n") < 0.7 * F.col("before_n"), "declining").otherwise("stable"))


def clean_streaks(df: DataFrame, gate: int) -> DataFrame:
    """The longest run of hours without a failure, by source; a failure begins a new run."""
    hours = df.groupBy("source_id", F.date_trunc("hour", "created_at").alias("hour")).agg(F.count_if(F.col("status") == "disputed").alias("bad"))
    own = Window.partitionBy("source_id").orderBy("hour")
    runs = hours.withColumn("island", F.sum(F.when(F.col("bad") > 0, 1).otherwise(0)).over(own)).groupBy("source_id", "island").agg(F.count_if(F.col("bad") == 0).alias("streak"))
    return runs.groupBy("source_id").agg(F.max("streak").alias("longest")).withColumn("gate", F.col("longest") >= gate)


def pulse_trends(df: DataFrame, as_of: Column, hours: int, limit: int) -> DataFrame:
    newest = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id")))), 1, 5), lambda x: x["id"])
    c = df.filter(F.col("status").isin("verified", "pending")).groupBy("category", "country_code").agg(
        F.count("*").alias("n"), F.max(R.by_severity(R.RANK_4)).alias("peak"), F.max("created_at").alias("last_at"), newest.alias("ids")
    ).filter("n >= 3")
    recency = F.greatest(F.lit(0.0), 1 - F.timestamp_diff("SECOND", F.col("last_at"), as_of) / F.lit(3600.0) / hours)
    score = R.js_round((F.col("peak") / 4 * 0.4 + F.least(F.col("n") / 10, F.lit(1.0)) * 0.4 + recency * 0.2) * 100)
    return c.select("category", "country_code", "n", score.alias("score"), "ids").orderBy(F.desc("score"), "category", "country_code").limit(limit)


def cross_beat(df: DataFrame, least: int, beats: int) -> DataFrame:
    hot = df.filter(F.col("severity").isin("critical", "high")).groupBy("region", "category").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return hot.groupBy("region").agg(F.count("*").alias("beats"), F.array_sort(F.collect_list("category")).alias("categories")).filter(F.col("beats") >= beats)


def trending_tags(df: DataFrame, as_of: Column, hours: int, limit: int) -> DataFrame:
    """Tags of the last window against the one before; a row on the boundary counts for the earlier one."""
    edge, start = R.hours_before(as_of, hours), R.hours_before(as_of, 2 * hours)
    t = df.filter(F.col("created_at") >= start).select(F.explode("tags").alias("tag"), (F.col("created_at") > edge).alias("now"), "k")
    g = t.groupBy("tag").agg(F.count_if("now").alias("n"), F.count_if(~F.col("now")).alias("prev"), F.sum(F.when(F.col("now"), F.col("k"))).alias("eng")).filter("n >= 2")
    delta = F.when(F.col("prev") == 0, 100.0).otherwise((F.col("n") - F.col("prev")) / F.nullif("prev", F.lit(0)) * 100)
    tenth = lambda x: F.round(F.floor(x * 10 + 0.5) / 10, 1)
    scored = g.withColumn("d", delta).select("tag", "n", tenth(F.col("n") * 10 + F.log1p("eng") * 5).alias("score"), tenth(F.col("d")).alias("delta"), C.momentum(F.col("d")).alias("momentum"))
    return scored.orderBy(F.desc("score"), "tag").limit(limit)
