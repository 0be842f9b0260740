"""Entity graph: nodes, co-occurrence edges, degrees, neighbourhoods, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tables import HONORIFIC, MERGE_FROM, MERGE_SIMILARITY, TITLES
from .joins import both_ways, set_similarity_join, suffixed


def node_upsert(mentions: DataFrame, most_signals: int, tasks: int | None = None) -> DataFrame:
    """One node an entity: first and last sight, mentions, and its latest signals, which are cut before they are collected.

    They are cut in 64 parts of an entity first, so that no task gets all signals of a hot one; the number of tasks follows the mentions.
    """
    keys = ["entity_id", "type"]
    tasks = tasks or tasks_for(mentions.count(), mentions.sparkSession)
    newest = lambda rows, *by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("signal_id")))).filter(F.col("r") <= most_signals).drop("r")
    dealt = mentions.select(*keys, "signal_id", F.pmod(F.xxhash64("signal_id"), F.lit(64)).alias("part")).repartition(tasks, *keys, "part")
    cut = newest(dealt.groupBy(*keys, "part", "signal_id").agg(F.lit(1)), *keys, "part").select(*keys, "signal_id")
    signals = newest(cut.repartition(tasks, *keys), *keys).groupBy(*keys).agg(F.array_sort(F.collect_list("signal_id")).alias("signals"))
    return mentions.groupBy(*keys).agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("mentions")).join(signals, keys)


def edge_upsert(edges: DataFrame, first: float, step: float) -> DataFrame:
    """Repeated edges become one whose weight rises with every repeat, up to 1."""
    return edges.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("weight", F.round(F.least(F.lit(1.0), first + step * (F.col("n") - 1)), 6))


#: Pairs and mentions that a task of co-occurrence gets, about: the number of tasks follows the input.
SHARE = 500_000


def tasks_for(rows: int, spark: SparkSession, share: int = SHARE) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // share))


def sized(mentions: DataFrame, part: int = 256) -> tuple[int, int]:
    """Tasks for the pairs of all signals, and how many signals have more mentions than a part."""
    known = mentions.filter("signal_id is not null and entity_id is not null").select("signal_id")
    n = known.repartition(tasks_for(known.count(), known.sparkSession, 4 * SHARE), "signal_id").groupBy("signal_id").agg(F.count("*").cast("double").alias("n"))
    pairs, hot = n.agg(F.sum(F.col("n") * (F.col("n") + 1) / 2), F.count_if(F.col("n") > part)).first()
    return tasks_for(int(pairs or 0), mentions.sparkSession), hot


def cooccurring(mentions: DataFrame, part: int = 256, size: tuple[int, int] | None = None) -> DataFrame:
    """(signal_id, cell, a, b) with a < b: every pair of entities of a signal, once.

    The entities of a signal with many of them are dealt out to parts of about that size, and each pair of parts
    is made in a row of its own: a task never gets a whole hot signal.  Null signals and entities pair with nothing.
    All rows of a ``cell`` are in one task.
    """
    tasks, hot = size or sized(mentions, part)
    d = mentions.select("signal_id", "entity_id").dropna()
    whole = ["signal_id"]
    if hot:
        parts = d.select("signal_id").repartition(tasks, "signal_id").groupBy("signal_id").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).filter("parts > 1")
        d = d.join(F.broadcast(parts) if hot <= 100_000 else parts, "signal_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("nth", F.pmod(F.xxhash64("entity_id"), F.col("parts")).cast("int"))
        # a part alone, and with each other part as the first or the second one
        at = lambda j: F.struct(F.least("nth", j).alias("i"), F.greatest("nth", j).alias("j"), F.when(j == F.col("nth"), 0).when(j > F.col("nth"), 1).otherwise(2).alias("side"))
        place = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), at)
        d = d.select("signal_id", "entity_id", F.explode(place).alias("p")).select("signal_id", "p.i", "p.j", "p.side", "entity_id")
        whole = ["signal_id", "i", "j"]
    cell = F.pmod(F.xxhash64(*whole), F.lit(64 * tasks)).cast("int")
    held = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("entity_id")) if hot else F.col("entity_id")))
    own, *sides = [held(side).alias(name) for side, name in enumerate(("own", "x", "y") if hot else ("own",))]
    lists = d.withColumn("cell", cell).repartition(tasks, "cell").groupBy("cell", *whole).agg(own, *sides)
    pair = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    pairs = F.transform("own", lambda p, n: F.transform(F.slice("own", n + 2, F.size("own")), lambda q: pair(p, q)))
    if hot:
        pairs = F.concat(pairs, F.transform("x", lambda p: F.transform("y", lambda q: pair(p, q))))
    return lists.select("signal_id", "cell", F.explode(F.flatten(pairs)).alias("p")).select("signal_id", "cell", "p.a", "p.b")


def cooccurrence(mentions: DataFrame, least: int, weight: Column, part: int = 256, size: tuple[int, int] | None = None) -> DataFrame:
    """Pairs of entities that share signals; ``weight`` is an expression of ``n``, the signals shared.

    Pairs are counted in their cells first, then in as many tasks as the pairs ask for.
    """
    size = size or sized(mentions, part)
    near = cooccurring(mentions, part, size).groupBy("cell", "a", "b").agg(F.count("*").alias("n"))
    counted = near.repartition(size[0], "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least).withColumn("weight", F.round(weight, 6))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted"))


def importance(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Weighted degree and a tenth of the mentions, as a share of the greatest."""
    scored = degrees(edges).join(nodes.select(F.col("entity_id").alias("node"), "mentions"), "node").withColumn("raw", F.col("weighted") + 0.1 * F.col("mentions"))
    top = F.broadcast(scored.agg(F.max(F.struct("raw", "degree")).alias("top")))  # one row; with the degree, the degrees are counted once for both
    return scored.crossJoin(top).select("node", "degree", F.round(F.col("raw") / F.col("top.raw"), 6).alias("importance")).orderBy(F.desc("importance"), "node").limit(limit)


def spikes(mentions: DataFrame, as_of: Column, days: int, baseline_days: int) -> DataFrame:
    """Mentions of the last days against the daily average of the time before."""
    age = F.timestamp_diff("DAY", F.col("seen_at"), as_of)
    g = mentions.groupBy("entity_id").agg(F.count_if((age >= 0) & (age < days)).alias("recent"), F.count_if((age >= days) & (age < days + baseline_days)).alias("before"))
    usual = F.col("before") / baseline_days * days
    return g.filter("recent > 0").withColumn("spike", F.round(F.col("recent") / F.greatest(usual, F.lit(1.0)), 6))


def redirect(edges: DataFrame, merges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges after merges (node -> kept): ends are renamed, loops go, and doubles keep their greatest weight."""
    m = merges.select(F.col("node"), F.col("kept"))
    e = edges.join(m.withColumnsRenamed({"node": "a", "kept": "ka"}), "a", "left").join(m.withColumnsRenamed({"node": "b", "kept": "kb"}), "b", "left")
    e = e.select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"), "weight").filter("x <> y")
    e = e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")
    return (e.repartition(tasks, "a", "b") if tasks else e).groupBy("a", "b").agg(F.max("weight").alias("weight"))


def connected_signals(mentions: DataFrame, signal_id: int) -> DataFrame:
    """Signals that share entities with one, by the number shared."""
    own = mentions.filter(F.col("signal_id") == signal_id).select("entity_id").distinct()
    met = mentions.filter(F.col("signal_id") != signal_id).join(own, "entity_id")
    return met.groupBy("signal_id").agg(F.countDistinct("entity_id").alias("shared"), F.array_sort(F.collect_set("entity_id")).alias("entities"))


def _longest_first(words: Sequence[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


#: Up to two titles before a name, the longest first.
TITLED = rf"^(?:{_longest_first(TITLES)})\s+"


def bare_name(name: Column) -> Column:
    """A name in lower case without up to two titles before it."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), TITLED, ""), TITLED, "")


def plain_name(name: Column) -> Column:
    """A name without a short title and up to two others before it, otherwise as it is written."""
    short = F.regexp_replace(F.trim(name), f"(?i){HONORIFIC}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(short, f"(?i){TITLED}", ""), f"(?i){TITLED}", ""))


def contained_names(names: DataFrame) -> DataFrame:
    """(id, type, name) -> a, b with a < b: names of one type of which one holds the other, or persons with one last name and unlike numbers of words.

    A name that holds another has the other's first four characters somewhere, by which they meet.
    """
    n = names.withColumn("n", F.when(F.col("type") == "person", bare_name(F.col("name"))).otherwise(F.lower("name"))).filter(F.length("n") >= 4).select("id", "type", "n")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("n") - 3), lambda i: F.substring("n", i, F.lit(4))))
    holds = n.select(F.col("id").alias("big"), "type", F.col("n").alias("long"), F.explode(grams).alias("gram"))
    inner = n.select(F.col("id").alias("small"), "type", F.col("n").alias("short"), F.substring("n", 1, 4).alias("gram"))
    met = holds.join(inner, ["type", "gram"]).filter((F.length("long") > F.length("short") + 2) & F.contains("long", "short")).select(F.least("big", "small").alias("a"), F.greatest("big", "small").alias("b"))
    parts = F.split("n", r"\s+")
    last = n.filter("type = 'person'").select("id", F.element_at(parts, -1).alias("last"), F.size(parts).alias("words")).filter(F.length("last") >= 4)
    same = suffixed(last, "_a").join(suffixed(last, "_b"), (F.col("last_a") == F.col("last_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("words_a") != F.col("words_b")))
    return met.union(same.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).distinct()


def merge_candidates(entities: DataFrame, persons: int = 500, organisations: int = 300, most: int = 100) -> DataFrame:
    """(id, type, name, mentions) -> a, b, similarity, match and keep: pairs of entities that may be one, whether they are merged, and which one stays.

    Spelling by trigrams first, then persons alike but for titles, then names in names, the last two
    among the entities most spoken of; the best pairs of a run count, and those above their kind's threshold are merged.
    """
    grams = entities.filter(F.length("name") >= 3).select("id", "type", X.trigrams(F.col("name")).alias("grams"))
    named = entities.select("id", "name", "mentions")
    side = lambda s: named.withColumnsRenamed({"id": s, "name": f"name_{s}", "mentions": f"mentions_{s}"})
    spelt = set_similarity_join(grams, "id", "grams", 0.6, ["type"]).filter("similarity > 0.6").join(side("a"), "a").join(side("b"), "b").filter("name_a <> name_b")
    spelt = spelt.select("a", "b", F.round("similarity", 6).alias("similarity"), F.lit("trigram").alias("match")).orderBy(F.desc("similarity"), "a", "b").limit(most)
    top = lambda kind, n: entities.filter((F.col("type") == kind) & (F.col("mentions") >= 2)).orderBy(F.desc("mentions"), "id").limit(n)
    people, bodies = top("person", persons), top("organisation", organisations)
    bare = people.select("id", bare_name(F.col("name")).alias("bare")).filter(F.length("bare") >= 4)
    alike = suffixed(bare, "_a").join(suffixed(bare, "_b"), (F.col("bare_a") == F.col("bare_b")) & (F.col("id_a") < F.col("id_b")))
    alike = alike.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(MERGE_SIMILARITY["title_strip"]).alias("similarity"), F.lit("title_strip").alias("match"))
    inside = lambda rows, kind: contained_names(rows).select("a", "b", F.lit(MERGE_SIMILARITY[kind]).alias("similarity"), F.lit("containment").alias("match"))
    found = None
    for nth, part in enumerate((spelt, alike, inside(people, "person"), inside(bodies, "organisation"))):
        part = part.withColumn("nth", F.lit(nth))
        found = part if found is None else found.unionByName(part)
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("nth"))).filter("r = 1")
    best = first.orderBy(F.desc("similarity"), "a", "b").limit(most).join(side("a"), "a").join(side("b"), "b")
    longer = F.length("name_a") - F.length("name_b")
    spoken = F.when(F.col("mentions_a") >= F.col("mentions_b"), F.col("a")).otherwise(F.col("b"))
    whole = F.when((longer > 0) & (F.col("mentions_b") < F.col("mentions_a") * 5), F.col("a")).when((longer < 0) & (F.col("mentions_a") < F.col("mentions_b") * 5), F.col("b")).otherwise(spoken)
    enough = F.col("similarity") >= F.element_at(F.create_map(*[F.lit(x) for pair in MERGE_FROM.items() for x in pair]), F.col("match"))
    return best.select("a", "b", "similarity", "match", enough.alias("merged"), F.when(F.col("match") == "trigram", spoken).otherwise(whole).alias("keep"))
