"""The correlation engine: clusters of reports from scored pairs, what they raise, and threads of them.

Clusters are pure functions of the pairs and the reports, in batch: a star cluster is what one
report finds when it comes in; extended clusters grow as reports come in, up to a number of members:
a report joins the cluster of what it finds, or begins one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions import scores as C
from ..functions.tables import STRATEGIC
from .components import components

#: Members of a cluster at most; reliability from which a corroborated pending report is verified.
MOST, VERIFIED_FROM = 12, 0.65


def ends(pairs: DataFrame) -> DataFrame:
    """(a, b, score, kind) -> id, other, score, kind: each pair from both of its ends."""
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score", "kind").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "score", "kind"))


def _dominant(rows: DataFrame, key: str, *then) -> DataFrame:
    """The most frequent kind of each key; ties go by ``then``, an order of (key, kind) groups."""
    counted = rows.groupBy(key, "kind").agg(F.count("*").alias("many"), F.min("nth").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("many"), *then)
    return counted.withColumn("r", F.row_number().over(order)).filter("r = 1").select(key, "kind")


def stars(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """Of every report with correlated ones: itself and the best of these, summed up."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    found = ends(pairs).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") < MOST)
    facts = signals.select(F.col("id").alias("member"), "category", "source_id", "severity", "reliability", R.by_severity(R.RANK_4).alias("rank"))
    own = found.select("id").distinct().select("id", F.col("id").alias("member"), F.lit(0).alias("nth"))
    members = own.unionByName(found.select("id", F.col("other").alias("member"), "nth")).join(facts, "member")
    top = F.struct("rank", "reliability", -F.col("nth"))
    summed = members.groupBy("id").agg(
        F.count("*").alias("n"), F.max_by("member", top).alias("primary_id"), F.max_by("severity", top).alias("severity"),
        F.countDistinct("category").alias("categories"), F.countDistinct("source_id").alias("sources"),
    )
    score = found.groupBy("id").agg(F.round(F.avg("score"), 6).alias("score"))
    return summed.join(score, "id").join(_dominant(found, "id", F.asc("first")), "id")


def arrivals(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """Of every report that correlates with earlier ones: the best of these (others, scores and kinds, best first), and the component whose reports it can meet."""
    at = signals.select("id", "created_at")
    earlier = F.struct("before", "other") < F.struct("created_at", "id")
    met = ends(pairs).join(at, "id").join(at.select(F.col("id").alias("other"), F.col("created_at").alias("before")), "other").filter(earlier)
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).filter(F.col("nth") < MOST)
    rows = best.groupBy("id").agg(F.min("created_at").alias("created_at"), F.array_sort(F.collect_list(F.struct("nth", "other", "score", "kind"))).alias("met"))
    label = components(pairs.select("a", "b")).select(F.col("node").alias("id"), F.col("label").alias("component"))
    return rows.join(label, "id").select("component", "created_at", "id", *[F.col("met")[c].alias(f"{c}s") for c in ("other", "score", "kind")])


def _assign(most: int):
    """Walks a component's reports as they came: each joins the cluster of the best earlier report that is in one, unless that is full, or begins one with all it met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, owner, size = None, {}, {}
        for batch in batches:
            out = []
            for component, own, others, scores, kinds in batch.itertuples(index=False):
                if component != now:
                    now, owner, size = component, {}, {}
                home = next((owner[x] for x in others if x in owner), None)
                mean = float(sum(scores) / len(scores))
                if home is None:
                    size[own] = 1 + len(others)
                    counted = Counter(kinds)
                    kind = max(counted, key=counted.get)  # ties go to the kind that was met first
                    for nth, member in enumerate([own, *others], 1):
                        owner[member] = own
                        out.append((own, member, nth, 0, mean if nth == 1 else None, kind if nth == 1 else None))
                elif size[home] < most:
                    size[home] += 1
                    owner[own] = home
                    out.append((home, own, size[home], 1, mean, None))
            yield pd.DataFrame(out, columns=["cluster", "id", "nth", "step", "met", "first_kind"]).astype({"met": "float64"})

    return run


def members(pairs: DataFrame, signals: DataFrame, most: int = MOST) -> DataFrame:
    """The reports of every extended cluster, named by the report that began it, in the order in which they joined.

    A component's reports are one sorted pass of a task, which keeps a number a report: what a report does
    hangs on all that came before.  Reports that met only full clusters are in none.
    """
    rows = arrivals(pairs, signals).repartition("component").sortWithinPartitions("component", "created_at", "id").drop("created_at")
    kind = signals.schema["id"].dataType.simpleString()
    joined = rows.mapInPandas(_assign(most), f"cluster {kind}, id {kind}, nth int, step int, met double, first_kind string")
    return signals.join(joined, "id").withColumn("rank", R.by_severity(R.RANK_4))


def clusters(rows: DataFrame) -> DataFrame:
    """Members summed up: the severity rises with each more severe one, the score is a rolling mean of what each arrival met, and three categories make an extended cluster multi-factor."""
    fold = lambda a, x: F.when(a.isNull(), x["met"]).otherwise((a + x["met"]) / 2)
    means = F.collect_list(F.when(F.col("met").isNotNull(), F.struct("nth", "met")))
    founder = F.col("step") == 0
    top = F.struct("rank", founder, F.when(founder, F.col("reliability")).otherwise(0.0), -F.col("nth"))
    summed = rows.groupBy("cluster").agg(
        F.count("*").alias("n"), F.max_by("id", top).alias("primary_id"), F.max_by("severity", top).alias("severity"), F.countDistinct("category").alias("categories"), F.countDistinct("source_id").alias("sources"),
        F.round(F.aggregate(F.array_sort(means), F.lit(None).cast("double"), fold), 6).alias("score"), F.max("step").alias("grown"), F.max("first_kind").alias("first_kind"),
    )
    return summed.withColumn("kind", F.when((F.col("categories") >= 3) & (F.col("grown") > 0), "multi_factor").otherwise(F.col("first_kind"))).drop("grown", "first_kind")


def corroborated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The members of clusters with two sources and more: their reliability is raised, and pending ones may be verified by that."""
    boosted = found.filter("sources >= 2").select("cluster", C.corroboration_boost(F.col("sources"), F.col("categories"), F.col("severity")).alias("boost"))
    raised = F.least(F.col("reliability") + F.col("boost"), F.lit(1.0))
    met = rows.join(boosted, "cluster").withColumn("raised", F.round(raised, 6))
    return met.select("id", "cluster", F.round("boost", 6).alias("boost"), F.col("raised").alias("reliability"), F.when((F.col("status") == "pending") & (F.col("raised") >= VERIFIED_FROM), "verified").otherwise(F.col("status")).alias("status"))


def rescored(waiting: DataFrame, pairs: DataFrame, signals: DataFrame, most: int = 50) -> DataFrame:
    """Reports of one source that waited a while, scored again: the newest ones, their new number of sources and severity."""
    batch = waiting.filter(F.coalesce(F.col("source_count") <= 1, F.lit(True))).orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    met = batch.select("id", "category", F.col("severity").alias("before")).join(stars(pairs, signals).select("id", "n", "sources"), "id", "left")
    cap = R.by_severity(R.RANK_4, C.severity_cap(F.col("sources"), F.col("category")))
    rises = (F.col("sources") >= 2) & (F.col("before") == "medium") & F.col("category").isin(STRATEGIC) & (cap > 2)
    return met.select("id", F.col("n").isNotNull().alias("corroborated"), F.coalesce("sources", F.lit(1)).alias("sources"), F.when(rises, "high").otherwise(F.col("before")).alias("severity"))


def threads(rows: DataFrame) -> DataFrame:
    """A thread of each cluster: its main title, first category and region, and how its mean severity went as reports came."""
    rank = R.by_severity(R.RANK_5)
    running = F.floor(F.avg(rank).over(Window.partitionBy("cluster").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)) * 100 + 0.5) / 100
    rows = rows.withColumn("mean", running)
    top, first = F.struct(rank, -F.col("nth")), F.col("nth")
    return rows.groupBy("cluster").agg(
        F.max_by("title", top).alias("title"), F.max_by("severity", top).alias("peak"), F.min_by("category", first).alias("category"), F.min_by("region", first).alias("region"),
        F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.round(F.avg("reliability"), 6).alias("reliability"),
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "mean"))), lambda x: x["mean"]).alias("trajectory"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
    )
