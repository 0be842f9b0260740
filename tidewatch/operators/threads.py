"""Narrative threads: each report joins the best of the threads that are active when it comes, or begins one.

A report is scored against a thread by shared tags, category, country, region and the likeness of
titles.  What a report does hangs on all that came before, so reports of a scope (by default a
country) are walked in the order of their times; a report meets the threads of its own scope only.
With an empty scope it meets all of them, in a single task.  A walk keeps no more than the threads that are
active, whatever the length of the stream.  ``streaming.streams.threads_of`` is the same walk with keyed state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks as R

#: Tags that must be shared, worth of one and of all, of category, country, region and likeness of titles,
#: least likeness and least score, characters of a title, hours of quiet after which a thread is stable, hours after which
#: a stable one is resolved, reports from which a thread escalates, minutes of a cycle.
TAGS_LEAST, TAG, TAGS_MOST = 2, 0.1, 0.4
CATEGORY, COUNTRY, REGION, TITLE = 0.2, 0.15, 0.1, 0.3
LIKENESS_FROM, ALIKE, JOINS = 0.1, 0.35, 0.3
TITLE_CHARS, QUIET_HOURS, RESOLVED_HOURS, ESCALATES, CYCLE_MINUTES = 200, 12, 168, 5, 5

HOUR, CYCLE = 3_600_000_000, CYCLE_MINUTES * 60_000_000
FACTS = ["at", "id", "title", "category", "country_code", "region", "tags"]


def trigrams(title: str) -> frozenset[str]:
    """Trigrams of the runs of ASCII letters and digits of a title, padded with two blanks before and one after."""
    runs = "".join(c if c.isascii() and c.isalnum() else " " for c in title.lower()).split()
    return frozenset(w[i : i + 3] for w in (f"  {r} " for r in runs) for i in range(len(w) - 2))


class Walk:
    """The active threads of a scope, oldest first.

    A thread's tags are its first report's and, from the cycle after theirs on, those of the reports that joined it.
    """

    def __init__(self, state: str | None = None):
        self.threads = json.loads(state) if state else []
        for t in self.threads:
            t["grams"] = trigrams(t["title"])

    def state(self) -> str:
        return json.dumps([{k: v for k, v in t.items() if k != "grams"} for t in self.threads])

    def last(self) -> int:
        return max(t["last"] for t in self.threads)

    def place(self, at: int, name, title, category, country, region, tags) -> tuple:
        """Puts a report into a thread: (thread, relevance), where a report's own name stands for a new thread."""
        title, tags, cycle = (title or "")[:TITLE_CHARS], {t for t in tags if t is not None} if tags is not None else set(), at // CYCLE
        grams, best, most = trigrams(title), None, 0.0
        self.threads = [t for t in self.threads if t["last"] >= at - QUIET_HOURS * HOUR]
        for t in self.threads:
            if t["waits"] and t["cycle"] < cycle:
                t["tags"], t["waits"] = sorted({*t["tags"], *t["waits"]}), []
            shared, score = len(tags.intersection(t["tags"])), 0.0
            if shared >= TAGS_LEAST:
                score += min(TAGS_MOST, shared * TAG)
            score += CATEGORY if category and category == t["category"] else 0.0
            score += COUNTRY if country and country == t["country"] else 0.0
            score += REGION if region and region == t["region"] else 0.0
            if score > LIKENESS_FROM and score + TITLE > most:
                union = len(grams | t["grams"])
                alike = len(grams & t["grams"]) / union if union else 0.0
                score += alike * TITLE if alike >= ALIKE else 0.0
            if score >= JOINS and score > most:
                best, most = t, score
        if best is None:
            self.threads.append({"thread": name, "title": title, "grams": grams, "category": category, "country": country, "region": region, "tags": sorted(tags), "waits": [], "cycle": cycle, "last": at})
            return name, 1.0
        best["waits"], best["cycle"], best["last"] = sorted(tags.union(best["waits"])), cycle, max(best["last"], at)
        return best["thread"], float(int(most * 1000 + 0.5)) / 1000


def reports(signals: DataFrame, scope: list[str], *carried: str) -> DataFrame:
    """What a walk reads of each report that has a time: its scope's keys under names of their own, and its facts."""
    keys = [F.col(c).alias(f"scope_{c}") for c in scope]
    return signals.filter(F.col("created_at").isNotNull()).select(*keys, F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), *FACTS[1:], *carried)


def _walked(keys: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, walk = None, Walk()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row[:keys] != now:
                    now, walk = row[:keys], Walk()
                out.append((row[keys + 1], *walk.place(*row[keys:])))
            yield pd.DataFrame(out, columns=["id", "thread", "relevance"])

    return run


def assigned(signals: DataFrame, scope: tuple[str, ...] = ("country_code",)) -> DataFrame:
    """(id, thread, relevance) of every report with a time; a thread is named by the report that began it, whose relevance is 1.

    Null tags are none, a null title is empty, and a null category, country or region is like no other; the null scope is a scope.
    Reports of equal times come by id; ties of threads go to the older one.
    """
    keys = [f"scope_{c}" for c in scope]
    rows = reports(signals, list(scope))
    rows = (rows.repartition(*keys) if keys else rows.coalesce(1)).sortWithinPartitions(*keys, "at", "id")
    kind = signals.schema["id"].dataType.simpleString()
    return rows.mapInPandas(_walked(len(keys)), f"id {kind}, thread {kind}, relevance double")


def summed(placed: DataFrame, signals: DataFrame, as_of) -> DataFrame:
    """A row a thread: its first report's title and place, the worst severity, and where it stands at a moment.

    Five reports make a thread escalate; twelve hours of quiet make it stable, and 168 more resolve it.
    """
    rank, order = R.by_severity(R.RANK_5), F.struct("created_at", "id")
    rows = placed.join(signals, "id")
    found = rows.groupBy("thread").agg(
        *[F.min_by(c, order).alias(c) for c in ("title", "category", "region", "country_code")], F.max_by("severity", rank).alias("peak"),
        F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
    )
    quiet = F.timestamp_diff("SECOND", F.col("last_seen"), as_of)
    status = F.when(quiet > (QUIET_HOURS + RESOLVED_HOURS) * 3600, "resolved").when(quiet > QUIET_HOURS * 3600, "stable").when(F.col("n") >= ESCALATES, "escalating").otherwise("developing")
    return found.withColumn("status", status)


def timeline(placed: DataFrame, signals: DataFrame, most: int = 50) -> DataFrame:
    """The newest reports of each thread, in order, with the place of each and the time since the one before."""
    newest = Window.partitionBy("thread").orderBy(F.desc("created_at"), F.desc("id"))
    before = F.lead("created_at").over(newest)
    rows = placed.join(signals.select("id", "created_at", "severity", "title"), "id")
    return rows.select("thread", "id", "relevance", "severity", F.row_number().over(newest).alias("nth"), F.timestamp_diff("SECOND", before, F.col("created_at")).cast("double").alias("since_s")).filter(F.col("nth") <= most)
