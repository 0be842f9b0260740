"""Satellite feeds as one job: read rows, rate their measure, leave out repeats and what is known, append the rest.

A feed is a rule: its category, the measure from which it is reported, the ladder of
severities, the cell and the time by which repeats are told, and how many of the strongest
cells a run reports.  Rules are data, so that a further feed is a further row.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks as R


@dataclass(frozen=True)
class Feed:
    category: str
    least: float
    ladder: tuple[tuple[float, str], ...]
    degrees: float = 1.0
    hours: int = 24
    most: int = 100


def _by_feed(feeds: Mapping[str, Feed], value) -> Column:
    out = None
    for name, feed in feeds.items():
        hit = F.col("feed") == name
        out = F.when(hit, value(feed)) if out is None else out.when(hit, value(feed))
    return out


def reports(rows: DataFrame, feeds: Mapping[str, Feed]) -> DataFrame:
    """(feed, id, ts, lat, lng, measure) -> a report a feed, cell and span of time: its strongest row, how many there are, and its severity.

    Rows of unknown feeds, or below their feed's least measure, go; of each feed and span the strongest cells stay.
    """
    known = rows.filter(F.col("feed").isin(*feeds) & (F.col("measure") >= _by_feed(feeds, lambda f: F.lit(float(f.least)))))
    step, span = _by_feed(feeds, lambda f: F.lit(float(f.degrees))), _by_feed(feeds, lambda f: F.lit(f.hours * 3600))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    cells = known.select(
        "feed", "id", "measure", F.floor(F.col("lat") / step).alias("cell_lat"), F.floor(F.col("lng") / step).alias("cell_lng"), F.floor(seconds / span).alias("span")
    )
    top = F.struct(F.col("measure"), -F.col("id"))
    found = cells.groupBy("feed", "cell_lat", "cell_lng", "span").agg(F.count("*").alias("n"), F.max("measure").alias("measure"), F.max_by("id", top).alias("id"))
    order = Window.partitionBy("feed", "span").orderBy(F.desc("measure"), "id")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= _by_feed(feeds, lambda f: F.lit(f.most))).drop("r")
    severity = _by_feed(feeds, lambda f: R.ladder(F.col("measure"), list(f.ladder), "low"))
    return best.withColumn("severity", severity).withColumn("category", _by_feed(feeds, lambda f: F.lit(f.category)))


def fresh(found: DataFrame, known: DataFrame) -> DataFrame:
    """Reports whose feed, cell and span are not known yet."""
    keys = ["feed", "cell_lat", "cell_lng", "span"]
    return found.join(known.select(*keys).distinct(), keys, "left_anti")
