"""Order-dependent operators: one key's rows in order, never all rows in one task."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A breaker at rest: state, failures in a row, times opened in a row, rest until.
BREAKER = ("closed", 0, 0, 0.0)


def breaker_step(now: tuple, at: float, bad: bool, failures: int = 5, rest: float = 600.0, most: float = 7200.0) -> tuple:
    """The breaker after one attempt: it opens on so many failures in a row, rests twice as long each time, and probes once."""
    state, count, opens, until = now
    if state == "open":
        if at < until:
            return now
        state = "half_open"
    if not bad:
        return BREAKER
    count += 1
    if state == "half_open" or count >= failures:
        return ("open", 0, opens + 1, at + min(rest * 2**opens, most))
    return ("closed", count, opens, 0.0)


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def breaker_changes(df: DataFrame, key: str, ts: str, failed: str, row: str, failures: int = 5) -> DataFrame:
    """Each key's changes of its breaker; rows of one moment go by ``row``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        now, out = BREAKER, []
        for name, at, bad in rows.sort_values(["at", "row"])[[key, "at", "bad"]].itertuples(index=False):
            after = breaker_step(now, at / 1e6, bad, failures)
            if after[0] != now[0]:
                out.append((name, at, after[0]))
            now = after
        return pd.DataFrame(out, columns=[key, "at", "state"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, _micros(ts).alias("at"), F.col(failed).alias("bad"), F.col(row).alias("row"))
    changes = rows.groupBy(key).applyInPandas(run, f"{key} {kind}, at long, state string")
    return changes.withColumn("at", F.timestamp_micros("at").cast("timestamp_ntz"))


def ttl_first(df: DataFrame, keys: list[str], ts: str, row: str, seconds: int | Column) -> DataFrame:
    """Rows that are the first of their key within a time to live (one for all, or that of the row let through) counted from the last row let through."""

    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = None, None
        for batch in batches:
            kept = []
            for i, (*key, at, ttl) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*range(n), n, n + 2)))):
                if key != last:
                    last, until = key, None
                if until is None or at is not None and at >= until:
                    kept.append(i)
                    until = math.inf if at is None or ttl is None else at + ttl * 1_000_000
            yield pa.RecordBatch.from_arrays([batch.column(n + 1).take(pa.array(kept, pa.int64()))], names=["row"])

    ttl = seconds if isinstance(seconds, Column) else F.lit(seconds)
    names = [f"k{i}" for i in range(n)]  # keys as strings, so that equal ones are equal in Python, too
    rows = df.select(*[F.col(k).cast("string").alias(c) for k, c in zip(keys, names)], _micros(ts).alias("at"), F.col(row).alias("row"), ttl.cast("long").alias("ttl"))
    # a task walks its keys one after the other in a stream of sorted rows, and holds one key's moment
    walked = rows.repartition(*names).sortWithinPartitions(*names, F.asc_nulls_last("at"), F.asc_nulls_last("row"))
    return walked.mapInArrow(run, f"row {df.schema[row].dataType.simpleString()}").withColumnRenamed("row", row)


def quiet_spells(df: DataFrame, key: str, ts: str, seconds: int, every: int, until_micros: int | None = None) -> DataFrame:
    """(key, at) of each regular check that first finds a key's last row so many seconds old, as far as checks are before ``until_micros``."""
    step = every * 1_000_000
    rows = df.select(key, _micros(ts).alias("now")).withColumn("next", F.lead("now").over(Window.partitionBy(key).orderBy("now")))
    at = F.ceil((F.col("now") + seconds * 1_000_000) / step) * step
    end = F.coalesce(F.col("next"), F.lit(until_micros).cast("long"))
    return rows.withColumn("at", at).filter(end.isNull() | (F.col("at") < end)).select(key, F.timestamp_micros("at").cast("timestamp_ntz").alias("at"))


def rate_limited(df: DataFrame, keys: list[str], ts: str, row: str, most: int, seconds: int) -> DataFrame:
    """Rows admitted while fewer than ``most`` were in the trailing window; only admitted rows count, so a key's rows are walked in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, admitted = [], deque()
        for at, name in rows.sort_values(["at", "row"])[["at", "row"]].itertuples(index=False):
            while admitted and admitted[0] <= at - seconds * 1_000_000:
                admitted.popleft()
            if len(admitted) < most:
                admitted.append(at)
                out.append(name)
        return pd.DataFrame({"row": out})

    kept = df.select(*keys, _micros(ts).alias("at"), F.col(row).alias("row")).groupBy(*keys).applyInPandas(run, f"row {df.schema[row].dataType.simpleString()}")
    return kept.withColumnRenamed("row", row)


def session_runs(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Bursts of a key's rows: gaps and islands."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts))
    marked = df.withColumn("new", F.when(gap < seconds, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("run")


def diverse(df: DataFrame, key: str, order: str, most: int, in_a_row: int, limit: int) -> DataFrame:
    """A ranked list without too many of a category, in all and in a row.

    ``df`` must be a page already (a bounded number of rows): its order decides, so one task walks it.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts: dict = {}
        out, last, streak = [], None, 0
        for name, kind in rows.sort_values(order)[["id", key]].itertuples(index=False):
            if counts.get(kind, 0) >= most or (kind == last and streak >= in_a_row):
                continue
            counts[kind] = counts.get(kind, 0) + 1
            streak = streak + 1 if kind == last else 1
            last = kind
            out.append((name, kind))
            if len(out) == limit:
                break
        return pd.DataFrame(out, columns=["id", key])

    return df.withColumn("page", F.lit(0)).groupBy("page").applyInPandas(run, f"id long, {key} string")


def greedy_clusters(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Within a key (and day), rows join the first cluster with which they share so many words, else begin one.

    Words name the clusters that hold them, so that a row meets only those.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        holders: dict[str, list[int]] = {}  # the clusters of a word, in their order
        names: list[int] = []
        out = []
        for name, words in rows.sort_values("id")[["id", "words"]].itertuples(index=False):
            own = set(words)
            shared = Counter(c for w in own for c in holders.get(w, ()))
            home = min((c for c, n in shared.items() if n >= least), default=None)
            if home is None:
                home = len(names)
                names.append(name)
            for w in own:
                if home not in holders.setdefault(w, []):
                    holders[w].append(home)
            out.append((name, names[home]))
        return pd.DataFrame(out, columns=["id", "cluster"])

    return df.select(*keys, "id", "words").groupBy(*keys).applyInPandas(run, "id long, cluster long")
