"""Streams over file sources, with event-time watermarks; each has a batch twin in ``operators.stateful``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import threads as TH
from ..operators.stateful import BREAKER, breaker_step
from ..session import ensure_checkpoint_dir


def read_events(spark: SparkSession, folder: str, table: str = "events", per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream; its zone-less time becomes a timestamp, as watermarks need one."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return stream.parquet(f"{folder}/{table}.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table of the shared folder, and reads that."""
    spark = ensure_checkpoint_dir(stream.sparkSession)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def replayed(rows: DataFrame, ts: str = "ts", slices: int = 12) -> DataFrame:
    """A table as a stream in the order of its times: so many slices of about equal size, each a file and a micro-batch.

    Slices are cut by approximate quantiles and written one after the other, as files of a stream arrive: all
    tasks read and filter the table, one writes a slice.
    """
    spark = ensure_checkpoint_dir(rows.sparkSession)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/replay-{uuid.uuid4().hex}"
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = rows.withColumn("__at", F.unix_micros(ts))
    edges = sorted(set(timed.approxQuantile("__at", [i / slices for i in range(1, slices)], 0.001)))
    for low, high in zip([None, *edges], [*edges, None]):
        part = timed if low is None else timed.filter(F.col("__at") >= int(low))
        part = part if high is None else part.filter(F.col("__at") < int(high))
        part.drop("__at").repartition(1).write.mode("append").parquet(base)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(base)


#: Buckets of keys: one call and one state serve the keys of a bucket, as a call for each key costs far more than its rows.
BUCKETS = 1024


def _bucketed(stream: DataFrame, keys: list[str], late: str, buckets: int, *rest):
    """Rows with their bucket, and their keys as strings, so that a bucket's keys keep their values whatever stands beside them."""
    names = [f"k{i}" for i in range(len(keys))]
    own = [F.col(k).cast("string").alias(c) for k, c in zip(keys, names)]
    timed = stream.withWatermark("ts", late).select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"), *own, "ts", F.unix_micros("ts").alias("at"), *rest)
    return names, timed.groupBy("bucket")


def _held(state: GroupState) -> dict[tuple, int]:
    """The moments of a bucket's keys."""
    return {tuple(key): at for key, at in json.loads(state.get[0])} if state.exists else {}


def _hold(state: GroupState, held: dict[tuple, int], wake: int | None) -> None:
    """Keeps a bucket's moments, and sets its timer (milliseconds)."""
    if not held:
        if state.exists:
            state.remove()
        return
    state.update((json.dumps([[list(key), at] for key, at in held.items()]),))
    state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))


def first_within(stream: DataFrame, keys: list[str], row: str, seconds: int, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Rows that are the first of their key within a time to live counted from the last row let through.

    The state of a key is the moment at which its time to live ends; it goes when the watermark passes that, with the
    next rows of its bucket or when all of its bucket's are over.
    Rows of a micro-batch go by time; those older than the watermark are dropped.
    """
    ttl = seconds * 1_000_000
    names = [f"k{i}" for i in range(len(keys))]

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.getCurrentWatermarkMs() * 1000
        held = {key: until for key, until in _held(state).items() if until > mark}
        rows, kept = pd.concat(list(batches)).sort_values(["at", row]), []
        for i, (*key, at) in enumerate(zip(*(rows[c].tolist() for c in (*names, "at")))):
            key = tuple(key)
            until = held.get(key)
            if until is None or at >= until:
                kept.append(i)
                held[key] = at + ttl
        _hold(state, held, max(held.values()) // 1000 + 1)
        yield rows.iloc[kept][[*names, row]]

    names, bucketed = _bucketed(stream, keys, late, buckets, row)
    types = ", ".join([*[f"{c} string" for c in names], f"{row} {stream.schema[row].dataType.simpleString()}"])
    found = bucketed.applyInPandasWithState(update, types, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*[F.col(c).cast(stream.schema[k].dataType).alias(k) for c, k in zip(names, keys)], row)


def gone_quiet(stream: DataFrame, key: str, seconds: int, every: int, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """A watchdog: (key, at) of each check, one every so many seconds, that first finds a key's last row so many seconds old.

    Timers of event time raise the alarm when no row comes; a key is silent from then on until its next row.
    """
    first_check = lambda last: -(-(last + seconds * 1_000_000) // (every * 1_000_000)) * every * 1_000_000

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, quiet = _held(state), []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("at")
            for name, at in zip(rows["k0"].tolist(), rows["at"].tolist()):
                last = held.get((name,))
                if last is not None and first_check(last) < at:
                    quiet.append((name, first_check(last)))
                held[(name,)] = at if last is None else max(last, at)
        mark, wake = state.getCurrentWatermarkMs(), None
        for (name,), last in list(held.items()):
            check = first_check(last)
            if check // 1000 < mark:
                quiet.append((name, check))
                del held[(name,)]
            elif wake is None or check // 1000 < wake:
                wake = check // 1000
        _hold(state, held, wake)
        yield pd.DataFrame(quiet, columns=["k0", "at"])

    _, bucketed = _bucketed(stream, [key], late, buckets)
    found = bucketed.applyInPandasWithState(update, "k0 string, at long", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("k0").cast(stream.schema[key].dataType).alias(key), F.timestamp_micros("at").alias("at"))


def threads_of(stream: DataFrame, scope: tuple[str, ...] = ("country_code",), late: str = "10 minutes") -> DataFrame:
    """Each report's thread as it comes: keyed state holds a scope's active threads, and goes when none can be joined any more.

    Equal to ``operators.threads.assigned`` where micro-batches come in the order of time; rows older than the watermark are dropped.
    """
    keys = [f"scope_{c}" for c in scope]

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        walk = TH.Walk(state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])[TH.FACTS]
        placed = [(row[1], *walk.place(*row)) for row in rows.itertuples(index=False)]
        state.update((walk.state(),))
        state.setTimeoutTimestamp(max(walk.last() // 1000 + TH.QUIET_HOURS * 3_600_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(placed, columns=["id", "thread", "relevance"])

    kind = stream.schema["id"].dataType.simpleString()
    timed = TH.reports(stream.withWatermark("created_at", late), list(scope), "created_at")
    return timed.groupBy(*keys).applyInPandasWithState(update, f"id {kind}, thread {kind}, relevance double", "threads string", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_counts(stream: DataFrame, key: str, size: str, step: str, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, step), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Bursts of a key's rows without a pause."""
    grouped = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def flash(stream: DataFrame, least: float) -> DataFrame:
    """Rows that are dispatched at once."""
    return stream.filter(F.col("value") >= least)


def breakers(stream: DataFrame, key: str, failed: str, failures: int = 5, late: str = "10 minutes", idle_days: int = 30) -> DataFrame:
    """Each key's circuit breaker as a state machine; a row for each of its changes.

    Rows older than the last one of their key don't change history; a key's state goes when it was idle for so long.
    """

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *now, last = state.get if state.exists else (*BREAKER, 0.0)
        now, changes = tuple(now), []
        for ts, bad in pd.concat(list(batches)).sort_values(["ts", "row"])[["ts", failed]].itertuples(index=False):
            at = ts.timestamp()
            if at < last:
                continue
            after = breaker_step(now, at, bool(bad), failures)
            if after[0] != now[0]:
                changes.append((group[0], ts, after[0]))
            now, last = after, at
        state.update((*now, last))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        yield pd.DataFrame(changes, columns=[key, "ts", "state"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark("ts", late).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, ts timestamp, state string", "state string, count int, opens int, until double, last double", "append", GroupStateTimeout.EventTimeTimeout
    )


def topic_batches(stream: DataFrame, topic, path: str, log: str):
    """A query that groups the articles of every micro-batch by topic and appends the groups, by batch."""

    def group(batch: DataFrame, number: int) -> None:
        topic_groups(batch.withColumn("topic", topic)).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return stream.writeStream.foreachBatch(group).option("checkpointLocation", log).trigger(availableNow=True).start()


def topic_groups(articles: DataFrame) -> DataFrame:
    """(topic, id, source) -> topic, n, sources and the first id of each topic."""
    return articles.groupBy("topic").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("id").alias("first_id"))


def upsert_each_batch(stream: DataFrame, path: str, log: str, merge):
    """A query that hands every micro-batch to ``merge(batch, path)``, which must be idempotent."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge(batch, path)).option("checkpointLocation", log).trigger(availableNow=True).start()


def count_each_batch(stream: DataFrame, keys: list[str], change: str, path: str, log: str, merge_every: int = 8):
    """A query that keeps counts as changes come: each micro-batch adds its own sums, and every so many are merged with all before.

    A batch's sums and a merge are named by the batch's number, so a batch that comes again replaces what it wrote.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum(change).alias("n")).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")
        if number % merge_every == merge_every - 1:
            maintained_counts(batch.sparkSession, path, keys, number).write.mode("overwrite").parquet(f"{path}/merged/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", log).trigger(availableNow=True).start()


def maintained_counts(spark: SparkSession, path: str, keys: list[str], until: int | None = None) -> DataFrame:
    """The counts kept under a path (after a batch, before its merge): the last merge and the sums since; keys whose changes cancel out have 0."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/merged")
    sums = spark.read.parquet(f"{path}/sums")
    sums = sums if until is None else sums.filter(F.col("batch") <= until)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        merged = spark.read.parquet(f"{path}/merged")
        last = (merged if until is None else merged.filter(F.col("batch") < until)).agg(F.max("batch")).first()[0]
        if last is not None:
            sums = sums.filter(F.col("batch") > last).unionByName(merged.filter(F.col("batch") == last))
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"))


def sync_each_batch(stream: DataFrame, keys: list[str], order: str, path: str, log: str, merge_every: int = 8):
    """A query that brings every micro-batch's rows into a table with keys: of a key, the row of the last micro-batch stays.

    Of a key's rows in one micro-batch that with the greatest ``order`` stays. A batch and a merge are named by the
    batch's number, so a batch that comes again replaces what it wrote, and rows that come twice are there once.
    """

    def bring(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.to_json(F.struct(*rest)))).alias("row"))
        newest.write.mode("overwrite").parquet(f"{path}/new/batch={number}")
        if number % merge_every == merge_every - 1:
            _synced(batch.sparkSession, path, keys, number).write.mode("overwrite").parquet(f"{path}/merged/batch={number}")

    return stream.writeStream.foreachBatch(bring).option("checkpointLocation", log).trigger(availableNow=True).start()


def _synced(spark: SparkSession, path: str, keys: list[str], until: int | None = None) -> DataFrame:
    new = spark.read.parquet(f"{path}/new")
    new = new if until is None else new.filter(F.col("batch") <= until)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/merged")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        merged = spark.read.parquet(f"{path}/merged")
        last = (merged if until is None else merged.filter(F.col("batch") < until)).agg(F.max("batch")).first()[0]
        if last is not None:
            new = new.filter(F.col("batch") > last).unionByName(merged.filter(F.col("batch") == last))
    return new.groupBy(*keys).agg(F.max_by("row", "batch").alias("row"))


def synced(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that ``sync_each_batch`` keeps under a path: the last merge and the batches since."""
    return _synced(spark, path, keys).select(*keys, "row.*")
