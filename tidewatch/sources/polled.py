"""A polled table as a stream of Spark: offsets are moments of event time, each poll looks back a little, a restart replays.

A poll reads the rows after the last poll's moment, less an overlap for rows that came late, up to its own moment.
The moment is the clock or, as everywhere in this library, an explicit ``as_of``.  The moments of polls are the
query's offsets, so a query that is stopped or killed goes on where its checkpoint stands, and a poll that was begun
is read again with the same bounds (a run of ``availableNow`` may end with it; the next one goes on).  Rows of the overlap come twice: write them to a sink with keys
(``streaming.streams.sync_each_batch``).

Tasks read lists of files; a file's row groups outside the poll's time are skipped by their statistics, and only
the columns of the given schema are read.  The driver lists names and opens no file.

Defined cases: rows without a time belong to no poll; an empty or absent folder gives no rows; a moment
before the last one reads nothing, and the next poll goes on from there, so rows are read again rather than lost; columns of the files that the schema lacks are not read.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

BEGINNING = -(1 << 62)


@dataclass
class Part(InputPartition):
    """Files of one task, and the poll's bounds in microseconds: after the first, up to the second."""

    files: tuple[str, ...]
    after: int
    until: int


class Polled(DataSource):
    """Options: path (a folder of Parquet files), time (the column), overlap (seconds), as_of (microseconds; without: the clock), files (a task's number of files)."""

    @classmethod
    def name(cls) -> str:
        return "polled"

    def streamReader(self, schema: StructType) -> PolledReader:
        return PolledReader(dict(self.options), schema.json())


class PolledReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: str):
        self.path, self.time = options["path"], options["time"]
        self.overlap, self.files = int(float(options.get("overlap", 420)) * 1_000_000), int(options.get("files", 8))
        self.as_of, self.columns = options.get("as_of"), schema

    def initialOffset(self) -> dict:
        return {"until": BEGINNING}

    def latestOffset(self) -> dict:
        return {"until": int(self.as_of) if self.as_of is not None else int(time.time() * 1_000_000)}

    def _folder(self):
        """The file system of the path, and the path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)

    def _listed(self) -> list[str]:
        from pyarrow.fs import FileSelector

        system, folder = self._folder()
        found = system.get_file_info(FileSelector(folder, allow_not_found=True, recursive=True))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")) and "/_temporary/" not in f.path)

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        if end["until"] <= start["until"]:
            return [Part((), 0, 0)]
        names = self._listed()
        after = start["until"] - self.overlap if start["until"] > BEGINNING else BEGINNING
        return [Part(tuple(names[a : a + self.files]), after, end["until"]) for a in range(0, len(names), self.files)] or [Part((), 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(StructType.fromJson(json.loads(self.columns)), timestamp_utc=True)
        system = self._folder()[0]
        for name in partition.files:
            data = ds.dataset(name, filesystem=system, format="parquet")
            kind = data.schema.field(self.time).type
            low, high = (pa.scalar(m, pa.timestamp("us")).cast(pa.timestamp("us", kind.tz)) for m in (partition.after, partition.until))
            due = (pc.field(self.time) > low) & (pc.field(self.time) <= high) if partition.after > BEGINNING else pc.field(self.time) <= high
            for batch in data.to_batches(columns=schema.names, filter=due, use_threads=False):
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    def commit(self, end: dict) -> None:
        """Nothing is to be given up: the folder is not a queue."""

    def stop(self) -> None:
        """Nothing is held open."""


def polled(spark: SparkSession, path: str, schema: StructType, time_column: str = "ts", overlap: float = 420, as_of: int | None = None) -> DataFrame:
    """A folder's rows as a stream of polls; one run with ``availableNow`` is one poll."""
    spark.dataSource.register(Polled)
    stream = spark.readStream.format("polled").schema(schema).option("path", path).option("time", time_column).option("overlap", str(overlap))
    return (stream if as_of is None else stream.option("as_of", str(as_of))).load()
