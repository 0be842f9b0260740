"""Substring de-duplication: every passage of ``width`` words that starts more than once goes.

Windows of ``width`` words get Rabin-Karp hashes, rolled over the words' own hashes,
and Spark counts them.  Counting every window of a corpus moves more bytes than the
corpus has, so windows that cannot repeat are left out first, exactly: each window is
assigned the smallest hash among its GRAM-word grams (its anchor).  The anchor depends
on the window's words alone, so equal windows have equal anchors, and a window whose
anchor's gram occurs once in the corpus occurs once too.  About one gram in twelve is
an anchor, so counting those is cheap; only windows with a repeated anchor are counted.

No data are collected and nothing is broadcast but what Spark makes of small sides:

1. count anchors, and find each text's repeated anchors;
2. count exact copies of texts: of each group one row stands for all (weight two);
3. count the windows at repeated anchors, and find each text's repeated windows;
4. merge them into maximal runs of words, and remove those.

Texts cross the network once, each compressed: steps 3 and 4 read the same exchange.

Windows are told apart by 96 bits of two independent Rabin-Karp hashes modulo a prime, over
two independent hashes of the words, and rows of one doc_id and text by 96 bits too: among n
windows that differ, about n**2 / 2**97 repeats are false.  An anchor's 61 bits need not be
exact: a false repeat only adds windows to count.

Defined cases: null and empty texts have no words and keep the empty string; texts
shorter than ``width`` words keep all; rows that repeat a doc_id and text are copies;
an empty table gives no rows; the input's columns pass through whatever their names, the text
as a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .columns import as_row, with_row
from .words import Words, mix, pieces, rolled, windows

#: Words of an anchor gram.
GRAM = 12
#: Compressed bytes that are unpacked at a time (a single longer text is a piece of its own).
PACKED = 1 << 19
_PLACE = np.uint64((1 << 28) - 1)


def _grams(width: int) -> int:
    return min(GRAM, width)


def _anchors(words: Words, width: int):
    """Starts of all windows, their texts, and the word at which each window's anchor gram starts; hashes of all grams."""
    start, text = windows(words.first, words.counts, width)
    gram = _grams(width)
    n = len(words.starts) - gram + 1
    if not len(start):
        return start, text, start, np.zeros(0, np.uint64)
    at = np.arange(n)
    grams = mix(rolled(words.hashes, gram))
    least = (grams & ~_PLACE) | at.astype(np.uint64)  # ties go to the first place
    span, have = width - gram + 1, 1
    while have < span:  # least of the grams at i .. i + span - 1
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return start, text, (least[start] & _PLACE).astype(np.int64), grams


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else values


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text compressed on its own, so that it stays so until the task that needs it."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        packed = pa.array([pack(memoryview(x.as_buffer())) if x.is_valid else None for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("rest"), packed, batch.column("key"), batch.column("also_key")], names=["rest", "packed", "key", "also_key"])


def _texts(packed: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(memoryview(x.as_buffer())) if x.is_valid else None for x in packed], pa.large_binary()).cast(pa.large_string())


def _spots(keys: np.ndarray, low: np.ndarray) -> pa.Array:
    """The second half of a row's key above a number below 2**32."""
    return pa.array(keys.astype(np.int64) << 32 | low)


def _count_anchors(width: int):
    """Each run of texts' anchors, those that repeat in it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in pieces(texts):
                _, _, anchor, grams = _anchors(Words(texts.slice(a, b - a)), width)
                gram, n = np.unique(grams[anchor[_first_of_runs(anchor)]].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([gram, gram[n > 1]]))], names=["gram"])

    return run


def _place_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, more = batch.column("text"), np.asarray(batch.column("key")), np.asarray(batch.column("also_key"))
            for a, b in pieces(texts):
                words = Words(texts.slice(a, b - a))
                _, text, anchor, grams = _anchors(words, width)
                one = _first_of_runs(anchor)
                anchor, text = anchor[one], text[one]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[anchor].view(np.int64)), pa.array(keys[a:b][text]), _spots(more[a:b][text], anchor - words.first[text])],
                    names=["gram", "key", "spot"],
                )

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of list<int> rows and the row of each; null rows have none."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    return np.asarray(lists.flatten(), dtype=np.int64), np.repeat(np.arange(len(counts)), counts)


def _candidate_windows(width: int):
    """Windows at repeated anchors: (window, also, id, start), the start as ~start for a row that stands for its copies, which weighs two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, ids, places = batch.column("packed"), np.asarray(batch.column("id")), batch.column("places")
            copies = np.asarray(batch.column("copies"))
            for a, b in pieces(packed, PACKED):
                words = Words(_texts(packed.slice(a, b - a)))
                start, text, anchor, _ = _anchors(words, width)
                value, row = _flat(places.slice(a, b - a))
                wanted = np.zeros(len(words.starts) + 1, dtype=bool)
                wanted[words.first[row] + value] = True
                keep = wanted[anchor]
                start, text = start[keep], text[keep]
                keep, also = rolled(words.hashes, width)[start], rolled(words.also, width, 1)[start]
                place = start - words.first[text]
                window = (keep << np.uint64(3) | also >> np.uint64(58)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(window), pa.array((also & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)), pa.array(ids[a:b][text]),
                        pa.array(np.where(copies[a:b][text] > 1, ~place, place).astype(np.int32)),
                    ],
                    names=["window", "also", "id", "start"],
                )

    return run


def _remove(width: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("packed")
            rest = dict(zip((c for c in columns if c != "text"), batch.column("rest").flatten()))
            for a, b in pieces(packed, PACKED):
                part = _texts(packed.slice(a, b - a)).cast(pa.string())
                whole = pa.StructArray.from_arrays([part if c == "text" else rest[c].slice(a, b - a) for c in columns], columns)
                words = Words(part, hashes=False)
                value, row = _flat(batch.column("starts").slice(a, b - a))
                copies = np.asarray(batch.column("copies").slice(a, b - a))
                edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
                np.add.at(edge, words.first[row] + value, 1)
                np.add.at(edge, words.first[row] + value + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                gone |= np.repeat((copies > 1) & (words.counts >= width), words.counts)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                kept = []
                for i in range(b - a):
                    own = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
                    if removed[i]:
                        stay = np.flatnonzero(~gone[words.first[i] : words.first[i + 1]])
                        own = [own[k] for k in stay]
                    kept.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [whole, pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["row", "n_words", "n_removed", "kept"],
                )

    return run


def _repeated(rows: DataFrame, column: str, weight: Column, *more: str) -> DataFrame:
    """The values of a column of longs (with those of further columns) whose weights sum to over one.

    They are counted by their complement: the result then has no known partitioning,
    so a join on it deals both sides out anew and Spark can split a hot key's rows.
    """
    flipped = F.bitwise_not(F.col(column)).alias("flipped")
    return rows.groupBy(flipped, *more).agg(F.sum(weight).alias("n")).filter("n > 1").select(F.bitwise_not("flipped").alias(column), *more)


def remove_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """row (a struct of the input's columns), n_words, n_removed and kept, the words that stay joined by one space."""
    ids = [F.xxhash64("doc_id", "text").alias("key"), F.hash(F.lit(7), "text", "doc_id").alias("also_key")]
    text = F.col("text").cast("string").alias("text")
    keyed = docs.select(as_row([c for c in docs.columns if c != "text"]).alias("rest"), text, *ids)
    keyed = keyed.mapInArrow(_pack, StructType([keyed.schema["rest"], *StructType.fromDDL("packed binary, key long not null, also_key int not null").fields]))
    plain = docs.select(text, *ids)
    # a run of texts sends an anchor twice at most, so these rows are dealt out as they are
    anchors = plain.select("text").mapInArrow(_count_anchors(width), "gram long").select(F.bitwise_not("gram").alias("flipped")).repartition("flipped")
    repeated = anchors.groupBy("flipped").count().filter("count > 1").select(F.bitwise_not("flipped").alias("gram"))
    also, low = F.shiftright("spot", 32).cast("int").alias("also_key"), F.col("spot").bitwiseAND((1 << 32) - 1)
    places = plain.mapInArrow(_place_anchors(width), "gram long, key long, spot long").join(repeated, "gram").select("key", also, low.cast("int").alias("place"))

    own = plain.select("key", "also_key", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2"))
    groups = own.groupBy(F.bitwise_not("t1").alias("t3"), "t2").agg(F.count("*").alias("n"), F.min(F.struct("key", "also_key")).alias("one")).filter("n > 1")
    groups = groups.select(F.bitwise_not("t3").alias("t1"), "t2", "one")
    many = own.join(groups, ["t1", "t2"]).select("key", "also_key", F.when(F.struct("key", "also_key") == F.col("one"), 2).otherwise(3).alias("copies"))

    facts = places.groupBy("key", "also_key").agg(F.collect_set("place").alias("places"), F.lit(1).alias("copies")).unionByName(
        many.groupBy("key", "also_key").agg(F.max("copies").alias("copies")), allowMissingColumns=True
    )
    facts = facts.groupBy("key", "also_key").agg(F.first("places", ignorenulls=True).alias("places"), F.max("copies").alias("copies"))
    # windows name a row by its number, which holds from the checkpoint on and takes fewer bytes than its keys
    facts = facts.withColumn("id", F.monotonically_increasing_id()).checkpoint()

    # the column rest goes along and keys can't be null, so that Spark sees the same exchange of texts here and below
    known = keyed.join(facts.filter("places is not null and copies < 3"), ["key", "also_key"]).select("rest", "packed", "id", "places", "copies")
    found = known.mapInArrow(_candidate_windows(width), "window long, also int, id long, start int")
    twice = _repeated(found, "window", F.when(F.col("start") < 0, 2).otherwise(1), "also")
    starts = found.filter("start >= 0").join(twice, ["window", "also"]).groupBy("id").agg(F.collect_set("start").alias("starts"))
    marks = facts.select("key", "also_key", "copies", "id").join(starts, "id", "left").drop("id")
    row = docs.select(as_row(docs.columns)) if docs.schema["text"].dataType == StringType() else docs.withColumn("text", text).select(as_row(docs.columns))
    return (
        keyed.join(marks, ["key", "also_key"], "left")
        .select("rest", "packed", F.coalesce("copies", F.lit(1)).alias("copies"), "starts")
        .mapInArrow(_remove(width, docs.columns), with_row(row, "n_words long, n_removed long, kept string"))
    )


def deduplicated(docs: DataFrame, width: int = 35) -> DataFrame:
    """The documents with their repeated passages removed, in the columns of the input."""
    rows = remove_repeats(docs, width)
    changed = F.col("n_removed") > 0
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.when(changed, F.col("kept")).otherwise(value)
        elif c == "n_chars":
            value = F.when(changed, F.length("kept").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return rows.select(*columns)
