"""Importance resampling of documents towards a target distribution of hashed n-grams.

Features are all runs of 1 to 3 consecutive words; a feature's bucket is a checksum of its
bytes.  The distribution over buckets of the raw corpus and that of the target texts give each
bucket a gain, the logarithm of their ratio; a document's weight is the sum of the gains of
its features, and documents are drawn by weight and Gumbel noise of a hash.

1. Each run of texts makes a dictionary of its distinct n-grams with their counts, on numbers
   of its words, and sends the strings, compressed, to parts by a hash of the words' hashes.
2. A part counts its strings: a global dictionary, each string once.  Spark hashes each of
   them once and sums up the buckets.
3. The gains, a row a bucket, go back to each document's feature counts; a run of texts hashes
   each distinct word once and derives the features' checksums from these.
4. Scores are ranked by a range partition of (score, doc_id): places inside a partition, and
   the sums of the partitions before it.

Strings meet once in (1) and no document's features are shuffled.  Only the gains (a number
a bucket) and one row a partition come together.

Defined cases: null and empty texts have no features, weight 0 and a score; repeated
rows are rows of their own; equal scores go to the smaller doc_id, a null one last, and then
in any order; without target texts the gains follow from the raw counts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import with_id
from .words import Words, give_back, mix, pieces

#: Buckets of the features' checksums, and words of a feature at most.
BUCKETS, LONGEST = 10_000, 3
#: Bytes of texts that share a dictionary, and strings of a part of the global one, on average.
RUN, PART = 6 << 20, 2 << 20
#: Bytes between words: all of ASCII but digits and letters.
_GAPS = np.zeros(256, dtype=bool)
_GAPS[:0x80] = True
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_SALTS = np.random.default_rng(20251011).integers(1, 1 << 63, size=LONGEST, dtype=np.uint64) | np.uint64(1)


class Grams:
    """The distinct runs of 1 to ``longest`` words of some texts: for each length the numbers of their words (a column a place), spreads (hashes of the words) and counts."""

    def __init__(self, texts: pa.Array, longest: int):
        words = Words(texts, lower=True, gaps=_GAPS)
        self.names, ids = words.distinct()
        ids = ids.astype(np.int64)
        owner = np.repeat(np.arange(len(words.counts)), words.counts)
        hashes = np.zeros(len(self.names), np.uint64)
        hashes[ids] = words.hashes
        del words
        size = max(len(self.names), 1)
        numbers, columns = ids, [np.arange(len(self.names))]
        self.grams = [(columns, mix(hashes * _SALTS[0]), np.bincount(ids, minlength=len(self.names)))]
        for n in range(2, longest + 1):
            # a run of n words is one of n - 1, and the next word if it is of the same text
            first = owner[n - 1 :] == owner[: max(len(owner) - n + 1, 0)]
            keys = (numbers[: len(first)] * size + ids[n - 1 :])[first] if len(first) else np.zeros(0, np.int64)
            if n < longest:
                found, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
                numbers = np.zeros(len(first), np.int64)
                numbers[first] = place
            else:
                found, counts = np.unique(keys, return_counts=True)
            head, tail = found // size, found % size
            columns = [c[head] for c in columns] + [tail]
            spread = hashes[columns[0]]
            for salt, c in zip(_SALTS[1:], columns[1:]):
                spread = mix(spread * salt + hashes[c])
            self.grams.append((columns, spread, counts))


def _joined(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """The strings one after the other, each with an end byte that no word holds, and their edges."""
    values = pc.binary_join_element_wise(values, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    edges = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    return edges, memoryview(values.buffers()[2] or b"")


def _split(data: bytes) -> pa.Array:
    data = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    text = np.delete(data, ends) if len(ends) else data
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends - np.arange(len(ends))])), pa.py_buffer(text)])


def _common(texts: DataFrame, rows: int = 1000, most: int = (1 << 16) - 1) -> list[bytes]:
    """Frequent words of a bounded sample of text: packets name them by number.  Only the packets' size hangs on them."""
    sample = pa.array([r["text"] for r in texts.filter("text is not null").select(F.substring("text", 1, 4096).alias("text")).limit(rows).collect()], pa.string())
    names, ids = Words(sample, hashes=False, lower=True, gaps=_GAPS).distinct()
    return names.take(pa.array(np.argsort(-np.bincount(ids, minlength=len(names)), kind="stable")[:most])).to_pylist()


def _planes(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes()


def _send(parts: int, longest: int, run_bytes: int, common: list[bytes]):
    """Each run of texts' dictionary, dealt out to parts: the first words once with the number of their n-grams, further words, counts.

    Words are numbers of common ones; others are spelt out, with an end byte that no word holds.
    """

    def packets(texts: pa.Array, target: bool):
        pack = zstandard.ZstdCompressor(level=3).compress
        found = Grams(texts, longest)
        code = np.asarray(pc.fill_null(pc.index_in(found.names, value_set=pa.array(common, pa.large_binary())), len(common))).astype(np.int64)
        for n, (columns, spread, counts) in enumerate(found.grams, 1):
            part = (spread >> np.uint64(32)).astype(np.int64) * parts >> 32
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            part, counts = part[order], counts[order]
            number, at = np.unique(part, return_index=True)
            cut = np.append(at, len(order))
            head = columns[0][order]
            new = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (part[1:] != part[:-1])][: len(head)])
            runs = np.diff(np.append(new, len(head)))
            at = np.searchsorted(new, cut)
            head, rest = head[new], [c[order] for c in columns[1:]]
            for p, i, j, u, v in zip(number.tolist(), cut.tolist(), cut[1:].tolist(), at.tolist(), at[1:].tolist()):
                words = np.concatenate([head[u:v], *[c[i:j] for c in rest]])
                codes = code[words]
                edges, spelt = _joined(found.names.take(pa.array(words[codes == len(common)])))
                yield p, target, n, j - i, pack(_planes(codes)), pack(spelt[edges[0] : edges[-1]]), pack(np.concatenate([runs[u:v], counts[i:j]]).astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target in (False, True):
                texts = batch.filter(batch.column("target") if target else pc.invert(batch.column("target"))).column("text")
                for a, b in pieces(texts, run_bytes):
                    rows = list(packets(texts.slice(a, b - a), target))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(_PACKET), _PACKET)], names=_NAMES)
                    give_back()

    return run


_PACKET = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["part", "target", "n", "many", "codes", "rare", "numbers"]


def _count(common: list[bytes]):
    """The dictionary of a part: each string once, with its counts in the raw and the target texts."""

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        known = pa.array(common, pa.large_binary())
        strings, counts, many = [], [], []
        for r in table.select(_NAMES).to_pylist():
            n = r["n"]
            codes = np.frombuffer(unpack(r["codes"]), np.uint8).reshape(2, -1).T
            codes = np.ascontiguousarray(codes).view("<u2").ravel().astype(np.int64)
            rare = codes == len(common)
            codes[rare] += np.arange(int(rare.sum()))
            words = pa.concat_arrays([known, _split(unpack(r["rare"]))]).take(pa.array(codes))
            heads = len(words) - r["many"] * (n - 1)
            numbers = np.frombuffer(unpack(r["numbers"]), "<u4").astype(np.int64)
            columns = [words.take(pa.array(np.repeat(np.arange(heads), numbers[:heads])))] + [words.slice(heads + r["many"] * k, r["many"]) for k in range(n - 1)]
            strings.append(pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())))
            counts.append(numbers[heads:])
            many.append(r["many"])
        target = np.repeat(np.asarray(table.column("target").to_numpy()), many)
        coded = pa.chunked_array(strings).dictionary_encode().combine_chunks() if strings else None
        del strings
        feature = coded.dictionary.cast(pa.binary())
        place, counts = np.asarray(coded.indices), np.concatenate(counts)
        del coded
        sums = [np.bincount(place[x], counts[x], len(feature)).astype(np.int64) for x in (~target, target)]
        give_back()
        return pa.table([feature, *map(pa.array, sums)], names=["feature", "n", "n_target"])

    return run


def dictionary(docs: DataFrame, target: DataFrame, longest: int = LONGEST, run_bytes: int = RUN, part_strings: int = PART) -> DataFrame:
    """feature (its bytes), n and n_target of every distinct n-gram of the texts of ``docs`` and ``target``."""
    texts = docs.select(F.col("text").cast("string").alias("text"), F.lit(False).alias("target")).union(target.select(F.col("text").cast("string"), F.lit(True)))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size * longest / 6 / part_strings))  # a word and its gap take some six bytes
    common = _common(texts)
    sent = texts.mapInArrow(_send(parts, longest, run_bytes, common), "part int, target boolean, n int, many int, codes binary, rare binary, numbers binary")
    return sent.groupBy("part").applyInArrow(_count(common), "feature binary, n long, n_target long")


def gains(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: floor(1000 * the logarithm of the smoothed ratio of its shares in the target and the raw texts)."""
    sums = features.groupBy((F.crc32("feature") % buckets).cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in sums.collect():  # a row a bucket
        s[r["bucket"]], t[r["bucket"]] = r["n"], r["n_target"]
    total, wanted = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (total + buckets) / ((x + 1) * (wanted + buckets)))) for x, y in zip(s.tolist(), t.tolist())], dtype=np.int64)


def _shifts() -> np.ndarray:
    """What each byte of a checksum becomes when 0, 1, 2, ... 63 bytes follow: [bytes][place][value]."""
    step = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for value in range(256):
            # checksums are linear: the effect of the first part on a checksum is that on one of zeros
            step[place, value] = zlib.crc32(b"\0", value << 8 * place) ^ zlib.crc32(b"\0", 0)
    out = np.zeros((64, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(1, 64):
        out[n] = _shifted(out[n - 1], np.ones(out[0].shape, np.int64), np.stack([out[0], step]))
    return out


def _shifted(sums: np.ndarray, places: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    flat, base = shifts.ravel(), places << 10
    out = flat[base | (sums & 255)]
    for k in (1, 2, 3):
        out = out ^ flat[base | k << 8 | (sums >> np.uint32(8 * k) & np.uint32(255))]
    return out


_SHIFTS = _shifts()


def joined_sums(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums (crc32) of strings that consist of a left and a right part, from those of the parts and the right part's size."""
    out = _shifted(left, size & 63, _SHIFTS)
    level, rest = _SHIFTS[63], size >> 6
    if rest.any():
        level = _shifted(_SHIFTS[1], np.full(level.shape, 63), _SHIFTS)  # 64 bytes
        while rest.any():
            some = np.flatnonzero(rest & 1)
            pair = np.stack([_SHIFTS[0], level])
            out[some] = _shifted(out[some], np.ones(len(some), np.int64), pair)
            level, rest = _shifted(level, np.ones(level.shape, np.int64), pair), rest >> 1
    return out ^ right


def _weigh(gain: np.ndarray, longest: int, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in pieces(texts, run_bytes):
                words = Words(texts.slice(a, b - a), hashes=False, lower=True, gaps=_GAPS)
                names, ids = words.distinct()
                edges, data = _joined(names)
                edges = edges.tolist()
                # each distinct word is hashed once, alone and with the blank before it; longer features' checksums follow from these
                alone, after = (np.fromiter((zlib.crc32(data[i : j - 1], start) for i, j in zip(edges, edges[1:])), np.uint32, len(names)) for start in (0, zlib.crc32(b" ")))
                size = np.diff(edges)
                owner = words.texts_of_words()
                sums, many, weight = alone[ids], words.counts.copy(), np.bincount(owner, gain[alone[ids] % len(gain)], b - a)
                for n in range(2, longest + 1):
                    next_ = ids[n - 1 :]
                    sums = joined_sums(sums[: len(next_)], after[next_], size[next_])
                    same = owner[n - 1 :] == owner[: len(next_)]
                    # sums of whole numbers below 2**53 are exact in doubles
                    weight += np.bincount(owner[: len(next_)][same], gain[sums[same] % len(gain)], b - a)
                    many += np.maximum(words.counts - n + 1, 0)
                columns = [many, words.counts, weight]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(x.astype(np.int64)) for x in columns]], names=["doc_id", "n_features", "n_words", "weight"])

    return run


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, run_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_features, n_words and weight (the sum of its features' gains) of every row."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_weigh(gain, longest, run_bytes), with_id(texts, "n_features long, n_words long, weight long"))


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with rank: 1, 2, 3... by falling score, ties to the smaller doc_id."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("nth")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # nth parts rows that are alike, and the checkpoint holds the partitions for good
    placed = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).checkpoint()
    before = F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # over a row a partition
    sums = placed.groupBy("part").agg(F.count("*").alias("many")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.withColumn("inside", inside).join(F.broadcast(sums), "part").withColumn("rank", (F.col("inside") + F.col("before")).cast("long")).drop("part", "nth", "inside", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row: ``percent`` of those of at least so many words are drawn."""
    gain = gains(dictionary(docs, target, longest), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = weights(docs, gain, longest).withColumn("score", (F.col("weight") + noise).cast("long")).checkpoint()
    enough = F.col("n_words") >= least_words
    asked = ranked(scored.filter(enough))
    many = scored.filter(enough).count() * percent // 100
    names = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= many, F.col("rank")).alias("rank")
    return asked.select(*names, rank).union(scored.filter(~enough).select(*names, F.lit(None).cast("long").alias("rank")))
