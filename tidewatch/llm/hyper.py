"""MinHash near-de-duplication on HyperMinHash registers.

A document's set has its runs of ``words`` consecutive words, A-Z in lower case (all of its
words, if it has fewer).  Two documents are linked if the Jaccard similarity of their sets is
at least ``similarity``; a component is what links join, over chains.

1. Documents with the same words in the same order are one class; 128 bits of a cryptographic
   hash tell them.
2. A class gets a HyperMinHash sketch: a register a bucket, for the least hash of the set in
   the bucket's own order, stored as its leading zeros and the MANTISSA bits after the first one: 16 bits.
   Bands of registers find candidates with the target recall; a band's classes are tied to
   its least one, and the ties' components are the candidate groups.
3. Inside a group, pairs of registers that agree give an estimate of the similarity,
   corrected for registers that agree by chance.  Pairs whose estimate is ``deviations`` standard
   deviations short of the threshold go; the others are verified on the full sets, unless links
   found before join them already.  A group is cut into blocks of bounded size; each is compared in
   itself and with the group's least class first, which settles groups of copies of one text in time
   in proportion to their size.  Only in groups that this leaves in several components do
   blocks meet blocks, and only pairs of different components are compared.
4. The components of all links are the result.

Defined cases: null, empty and blank texts have no set, link to nothing and are components of
their own; rows that repeat a doc_id each have their result; rows without a doc_id
take part and come last where the least doc_id names a component (null for one of only such rows), and aren't kept;
an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, fewer
from .columns import with_id
from .near import choose_bands, grams_of
from .words import Words, give_back, mix, pieces

#: Bits of a register after the leading zeros and the first one.
MANTISSA = 10
#: Shingles that a block may hold in sum (a single longer document makes a block of its own), and documents.
BLOCK, MEMBERS = 400_000, 1536
#: Rows of a block that are compared at a time.
ROWS = 128
#: A fixed value of the sketch: how often, in units of 2 ** -MANTISSA, registers of different sets of equal size agree.
CHANCE = 0.169919487159739093975315012348630288992889


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros (as 63 less their number) and mantissa bits of 64-bit hashes: what the exponent and fraction of a double hold."""
    bits = least.astype(np.float64).view(np.int64) >> (52 - MANTISSA)
    return np.clip(bits - (1023 << MANTISSA), 0, (1 << 16) - 1).astype(np.uint16)


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets of n and m members from the share of registers that agree, less what agrees by chance."""
    chance = CHANCE * 4.0 * n * m / (n + m) ** 2 / (1 << MANTISSA)
    return (agree - chance) / (1 - chance)


def _sets(texts: pa.Array, n: int) -> tuple[Words, list[np.ndarray]]:
    """The words of texts, and the sorted distinct shingles of each."""
    words = Words(texts, lower=True)
    grams, text = grams_of(words, n)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    return words, [np.unique(grams[i:j]) for i, j in zip(cuts, cuts[1:])]


def _sketch(n: int, bands: int, rows: int):
    numbers = np.random.default_rng(11).integers(0, 1 << 63, size=(2, bands * rows), dtype=np.uint64)
    masks, odds = numbers[0] * np.uint64(2) + np.uint64(1), numbers[1] | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.select(["doc_id", "tkey"])
            for a, b in pieces(texts, 1 << 19):
                words, sets = _sets(texts.slice(a, b - a), n)
                sizes = np.array([len(x) for x in sets])
                have = np.flatnonzero(sizes)
                grams, first = np.concatenate(sets), (np.cumsum(sizes) - sizes)[have]
                sketch = np.empty((len(have), bands * rows), dtype=np.uint16)
                for k in range(bands * rows if len(have) else 0):
                    sketch[:, k] = registers(np.minimum.reduceat((grams ^ masks[k]) * odds[k], first))
                band = np.zeros((len(have), bands), dtype=np.uint64)
                for k in range(rows):
                    band = mix(band + sketch[:, k::rows].astype(np.uint64) + np.uint64(1))
                band = mix(band ^ np.arange(bands, dtype=np.uint64)).view(np.int64)
                k1, k2 = words.texts_hashes(have).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *ids.slice(a, b - a).take(pa.array(have)).columns, pa.array(k1), pa.array(k2), pa.array(sizes[have]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(band.ravel())),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    names=["doc_id", "tkey", "k1", "k2", "n_shingles", "bands", "sketch"],
                )

    return run


def _load(n: int):
    """Sorted distinct shingles of each text that is the one asked for, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in pieces(texts, 1 << 19):
                words, sets = _sets(texts.slice(a, b - a), n)
                k1, k2 = words.texts_hashes(np.arange(b - a)).view(np.int64)
                own = (k1 == np.asarray(batch.column("k1").slice(a, b - a))) & (k2 == np.asarray(batch.column("k2").slice(a, b - a)))
                rest = [batch.column(c).slice(a, b - a) for c in ("class", "grp", "blocks", "sketch")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([x.tobytes() for x in sets], pa.binary())], names=["class", "grp", "blocks", "sketch", "grams"]).filter(pa.array(own))

    return run


class Verifier:
    """Joins the classes of a block, or of two, by their links."""

    def __init__(self, similarity: float, registers: int, deviations: float):
        self.ratio, self.registers = Fraction(str(similarity)), registers
        self.least = similarity - deviations * math.sqrt(similarity * (1 - similarity) / registers)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(a) + len(b) - len(np.union1d(a, b))
        return common * self.ratio.denominator >= (len(a) + len(b) - common) * self.ratio.numerator

    def labels(self, sets: list[np.ndarray], sketch: np.ndarray, labels: np.ndarray, left: int) -> np.ndarray:
        """Labels of rows after the links of rows before ``left`` with those from it on (with all, if left is the end): rows of one label are joined already."""
        labels = labels.copy()
        size = np.array([len(x) for x in sets], dtype=np.float64)
        right = left if left < len(sets) else 0
        columns = np.ascontiguousarray(sketch.T)
        for low in range(0, left, ROWS):
            rows = np.arange(low, min(low + ROWS, left))
            agree = np.zeros((len(rows), len(sets) - right), dtype=np.int32)
            for c in columns:
                agree += c[rows][:, None] == c[right:][None, :]
            n, m = size[rows][:, None], size[right:][None, :]
            maybe = estimate(agree / self.registers, n, m) >= self.least
            maybe &= np.minimum(n, m) * self.ratio.denominator >= np.maximum(n, m) * self.ratio.numerator
            for i, row in zip(rows.tolist(), maybe):
                rest = np.flatnonzero(row) + right
                rest = rest[labels[rest] != labels[i]]
                while len(rest):
                    j, rest = rest[0], rest[1:]
                    if self.linked(sets[i], sets[j]):
                        labels[labels == labels[j]] = labels[i]
                        rest = rest[labels[rest] != labels[i]]
        return labels


def _verify(verifier: Verifier):
    """Rows sorted by (grp, low, high): (class, root) of those that links join to another row of their pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, dict] = {}
        last = None

        def done():
            apart = [x for x in rows.values() if x["block"] != last[1]] if rows else []
            if len(rows) < 2 or (last[1] != last[2] and len(apart) in (0, len(rows))):
                return
            found = sorted(rows.values(), key=lambda x: (not x["spans"], x["class"]))
            if last[1] != last[2]:
                found.sort(key=lambda x: x["block"])
            sets = [np.frombuffer(x["grams"], np.uint64) for x in found]
            sketch = np.stack([np.frombuffer(x["sketch"], np.uint16) for x in found])
            # the rows' numbers as labels: the first row of each component
            _, start, place = np.unique([x["joined"] for x in found], return_index=True, return_inverse=True)
            labels = verifier.labels(sets, sketch, start[place], len(found) if last[1] == last[2] else len(found) - len(apart))
            # a component's root is its first row: the class that all of the group's blocks have, where it is in it
            _, start, place = np.unique(labels, return_index=True, return_inverse=True)
            labels = start[place]
            names = np.array([x["class"] for x in found])
            moved = labels != np.arange(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[labels[moved]])], names=["class", "root"])

        for batch in batches:
            give_back()
            for x in batch.to_pylist():
                key = x["grp"], x["low"], x["high"]
                if key != last:
                    yield from done()
                    rows, last = {}, key
                rows[x["class"]] = x
        yield from done()

    return run


def components_of(
    docs: DataFrame, similarity: float = 0.85, words: int = 3, recall: float = 0.9999, most_registers: int = 192, deviations: float = 6.0, block: int = BLOCK, members: int = MEMBERS
) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach, itself included) and kept (whether it is its own) of every row."""
    bands, rows = choose_bands(similarity, recall, most_registers)
    verifier = Verifier(similarity, bands * rows, deviations)
    text = F.col("text").cast("string")
    some = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tkey"), some.alias("some"))
    sketched = texts.filter("some").select("doc_id", "text", "tkey").mapInArrow(_sketch(words, bands, rows), with_id(texts, "tkey long, k1 long, k2 long, n_shingles long, bands array<long>, sketch binary")).checkpoint()

    rep = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "tkey")
    facts = F.struct(F.col("n_shingles"), F.col("bands"), F.col("sketch"))  # alike in all rows of a class
    classes = sketched.groupBy("k1", "k2").agg(F.min(rep).alias("rep"), F.first(facts).alias("facts"))
    # the classes' numbers hold from the checkpoint on
    stands = classes.select(F.monotonically_increasing_id().alias("class"), "k1", "k2", "rep", "facts.*").checkpoint()

    # ties go to the least doc_id, which is the same one in most bands of a group, so that they stay few
    keys = stands.select(F.struct("rep.none", "rep.id", "class").alias("by"), F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy(F.bitwise_not("key").alias("flipped"), "band").agg(F.min("by").alias("first"), F.count("*").alias("n")).filter("n > 1")
    ties = keys.join(shared.select(F.bitwise_not("flipped").alias("key"), "band", "first"), ["key", "band"])
    groups = components(fewer(ties.select(F.col("by.class").alias("a"), F.col("first").alias("b")))).withColumnRenamed("node", "class")
    members_of = stands.select("class", "k1", "k2", "rep", "n_shingles", "sketch").join(groups, "class").checkpoint()
    n_blocks = F.greatest(F.ceil(F.sum("n_shingles") / F.lit(block)), F.ceil(F.count("*") / F.lit(members))).cast("int").alias("n_blocks")
    blocks = members_of.groupBy("label").agg(n_blocks, F.min(F.struct("rep", "class"))["class"].alias("least")).filter("n_blocks > 1").checkpoint()
    own = F.when(F.col("n_blocks").isNull(), F.array(F.lit(0))).when(F.col("class") == F.col("least"), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int")))
    cut = members_of.join(blocks, "label", "left").select("class", "k1", "k2", F.col("rep.id").alias("rep_id"), F.col("rep.tkey").alias("rep_tkey"), F.col("label").alias("grp"), own.alias("blocks"), "sketch")
    met = texts.join(cut, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("tkey") == F.col("rep_tkey"))).select("text", "class", "k1", "k2", "grp", "blocks", "sketch")
    loaded = met.mapInArrow(_load(words), "class long, grp long, blocks array<int>, sketch binary, grams binary").checkpoint()

    # a block costs its square at worst, so the tasks aren't joined by the bytes that they read
    tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verified(pairs: DataFrame) -> DataFrame:
        dealt = pairs.select("class", "joined", "grp", "block", "low", "high", (F.size("blocks") > 1).alias("spans"), "sketch", "grams").repartition(tasks, "grp", "low", "high").sortWithinPartitions("grp", "low", "high")
        return dealt.mapInArrow(_verify(verifier), "class long, root long").checkpoint()

    inside = loaded.withColumn("block", F.explode("blocks")).withColumn("low", F.col("block")).withColumn("high", F.col("block")).withColumn("joined", F.col("class"))
    edges = verified(inside).select(F.col("class").alias("a"), F.col("root").alias("b"))
    # a class but a group's least is in one block and has one root there; components that meet in the least class have it as their root
    final = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    if not blocks.isEmpty():
        many = loaded.join(blocks.select(F.col("label").alias("grp"), "n_blocks"), "grp").join(final.select(F.col("node").alias("class"), F.col("label").alias("joined")), "class", "left")
        many = many.withColumn("joined", F.coalesce("joined", "class")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int"))
        open_ = many.groupBy("grp").agg((F.min("joined") < F.max("joined")).alias("open")).filter("open").select("grp").checkpoint()
        if not open_.isEmpty():
            across = many.join(open_, "grp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
            across = across.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).filter("low < high")
            more = verified(across)
            if not more.isEmpty():
                final = components(edges.union(more.select("class", "root")))
    final = final.withColumnRenamed("node", "class")
    labelled = stands.select("class", "k1", "k2", "rep").join(final, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = labelled.groupBy(F.bitwise_not("label").alias("flipped")).agg(F.min("rep").alias("rep")).select(F.bitwise_not("flipped").alias("label"), F.col("rep.id").alias("component_id"))
    named = labelled.select("k1", "k2", "label").join(least, "label").select(F.bitwise_not("k1").alias("flipped"), "k2", "component_id")
    found = sketched.select("doc_id", "k1", "k2", "n_shingles").join(named.select(F.bitwise_not("flipped").alias("k1"), "k2", "component_id"), ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = texts.filter("not some").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
