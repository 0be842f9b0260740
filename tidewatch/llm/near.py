"""N-gram Jaccard join: near-duplicate documents by MinHash banding and exact verification.

A document's set has its n-grams of ``words`` consecutive words (all of its words, if it
has fewer).  Two documents are linked if the Jaccard similarity of their sets is at
least ``similarity``.

1. Documents with the same words in the same order form one class, whatever their doc_ids; 128 bits of a cryptographic hash tell them.
2. Each class gets MinHash signatures in bands; band and row counts come from the
   target recall at the threshold.  Classes that share a band are candidates.  A band's
   members are tied to its least member only, never all to all, and the ties' connected
   components are the candidate groups.
3. Every pair inside a group is verified on the full sets, which covers every pair that
   shares a band.  A group is cut into blocks of bounded total size and a task compares
   two blocks by a matrix product; it returns sums of links and a spanning forest, not pairs.
4. The verified forests' components are the result's classes.

Defined cases: null, empty and blank texts have an empty set and link to nothing; equal
texts (up to white space) link even if shorter than an n-gram; rows that repeat a doc_id and
its words are one document, each with its result, and rows of one doc_id with other words
are documents of their own; rows without a doc_id are documents each, come after all others
where the least doc_id names a class, and a class of only such rows has the class_id null;
``representatives`` keeps one row of each class; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, fewer
from .columns import as_row, with_id
from .words import Words, give_back, mix, pieces, rolled, windows

#: n-grams that a block of a candidate group may hold in sum (a single longer document makes a block of its own), and documents.
BLOCK, MEMBERS = 400_000, 1536
#: Rows of a block that are compared at a time.
ROWS = 256


def choose_bands(similarity: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): as many rows a band as the hashes allow while pairs at the threshold are found with the recall."""
    best = None
    for rows in range(1, most_hashes + 1):
        hit = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def grams_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of all texts and the text of each; a shorter text has one gram of all its words."""
    start, text = windows(words.first, words.counts, n)
    grams = [rolled(words.hashes, n)[start]]
    few = [np.flatnonzero(words.counts == c) for c in range(1, n)]
    for c, texts in enumerate(few, 1):
        # the number of words tells runs of other lengths apart
        grams.append(rolled(words.hashes, c)[words.first[texts]] + np.uint64(c % 8 << 61) if len(texts) else np.zeros(0, np.uint64))
    grams, text = np.concatenate(grams), np.concatenate([text, *few])
    if any(map(len, few)):
        order = np.argsort(text, kind="stable")
        grams, text = grams[order], text[order]
    return mix(grams), text


def _class_keys(words: Words, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each text's words in order, of their bytes."""
    k1, k2 = words.texts_hashes(texts).view(np.int64)
    return k1, k2


def _sketch(n: int, bands: int, rows: int):
    numbers = np.random.default_rng(7).integers(0, 1 << 63, size=(2, bands * rows), dtype=np.uint64)
    masks, odds = numbers[0] * np.uint64(2) + np.uint64(1), numbers[1] | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest = batch.column("text"), batch.select(["doc_id", "tkey"])
            for a, b in pieces(texts, 1 << 19):
                words = Words(texts.slice(a, b - a))
                grams, text = grams_of(words, n)
                many = np.bincount(text, minlength=b - a)
                have = np.flatnonzero(many)
                first = (np.cumsum(many) - many)[have]
                least = np.empty((len(have), bands * rows), dtype=np.uint64)
                if len(have):
                    for k in range(bands * rows):
                        least[:, k] = np.minimum.reduceat((grams ^ masks[k]) * odds[k], first)
                band = least[:, ::rows].copy()
                for k in range(1, rows):
                    band = mix(band) + least[:, k::rows]
                band = mix(band + np.arange(bands, dtype=np.uint64)).view(np.int64)
                k1, k2 = _class_keys(words, have)
                yield pa.RecordBatch.from_arrays(
                    [
                        *rest.slice(a, b - a).take(pa.array(have)).columns,
                        pa.array(k1),
                        pa.array(k2),
                        pa.array(many[have]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(band.ravel())),
                    ],
                    names=["doc_id", "tkey", "k1", "k2", "grams", "bands"],
                )

    return run


def _sets(n: int):
    """Sorted distinct n-grams of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in pieces(texts, 1 << 19):
                words = Words(texts.slice(a, b - a))
                grams, text = grams_of(words, n)
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                sets = [np.unique(grams[i:j]).tobytes() for i, j in zip(cuts, cuts[1:])]
                k1, k2 = _class_keys(words, np.arange(b - a))
                own = (k1 == np.asarray(batch.column("k1").slice(a, b - a))) & (k2 == np.asarray(batch.column("k2").slice(a, b - a)))
                rest = [batch.column(c).slice(a, b - a) for c in ("class", "size", "grp", "block", "other")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], names=["class", "size", "grp", "block", "other", "grams"]).filter(pa.array(own))

    return run


def _overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of sets[:left] with sets[left:] (all with all, if left is all)."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(column, minlength=len(values)) > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    right = left if left < len(sets) else 0
    out = np.zeros((left, len(sets) - right), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(256, (16 << 20) // (4 * len(sets)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [low, low + step])
        part = np.zeros((len(sets), step), dtype=np.float32)
        part[row[i:j], column[i:j] - low] = 1
        out += part[:left] @ part[right:].T
    return out


def _verify_block(rows: list[tuple], parts: int, whole: int, apart: bool):
    """Links of one pair of blocks: weights by class and a spanning forest of the linked classes."""
    rows = sorted({r[:3]: r for r in rows}.values(), key=lambda r: (r[2], r[0]))  # a repeated row counts once
    name, size, block = (np.array([r[i] for r in rows]) for i in range(3))
    sets = [r[3] for r in rows]
    left = int((block == block[0]).sum())
    same = left == len(sets)
    if same and apart:
        return None  # the other block has no member
    counts = np.array([len(s) for s in sets])
    overlaps = _overlaps(sets, left)
    other = counts if same else counts[left:]
    links, pairs = np.zeros(len(sets), dtype=np.int64), []
    for low in range(0, left, ROWS):
        common = overlaps[low : low + ROWS].astype(np.int64)
        linked = common * whole >= (counts[low : low + len(common), None] + other[None, :] - common) * parts
        if same:
            linked[np.arange(len(common)), np.arange(low, low + len(common))] = False
            links[low : low + len(common)] = linked @ size
        else:
            links[low : low + len(common)] = linked @ size[left:]
            links[left:] += linked.T @ size[low : low + len(common)]
        a, b = np.nonzero(linked)
        pairs.append((a + low, b if same else b + left))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    label = np.arange(len(sets))
    while True:  # least labels, over the pairs of this block only
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return name, links, name[label]


def _verify(similarity: float):
    ratio = Fraction(str(similarity))
    parts, whole = ratio.numerator, ratio.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None

        def done():
            found = _verify_block(rows, parts, whole, last[1] != last[2]) if len(rows) > 1 else None
            if found:
                name, links, root = found
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(links.astype(np.int64)), pa.array(root)], names=["class", "links", "root"])

        for batch in batches:
            give_back()
            for x in batch.to_pylist():
                key = x["grp"], x["low"], x["high"]
                if key != last:
                    yield from done()
                    rows, last = [], key
                rows.append((x["class"], x["size"], x["block"], np.frombuffer(x["grams"], dtype=np.uint64)))
        yield from done()

    return run


def _keys() -> tuple[Column, Column]:
    """Whether a row has words, and a hash of its text (0: without words) that tells rows of one doc_id, or of none, apart."""
    text = F.col("text").cast("string")
    some = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return some, F.when(some, F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def _texts(docs: DataFrame) -> DataFrame:
    some, tkey = _keys()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), tkey.alias("tkey"), some.alias("some"))


def _classes(
    texts: DataFrame, similarity: float = 0.8, words: int = 5, recall: float = 0.9999, most_hashes: int = 288, block: int = BLOCK, members: int = MEMBERS
) -> tuple[DataFrame, DataFrame]:
    """The rows with words with the keys of their words, and of each key: size (documents), rep (the row that stands for it), links and label (its class)."""
    bands, rows = choose_bands(similarity, recall, most_hashes)
    sketched = texts.filter("some").select("doc_id", "text", "tkey").mapInArrow(_sketch(words, bands, rows), with_id(texts, "tkey long, k1 long, k2 long, grams long, bands array<long>")).checkpoint()

    one = sketched.groupBy("doc_id", "k1", "k2").agg(F.min(F.struct("tkey", "grams", "bands")).alias("s"), F.count("*").alias("rows"))
    documents = F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)
    rep = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("s.tkey").alias("tkey"))
    classes = one.groupBy("k1", "k2").agg(F.min(F.struct(rep.alias("rep"), F.col("s.grams").alias("grams"), F.col("s.bands").alias("bands"))).alias("s"), F.sum(documents).alias("size"))
    # the classes' numbers hold from the checkpoint on
    stands = classes.select(F.monotonically_increasing_id().alias("class"), "k1", "k2", "size", "s.rep", "s.grams", "s.bands").checkpoint()

    # ties go to the least doc_id, which is the same one in most bands of a group, so that they stay few
    keys = stands.select(F.struct("rep.none", "rep.id", "class").alias("by"), F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy(F.bitwise_not("key").alias("flipped"), "band").agg(F.min("by").alias("first"), F.count("*").alias("n")).filter("n > 1")
    ties = keys.join(shared.select(F.bitwise_not("flipped").alias("key"), "band", "first"), ["key", "band"])
    groups = components(fewer(ties.select(F.col("by.class").alias("a"), F.col("first").alias("b")))).withColumnRenamed("node", "class")
    sizes = stands.select("class", "k1", "k2", "size", "rep", "grams").join(groups, "class").checkpoint()
    blocks = sizes.groupBy("label").agg(F.greatest(F.ceil(F.sum("grams") / F.lit(block)), F.ceil(F.count("*") / F.lit(members))).cast("int").alias("n_blocks"))
    blocks = blocks.filter("n_blocks > 1").checkpoint()
    cut = sizes.join(blocks, "label", "left").select(
        F.col("class"), "k1", "k2", "size", F.col("rep.id").alias("rep_id"), F.col("rep.tkey").alias("rep_tkey"), F.col("label").alias("grp"), F.coalesce("n_blocks", F.lit(1)).alias("n_blocks")
    ).withColumn("block", F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int"))

    loaded = texts.join(cut, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("tkey") == F.col("rep_tkey"))).select("text", "class", "k1", "k2", "size", "grp", "block", F.sequence(F.lit(0), F.col("n_blocks") - 1).alias("other"))
    sets = loaded.mapInArrow(_sets(words), "class long, size long, grp long, block int, other array<int>, grams binary")
    paired = sets.withColumn("other", F.explode("other")).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    # a block costs its square, so the tasks aren't joined by the bytes that they read
    tasks = 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    verified = (
        paired.select("class", "size", "grp", "block", "low", "high", "grams")
        .repartition(tasks, "grp", "low", "high")
        .sortWithinPartitions("grp", "low", "high")
        .mapInArrow(_verify(similarity), "class long, links long, root long")
        .checkpoint()
    )
    links = verified.groupBy("class").agg(F.sum("links").alias("links"))
    final = components(verified.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    facts = links.join(final, "class", "left")
    return sketched, stands.select("class", "k1", "k2", "size", "rep").join(facts, "class", "left").select("k1", "k2", "size", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "class").alias("label")).checkpoint()


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class, over chains of links) and n_links (documents linked to it, copies included) of every row."""
    texts = _texts(docs)
    sketched, classes = _classes(texts, **options)
    least = classes.groupBy("label").agg(F.min("rep.id").alias("class_id"))
    found = classes.join(least, "label").select("k1", "k2", "class_id", (F.col("links") + F.col("size") - 1).cast("long").alias("n_links"))
    alone = texts.filter("not some").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return sketched.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "class_id", "n_links").union(alone)


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of each class stays, one of the least doc_id; all rows without words stay."""
    keys = ("__near_id", "__near_tkey")
    _, classes = _classes(_texts(docs), **options)
    kept = classes.groupBy("label").agg(F.min("rep").alias("rep")).select(F.col("rep.id").alias("kept_id"), F.col("rep.tkey").alias("kept_tkey"))
    some, tkey = _keys()
    rows = docs.withColumn(keys[0], F.col("doc_id")).withColumn(keys[1], tkey)
    met = rows.filter(some).join(kept, F.col(keys[0]).eqNullSafe(F.col("kept_id")) & (F.col(keys[1]) == F.col("kept_tkey")), "left_semi")
    # a row that repeats very often is taken down to one in the tasks first
    single = met.groupBy(*keys).agg(F.first(as_row(docs.columns)).alias("row"))
    return single.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).union(docs.filter(~some))
