"""LM scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary and one way of smoothing
(Dirichlet priors: a bigram falls back on its word, a word on the uniform distribution over
the vocabulary), so that only the corpora differ.  A document's score is its mean background
loss less its mean target loss, in nats a token: high for texts like the target's.  Each
document is scored by models of all the other rows: its own counts are taken out of the
background, and out of the target where it belongs to that, so none is favoured by memory.

Every word and every bigram of all documents is counted.  The documents are dealt out to
splits of bounded size by their ids, and so are the targets' ids:

1. a split sends its distinct words and bigrams (64-bit hashes) with their counts, sorted
   and packed, to the buckets of the hashes;
2. a bucket adds up what it gets and answers each split with the counts of all the others,
   in the split's own order, so that answers need no keys;
3. a split meets its answers and scores its documents.

Nothing of the models is collected or broadcast but three totals.  A document id that holds
over 1 / HEAVY of all text is spread over several splits; there are at most HEAVY of them.

Defined cases: null and empty texts have no tokens, null losses and the score 0; without
any other target document the target model is uniform over the vocabulary; repeated ids count
once in ``targets`` and mark every row of ``docs`` that has them; documents are scored row by
row, also where ids repeat or are null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import with_id
from .words import Words, mix, pieces

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
#: Weight of the prior that a bigram's probability falls back on.
PRIOR = 50.0
#: Bytes of text of a split, and keys of a bucket, on average.
SPLIT, BUCKET = 4 << 20, 2 << 20
#: Ids that hold over 1 / HEAVY of all text are spread over splits.
HEAVY = 1 << 16


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed plane by plane of their bytes: high bytes are mostly zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * count, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, count).T).view("<u8").ravel()


class Split:
    """The documents of a split: keys of their words and bigrams, and which of them are targets."""

    def __init__(self, table: pa.Table):
        marks = table.column("mark")
        self.docs = table.filter(pc.invert(marks))
        ids = self.docs.column("doc_id")
        self.target = np.asarray(pc.is_in(ids, value_set=table.filter(marks).column("doc_id").combine_chunks()).combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
        texts = self.docs.column("text").combine_chunks()
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in pieces(texts, 1 << 20):
            words = Words(texts.slice(a, b - a))
            hashes.append(words.hashes)
            counts.append(words.counts)
        right, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first = np.ones(len(right), dtype=bool)  # a document's first word has no bigram
        self.first[1:] = self.doc[1:] != self.doc[:-1]
        self.second = np.flatnonzero(~self.first)
        # the lowest bit tells bigrams from words
        grams = mix(right[self.second - 1] * _STEP + right[self.second]) | _ONE
        self.keys, self.place = np.unique(np.concatenate([right & ~_ONE, grams]), return_inverse=True)

    def __len__(self) -> int:
        return len(self.doc)

    def owners(self) -> np.ndarray:
        """The document of each word, and then of each bigram."""
        return np.concatenate([self.doc, self.doc[self.second]])

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each key in the split and in its targets."""
        marks = self.target[self.owners()]
        return np.bincount(self.place, minlength=len(self.keys)), np.bincount(self.place[marks], minlength=len(self.keys))


def _send(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        split = Split(table)
        n, n_target = split.own()
        bucket = ((split.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with the keys
        numbers, at = np.unique(bucket, return_index=True)
        cuts = np.append(at, len(bucket)).tolist()
        rows = [(b - a, _pack(np.diff(split.keys[a:b], prepend=np.uint64(0))), _pack(n[a:b]), _pack(n_target[a:b])) for a, b in zip(cuts, cuts[1:])]
        number = table.column("split")[0].as_py()
        counts, keys, own, own_target = zip(*rows) if rows else ((), (), (), ())
        return pa.table(
            [pa.array(numbers, pa.int32()), pa.array([number] * len(rows), pa.int32()), pa.array(counts, pa.int32()), pa.array(keys, pa.binary()), pa.array(own, pa.binary()), pa.array(own_target, pa.binary())],
            names=["bucket", "split", "many", "keys", "n", "n_target"],
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each split that sent keys to a bucket: the counts of all the others, and (once a bucket) its share of the totals."""
    rows = table.to_pylist()
    keys = np.concatenate([np.cumsum(_unpack(r["keys"], r["many"]), dtype=np.uint64) for r in rows])
    one, place = np.unique(keys, return_inverse=True)
    cuts = np.cumsum([0] + [r["many"] for r in rows]).tolist()
    is_word = (one & _ONE) == 0
    others, totals = [], [int(is_word.sum())]
    for c in ("n", "n_target"):
        own = np.concatenate([_unpack(r[c], r["many"]) for r in rows]).astype(np.int64)
        total = np.bincount(place, own, len(one)).astype(np.int64)
        totals.append(int(total[is_word].sum()))
        rest = total[place] - own
        others.append([_pack(rest[a:b]) for a, b in zip(cuts, cuts[1:])])
    share = [[x] + [0] * (len(rows) - 1) for x in totals]
    return pa.table(
        [
            *(pa.array([r[c] for r in rows], pa.int32()) for c in ("split", "bucket", "many")), *(pa.array(x, pa.binary()) for x in others),
            *(pa.array(x, pa.int64()) for x in share),
        ],
        names=["split", "bucket", "many", "others", "others_target", "types", "tokens", "tokens_target"],
    )


def _score(types: int, tokens: tuple[int, int]):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        split = Split(table)
        answered = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        docs, keys, words = len(split.counts), len(split.keys), len(split)
        # a document's own counts, for each of its words and bigrams
        pair, where = np.unique(split.owners() * max(keys, 1) + split.place, return_inverse=True)
        mine = np.bincount(where, minlength=len(pair))[where]
        word, gram, left = split.place[:words], split.place[words:], split.second - 1
        none = split.counts == 0
        means = []
        for total, own, column, marks in zip(tokens, split.own(), ("others", "others_target"), (np.ones(docs, dtype=bool), split.target)):
            n = own + np.concatenate([np.zeros(0, np.int64)] + [_unpack(r[column], r["many"]).astype(np.int64) for r in answered])
            taken = mine * marks[split.owners()]
            size = (total - marks * split.counts + types)[split.doc]
            p = (n[word] - taken[:words] + 1) / size
            p[split.second] = (n[gram] - taken[words:] + PRIOR * p[split.second]) / (n[word[left]] - taken[left] + PRIOR)
            means.append(np.bincount(split.doc, -np.log(p), docs) / np.maximum(split.counts, 1))
        background, target = means
        return pa.table(
            [split.docs.column("doc_id"), pa.array(split.counts, pa.int64()), pa.array(target, mask=none), pa.array(background, mask=none), pa.array(np.where(none, 0.0, background - target))],
            names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    return run


def score(docs: DataFrame, targets: DataFrame, split_bytes: int = SPLIT, bucket_keys: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row of ``docs``; ``targets`` has the doc_ids of the target corpus."""
    kind = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    weights = texts.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("bytes"))
    total = weights.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    splits = max(1, math.ceil(total / split_bytes))
    buckets = max(1, math.ceil(total / 6 / bucket_keys))  # a word and a bigram take some twelve bytes of text
    # at most HEAVY rows, whatever the input
    heavy = weights.filter(F.col("bytes") > F.lit(max(total / HEAVY, split_bytes / 4))).select(F.col("doc_id").alias("heavy_id"), F.ceil(F.col("bytes") * 4 / F.lit(split_bytes)).alias("spread"))
    heavy = F.broadcast(heavy)

    # rows alike in id and text are spread by the part of the input that they come in, which a rerun task shares
    salt = F.pmod(F.xxhash64("text", F.spark_partition_id()), F.coalesce("spread", F.lit(1)))
    split = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(splits)).cast("int").alias("split")
    rows = texts.join(heavy, F.col("doc_id").eqNullSafe(F.col("heavy_id")), "left").withColumn("salt", salt).select(split, "doc_id", "text", F.lit(False).alias("mark"))
    marked = targets.select(F.col("doc_id").cast(kind).alias("doc_id")).filter("doc_id is not null").distinct().join(heavy, F.col("doc_id") == F.col("heavy_id"), "left")
    marked = marked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("spread", F.lit(1)) - 1))).select(split, "doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark"))
    placed = rows.union(marked).repartition("split").groupBy("split")

    sent = placed.applyInArrow(_send(buckets), "bucket int, split int, many int, keys binary, n binary, n_target binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "split int, bucket int, many int, others binary, others_target binary, types long, tokens long, tokens_target long").checkpoint()
    sums = answers.agg(F.sum("types"), F.sum("tokens"), F.sum("tokens_target")).first()
    types, tokens, tokens_target = (x or 0 for x in sums)
    own = answers.select("split", "bucket", "many", "others", "others_target").groupBy("split")
    return placed.cogroup(own).applyInArrow(_score(types, (tokens, tokens_target)), with_id(docs, "n_tokens long, target_loss double, background_loss double, score double"))
