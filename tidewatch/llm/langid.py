"""Language identification with interpolated Kneser-Ney character models.

Texts are runs of letters in lower case, each with a start and an end; a language's
model gives each character's probability after the ORDER - 1 before it.  The n-grams of
all languages are kept together in one sorted array of hashes a length, with a row of log
probabilities (a language a column) each, and so are the contexts' back-off weights: one
search finds an n-gram for all languages.  The language with the least cross-entropy a
character wins; a text whose cross-entropy is beyond what the language's own held-back
texts show is rejected.

Models are fitted to a bounded sample: at most SAMPLE labelled texts of a language, of at
most SAMPLE_CHARS characters each, those with the smallest hashes of id and text (rows alike
in both count once); a fifth of them is held back to calibrate.  All texts are scored whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; unknown characters get the models' floor; equal cross-entropies go to the first
language in code point order; without any labelled text every row is ``und``; an empty
table gives no rows; rows are scored one by one, also where ids repeat; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import as_row, with_row
from .words import Words, mix, pieces

ORDER = 5
#: Labelled texts of a language that the models are fitted to, and the part that calibrates.
SAMPLE, HELD_BACK = 300, 5
#: Characters up to which a text may be in the sample.
SAMPLE_CHARS = 1 << 17
#: Parts in which a language's texts are ranked first.
PARTS = 64
#: Spreads of the held-back texts by which a text may exceed its language's usual cross-entropy, and the
#: number of held-back texts from which a language's own spread is used, where it is beyond that of all languages.
DEVIATIONS, ENOUGH = 6.0, 20
START, END = "\x02", "\x03"
#: Characters that the floor of the models counts with.
ALPHABET = 1000
_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of the highest order, by language and fold."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, text, fold in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "fold"))):
            if fold:
                for word, n in Counter(_letters.findall((text or "").lower())).items():
                    padded = START * (ORDER - 1) + word + END
                    for i in range(len(word) + 1):
                        counts[lang, padded[i : i + ORDER]] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"]
        )


def _levels(grams: pd.Series) -> list[pd.DataFrame]:
    """Of one language, by order from 1: gram -> log probability, and (as gram + "\\0") context -> log back-off weight."""
    counts = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = counts[n + 1].groupby(counts[n + 1].index.str[1:]).size()
    out, lower = [], None
    for n in range(1, ORDER + 1):
        c = counts[n].astype(float)
        ones, twos = float((c == 1).sum()), float((c == 2).sum())
        discount = ones / (ones + 2 * twos) if ones else 0.5
        discount = min(max(discount, 0.05), 0.95)
        context = c.index.str[: n - 1]
        by = c.groupby(context)
        total, types = by.sum(), by.size()
        weight = discount * types / total
        below = lower.reindex(c.index.str[1:]).to_numpy() if n > 1 else 1.0 / ALPHABET
        p = pd.Series((c.to_numpy() - discount) / total.reindex(context).to_numpy() + weight.reindex(context).to_numpy() * below, index=c.index)
        out.append((np.log(p), np.log(weight)))
        lower = p
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return codes, np.array([len(t) for t in texts])


def _extend(before: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of a gram from that of all but its last character."""
    return mix(before * _STEP + codes + np.uint64(1))


def _hash(grams: list[str]) -> np.ndarray:
    """Hashes of grams of one length."""
    if not grams or not grams[0]:
        return np.zeros(len(grams), dtype=np.uint64)
    codes, _ = _codes(grams)
    codes = codes.reshape(len(grams), -1)
    h = np.zeros(len(grams), dtype=np.uint64)
    for column in codes.T:
        h = _extend(h, column)
    return h


class Models:
    """The languages' models in sorted arrays of hashes, by order."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.limits = np.full(len(self.langs), np.inf)
        self.floor = -np.log(ALPHABET)
        if not self.langs:
            return
        levels = {lang: _levels(part.set_index("gram")["n"]) for lang, part in counts.groupby("lang")}
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # a pair of hashes and rows for each order
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        lower: pd.DataFrame | None = None
        for n in range(ORDER):
            weights = pd.DataFrame({lang: levels[lang][n][1] for lang in self.langs}).fillna(0.0)
            p = pd.DataFrame({lang: levels[lang][n][0] for lang in self.langs})
            context = weights.reindex(p.index.str[:n]).to_numpy()
            below = lower.reindex(p.index.str[1:]).to_numpy() if lower is not None else np.full(p.shape, self.floor)
            lower = p.where(p.notna(), np.nan_to_num(context) + below)
            self.grams.append(self._sorted(lower))
            self.contexts.append(self._sorted(weights))

    @staticmethod
    def _sorted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        hashes = _hash(list(rows.index))
        order = np.argsort(hashes)
        return hashes[order], rows.to_numpy(np.float32)[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
        return table[0][at] == hashes, at

    def losses(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the losses (a language a column) and characters, the end among them, of each run of letters."""
        lead = START * (ORDER - 1)
        codes, lengths = _codes([lead + w + END for w in words])
        if not len(codes):
            return np.zeros((0, len(self.langs)), dtype=np.float32), lengths
        hashes = [np.zeros(len(codes), dtype=np.uint64)]
        for _ in range(ORDER):
            before = np.concatenate([[np.uint64(0)], hashes[-1][:-1]])
            hashes.append(_extend(before, codes))
        first = np.cumsum(lengths) - lengths
        scored = np.ones(len(codes), dtype=bool)
        scored[(first[:, None] + np.arange(ORDER - 1)).ravel()] = False
        at = np.flatnonzero(scored)
        total = np.zeros((len(at), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            hit, row = self._find(self.grams[n - 1], hashes[n][at[todo]])
            total[todo[hit]] += self.grams[n - 1][1][row[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            seen, row = self._find(self.contexts[n - 1], hashes[n - 1][at[todo] - 1] if n > 1 else hashes[0][at[todo]])
            total[todo[seen]] += self.contexts[n - 1][1][row[seen]]
        total[todo] += self.floor
        many = lengths - (ORDER - 1)
        return -np.add.reduceat(total, np.cumsum(many) - many), many

    def losses_in_parts(self, words: list[str], part: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """As ``losses``, so many words at a time, which bounds the memory."""
        parts = [self.losses(words[i : i + part]) for i in range(0, len(words), part)] or [self.losses([])]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the losses and characters of each text; a distinct word is scored once."""
        words = Words(texts)
        _, one, place = np.unique(words.hashes, return_index=True, return_inverse=True)
        data, starts, ends = words.data.tobytes(), words.starts[one].tolist(), words.ends[one].tolist()
        runs: list[str] = []
        many = []
        for a, b in zip(starts, ends):
            found = _letters.findall(data[a:b].decode("utf-8").lower())
            runs += found
            many.append(len(found))
        loss, chars = self.losses_in_parts(runs)
        runs_of = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        return tuple(_sums(_sums(x, runs_of)[place], words.first) for x in (loss, chars))


def _sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of x[cuts[i] : cuts[i + 1]] along the first axis."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _predict(models: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Models = models.value
        names = pa.array([*own.langs, "und"], pa.string())
        for batch in batches:
            texts = batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text").cast(pa.string())
            for a, b in pieces(texts, 2 << 20):
                loss, chars = own.texts(texts.slice(a, b - a)) if own.langs else (np.zeros((b - a, 1)), np.zeros(b - a))
                none = chars == 0
                mean = loss / np.maximum(chars, 1)[:, None]
                best = mean.argmin(axis=1)
                # the more characters, the surer: the likelihoods' ratio, damped, as characters depend on each other
                ratio = np.exp(-(mean - mean.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(chars, 1))[:, None])
                entropy = mean[np.arange(b - a), best]
                limit = own.limits[best] + 4 / np.sqrt(np.maximum(chars, 1)) if own.langs else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(a, b - a) for c, n in zip(batch.columns, batch.schema.names) if n != "text"),
                        names.take(pa.array(np.where(none, len(own.langs), best))), pa.array(np.where(none, 0.0, 1 / ratio.sum(axis=1))),
                        pa.array(entropy, mask=none), pa.array(none | (entropy > limit)),
                    ],
                    names=[*(n for n in batch.schema.names if n != "text"), "lang_pred", "score", "entropy", "rejected"],
                )

    return run


_RESULT = "lang_pred string, score double, entropy double, rejected boolean"


def fit(docs: DataFrame, learn: Column) -> Broadcast:
    """Models of the labelled rows for which ``learn`` holds, in a broadcast whose size the sample bounds."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    usable = docs.filter(learn & F.col("lang").isNotNull() & text.isNotNull() & (F.length(text) <= SAMPLE_CHARS)).select(
        F.col("lang").cast("string").alias("lang"), "doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("hash")
    )
    # first in parts of a language, so that no task ranks all of one
    rank = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy("hash", "doc_id"))
    chosen = usable.select("lang", "doc_id", "hash").distinct().withColumn("part", F.pmod("hash", F.lit(PARTS)))
    chosen = chosen.withColumn("r", rank("part")).filter(F.col("r") <= SAMPLE).withColumn("r", rank()).filter(F.col("r") <= SAMPLE)
    chosen = chosen.select(F.col("lang").alias("c_lang"), F.col("doc_id").alias("c_id"), F.col("hash").alias("c_hash"), (F.col("r") % HELD_BACK != 0).alias("fold"))
    own = (F.col("lang") == F.col("c_lang")) & F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("hash") == F.col("c_hash"))
    # at most SAMPLE rows a language are broadcast, and as many texts are kept
    sample = usable.join(F.broadcast(chosen), own).groupBy("lang", "c_id", "hash", "fold").agg(F.min("text").alias("text")).select("lang", "text", "fold").checkpoint()
    counts = sample.mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    models = Models(counts)
    if models.langs:
        draft = spark.sparkContext.broadcast(models)
        held = sample.filter("not fold").select("lang", "text").mapInArrow(_predict(draft), f"lang string, {_RESULT}").filter("lang = lang_pred and entropy is not null")
        models.limits = calibrated(models.langs, [(r["lang"], r["entropy"]) for r in held.select("lang", "entropy").collect()])
    return spark.sparkContext.broadcast(models)


def calibrated(langs: Sequence[str], held: Sequence[tuple[str, float]]) -> np.ndarray:
    """Limits of the cross-entropy from held-back (language, cross-entropy): the median and a number of spreads.

    A spread is an upper quantile in standard deviations, which a few odd texts don't move.  It is pooled over
    all languages; a language without a held-back text gets the median of the hardest other one.  Without any
    held-back text there is nothing to judge by and no limit.
    """
    if not held:
        return np.full(len(langs), np.inf)
    own = {lang: np.array([e for x, e in held if x == lang]) for lang in {x for x, _ in held}}
    usual = {lang: float(np.median(e)) for lang, e in own.items()}

    def spread(excess: np.ndarray) -> float:
        return float(np.quantile(excess, 0.95)) / 1.645

    pooled = spread(np.concatenate([e - usual[lang] for lang, e in own.items()]))
    limits = [
        usual.get(lang, max(usual.values())) + DEVIATIONS * max(pooled, spread(own[lang] - usual[lang]) if len(own.get(lang, ())) >= ENOUGH else 0.0)
        for lang in langs
    ]
    return np.array(limits)


def in_training(doc_id: Column) -> Column:
    """Rows that may be learnt from: crc32 of the id as text leaves no remainder of 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def identify(docs: DataFrame, learn: Column | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """The carried columns (all) of ``docs`` as a struct, row, with lang_pred, score, entropy (nats a character) and rejected."""
    models = fit(docs, in_training(F.col("doc_id")) if learn is None else learn)
    names = list(carry or docs.columns)
    text = [] if "text" in names else [F.col("text").cast("string").alias("text")]
    rows = docs.select(as_row(names), *text)
    return rows.mapInArrow(_predict(models), with_row(rows, _RESULT))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, unchanged."""
    return identify(docs).filter("not rejected").select("row.*")
