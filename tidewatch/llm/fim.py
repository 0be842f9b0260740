"""Fill-in-the-middle transformation: texts cut into prefix, middle and suffix at line ends, and put in another order.

A text is cut into lines, each with its newline; two hashes of (seed, doc_id) choose how many
lines come before the first and the second cut.  Two more choose whether the text stays plain
and which of two orders it takes:

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle

A batch's texts are handled together, on their UTF-8 bytes: a lookup classes the bytes, a mask
of neighbours marks the last byte of each line, cumulative sums less those at the texts' starts
number the lines, and one binary search finds the cuts of all rows.  Prefix, middle and suffix
lie side by side in the batch's bytes, so that they are slices of it.

Defined cases: a null text counts as empty; an empty text, and one that holds a mark itself,
stays plain, with null lengths; a null doc_id hashes as an empty one; rows that repeat a doc_id
and text have equal results; an empty table gives no rows; the input's columns pass through as
``row`` whatever their names.  Memory is about twelve bytes a byte of 1 MB of texts, or of one longer text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_row, with_row
from .words import pieces

MARKS = ("<P>", "<S>", "<M>")
_NEWLINE, _LATER = 1, 2
#: Classes of bytes: the newline, and the bytes of a character after its first.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x0A] = _NEWLINE
_CLASS[0x80:0xC0] = _LATER


def _checked(marks: Sequence[str]) -> Sequence[str]:
    """Marks can be told from text that lies beside them only if their first characters occur nowhere else in them."""
    if len(set(marks)) != 3 or not all(marks) or any(m[0] in other[1:] for m in marks for other in marks):
        raise ValueError("three marks whose first characters are not in the rest of any are needed")
    return marks


def _holds(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> np.ndarray:
    """Which texts contain a mark."""
    at = np.flatnonzero(data[: max(len(data) - len(mark) + 1, 0)] == mark[0])
    for i, byte in enumerate(mark[1:], 1):
        at = at[data[at + i] == byte]
    text = np.searchsorted(offsets, at, side="right") - 1
    out = np.zeros(len(offsets) - 1, dtype=bool)
    out[text[at + len(mark) <= offsets[text + 1]]] = True
    return out


def _sums(flags: np.ndarray) -> np.ndarray:
    """Cumulative sums, with a zero before the first byte."""
    out = np.zeros(len(flags) + 1, dtype=np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def cuts(texts: pa.Array, h: Sequence[np.ndarray], rate: int, spm: int, marks: Sequence[str]) -> pa.RecordBatch:
    """n, form, prefix_chars, middle_chars and output of each of some texts without nulls."""
    texts = texts.cast(pa.large_string())
    many = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + many + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    first, end = offsets[:-1], offsets[1:]
    kind = _CLASS[data]

    last = kind == _NEWLINE  # the last byte of a line: a newline, or a byte that another text or nothing follows
    last[end[end > first] - 1] = True
    lines = _sums(last)
    n = (lines[end] - lines[first]).astype(np.int64)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    # the byte after so many lines of the text: the first place at which so many line ends are counted
    a, b = (np.where(c > 0, np.searchsorted(lines, (lines[first] + c).astype(np.int32)), first) for c in (low, high))
    del lines, last

    plain = (end == first) | (h[2] % 100 >= rate)
    for mark in marks:
        plain |= _holds(data, offsets, mark.encode())
    a[plain] = b[plain] = end[plain]
    swap = ~plain & (h[3] % 100 < spm)
    chars = _sums(kind != _LATER)
    prefix_chars, middle_chars = chars[a] - chars[first], chars[b] - chars[a]

    edges = np.append(np.stack([first, a, b], axis=1).ravel(), len(data))
    part = pa.Array.from_buffers(pa.large_string(), 3 * many, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    at = 3 * np.arange(many)
    sign = pa.array([*marks, ""], pa.large_string())

    def signs(psm: int, spm: int) -> pa.Array:
        return sign.take(pa.array(np.where(plain, 3, np.where(swap, spm, psm))))

    # of a plain text the prefix is all, and the marks are empty
    output = pc.binary_join_element_wise(
        signs(0, 1), part.take(pa.array(at + 2 * swap)), signs(1, 0), part.take(pa.array(at + 2 * ~swap)), signs(2, 2), part.take(pa.array(at + 1)), pa.scalar("", pa.large_string())
    )
    form = pa.array(["psm", "spm", "plain"]).take(pa.array(np.where(plain, 2, swap.astype(np.int64))))
    lengths = [pa.array(x.astype(np.int64), mask=plain) for x in (prefix_chars, middle_chars)]
    return pa.RecordBatch.from_arrays([pa.array(n), form, *lengths, output.cast(pa.string())], names=["n", "form", "prefix_chars", "middle_chars", "output"])


def _transform(rate: int, spm: int, marks: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            texts = rows.field("text").cast(pa.string())
            if texts.null_count:
                texts = texts.fill_null("")
            h = [np.asarray(batch.column(f"h{i}")) for i in range(1, 5)]
            for i, j in pieces(texts, 1 << 20):
                found = cuts(texts.slice(i, j - i), [x[i:j] for x in h], rate, spm, marks)
                yield pa.RecordBatch.from_arrays([rows.slice(i, j - i), *found.columns], names=["row", *found.schema.names])

    return run


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: Sequence[str] = MARKS) -> DataFrame:
    """row, n (lines), form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    ``rate`` of 100 texts are transformed, and ``spm`` of 100 of these take the order of that name.
    """
    marks = _checked(tuple(marks))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(as_row(docs.columns), digest.alias("digest"))
    numbers = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = rows.select("row", *numbers)
    return rows.mapInArrow(_transform(rate, spm, marks), with_row(rows, "n long, form string, prefix_chars long, middle_chars long, output string"))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "|".join(re.escape(m) for m in _checked(tuple(marks))), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
