"""Token counts of a document's sections, by offset-mapped attribution.

A whole document is encoded once.  The tokens' character spans are joined with the
sections' spans, and each token counts for the section that holds its first character
(that of its first byte, where a character is split over tokens).  So the counts of a
document's sections, and of what lies outside of them, add up to its tokens, which
encoding the sections one by one would not give.

Sections are half-open spans of code points, by default the lines of the text, each with its
line feed.  They may come in any order; where two overlap, the one that begins first ends
where the next one begins.

Defined cases: a null or empty text has one section without tokens; a section without
characters, or whose span is null or turned around, has no tokens; tokens outside all sections go to a row with section -1, which
is there only if there are such tokens; rows that repeat a doc_id are counted row by row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, encoder_of, model_for
from .columns import with_id
from .words import pieces


def token_spans(vocabulary: Vocabulary, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token, and the character after its last one."""
    lead = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
    ends = np.cumsum(vocabulary.lengths[ids])
    starts = ends - vocabulary.lengths[ids]
    return lead[starts] - 1, lead[ends - 1]


def line_sections(text: str) -> np.ndarray:
    """(begin, end) of each line; the line feed belongs to its line."""
    if not text:
        return np.array([[0, 0]])
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    begins = np.concatenate([[0], np.flatnonzero(codes == 10) + 1])
    begins = begins[begins < len(codes)]
    return np.stack([begins, np.append(begins[1:], len(codes))], axis=1)


def attribute(first: np.ndarray, last: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of each section, those of them that end beyond it, and tokens outside all sections."""
    n, crossing = np.zeros(len(sections), np.int64), np.zeros(len(sections), np.int64)
    some = np.flatnonzero(sections[:, 1] > sections[:, 0]) if len(sections) else np.zeros(0, np.int64)
    if not len(some):
        return n, crossing, len(first)
    some = some[np.argsort(sections[some, 0], kind="stable")]
    begins, ends = sections[some, 0], sections[some, 1].copy()
    ends[:-1] = np.minimum(ends[:-1], begins[1:])  # a section ends where the next one begins
    at = np.searchsorted(begins, first, side="right") - 1
    inside = (at >= 0) & (first < ends[np.maximum(at, 0)])
    own = at[inside]
    n[some] = np.bincount(own, minlength=len(some))
    crossing[some] = np.bincount(own[last[inside] > ends[own]], minlength=len(some))
    return n, crossing, int((~inside).sum())


def _sections(spans: list | None) -> np.ndarray:
    """Spans as an array; what is no pair of numbers holds no characters."""
    pairs = [(x[0], x[1]) if x and len(x) > 1 and x[0] is not None and x[1] is not None else (0, 0) for x in spans or []]
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


def _count(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            texts, ids = batch.column("text").fill_null(""), batch.column("doc_id")
            spans = batch.column("sections").to_pylist() if "sections" in batch.schema.names else None
            for a, b in pieces(texts, 1 << 20):
                strings = texts.slice(a, b - a).to_pylist()
                tokens, cuts = encoder.encode(strings)
                out = []
                for i, text in enumerate(strings):
                    own = tokens[cuts[i] : cuts[i + 1]]
                    sections = line_sections(text) if spans is None else _sections(spans[a + i])
                    first, last = token_spans(encoder.vocabulary, own, text.encode())
                    n, crossing, outside = attribute(first, last, sections)
                    number = np.arange(len(sections))
                    if outside:
                        sections = np.concatenate([sections.reshape(-1, 2), [[0, 0]]])
                        n, crossing, number = np.append(n, outside), np.append(crossing, 0), np.append(number, -1)
                    out.append((np.full(len(n), a + i), number, sections[:, 0], sections[:, 1], n, crossing))
                row, *columns = (np.concatenate(x).astype(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *map(pa.array, columns)], names=["doc_id", "section", "begin", "end", "n_tokens", "n_crossing"])

    return run


def section_tokens(docs: DataFrame, path: str, sections: str | None = None, lexicon_words: int = 0) -> DataFrame:
    """doc_id, section, begin, end, n_tokens, n_crossing: a row for every section of every document.

    ``sections`` names a column of arrays of [begin, end]; without it, lines are counted.
    """
    columns = ["doc_id", F.col("text").cast("string").alias("text")] + ([F.col(sections).alias("sections")] if sections else [])
    return docs.select(*columns).mapInArrow(
        _count(model_for(docs, path, lexicon_words)), with_id(docs, "section long, begin long, end long, n_tokens long, n_crossing long")
    )
