"""Byte-level BPE encoding and decoding with a minimal acyclic transducer for frequent words.

Spark counts the words of the whole corpus that follow a blank; the most frequent ones, with
the ids that merging gives them, are compiled into a minimal acyclic automaton whose
transitions carry additive outputs: their sum along a word is the word's number,
which addresses its ids.  Tasks memory-map the compiled arrays from a file that each
executor writes once.  Words outside the lexicon are merged exactly, many at a time.
The lexicon only saves work: ids are the same with any lexicon, or none.

Defined cases: null and empty texts have no ids and decode to the empty string; the
string of a special token in a text becomes that token, as the tokenizers library
does; a word of any length is merged (long ones with a heap); an empty corpus gives
an empty lexicon; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import as_row, with_row
from .words import Words, pieces

#: The pre-token pattern of byte-level BPE vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most entries of the lexicon, the bound of what is sent to the driver and to the tasks.
LEXICON_WORDS = 1 << 17
#: Words that a Python worker remembers before it starts anew.
REMEMBERED = 200_000
#: Bytes of a word from which on it is merged by itself.
LONG = 48
_NONE = np.int64(1) << 62


def _byte_of_char() -> dict[str, int]:
    """Printable bytes stand for themselves; the others are numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, text: str):
        file = json.loads(text)
        chars = _byte_of_char()
        ids = file["model"]["vocab"]
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            self.tokens[i] = bytes(chars[c] for c in token)
        for token, i in special.items():
            self.tokens[i] = token.encode()
        self.special = special
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for token, i in ids.items():
            if len(token) == 1:
                self.byte_ids[chars[token]] = i
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.ranks.values()], dtype=np.int64)[order]
        self.pair_ids = np.array([i for _, i in self.ranks.values()], dtype=np.int64)[order]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (a large number: it doesn't merge) and the id it merges to."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def merge_one(self, word: bytes) -> list[int]:
        """Lowest rank first, the leftmost of equals, with a heap over a linked list."""
        ids: list[int | None] = [int(self.byte_ids[b]) for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.ranks[a, b][1], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p][0], k, *p))
        return [i for i in ids if i is not None]

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; every round merges one pair of each word that still has one."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        short = []
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = np.array(self.merge_one(word), dtype=np.int64)
            elif word:
                short.append(i)
        if not short:
            return out
        names = np.array(short)
        ids = self.byte_ids[np.frombuffer(b"".join(words[i] for i in short), dtype=np.uint8)]
        counts = np.array([len(words[i]) for i in short])
        ranks, made = self._pairs(ids, counts)
        while len(names):
            first = np.cumsum(counts) - counts
            # the rank is above, the place below: the least is the leftmost of the best
            best = np.minimum.reduceat(np.where(ranks < _NONE, ranks << 32 | np.arange(len(ids)), _NONE), first)
            live = best < _NONE
            if not live.all():
                ends = np.repeat(~live, counts)
                for i, part in zip(names[~live], np.split(ids[ends], np.cumsum(counts[~live])[:-1])):
                    out[i] = part
                stay = ~ends
                names, counts, ids, ranks, made = names[live], counts[live], ids[stay], ranks[stay], made[stay]
                continue
            at = best & 0xFFFFFFFF
            ids[at] = made[at]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, ranks, made = ids[keep], ranks[keep], made[keep]
            at = at - np.arange(len(at))
            counts = counts - 1
            first = np.cumsum(counts) - counts
            last = at == first + counts - 1
            ranks[at[last]] = _NONE
            inner = at[~last]
            ranks[inner], made[inner] = self.find(ids[inner], ids[inner + 1])
            left = at[at > first] - 1
            ranks[left], made[left] = self.find(ids[left], ids[left + 1])
        return out

    def _pairs(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ranks, made = np.full(len(ids), _NONE), np.zeros(len(ids), dtype=np.int64)
        if len(ids) > 1:
            ranks[:-1], made[:-1] = self.find(ids[:-1], ids[1:])
        ranks[np.cumsum(counts) - 1] = _NONE
        return ranks, made

    def decode(self, ids: Iterable[int]) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer of words to ids, as one run of 32-bit numbers.

    Words are added in order; a state whose subtree can't grow any more is replaced by
    an equal one that exists, so that suffixes are shared.  A transition's output is the
    number of words that come before it at its state, so outputs add up to word numbers.
    """
    states: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    ordered = sorted(w for w in words if w)

    def close(path: list[int], word: bytes, keep: int) -> None:
        for depth in range(len(path) - 1, keep, -1):
            state = path[depth]
            same = known.setdefault((final[state], tuple(states[state].items())), state)
            if same != state:
                states[path[depth - 1]][word[depth - 1]] = same

    path, last = [0], b""
    for word in ordered:
        shared = len(os.path.commonprefix([last, word]))
        close(path, last, shared)
        del path[shared + 1 :]
        for byte in word[shared:]:
            states.append({})
            final.append(False)
            states[path[-1]][byte] = len(states) - 1
            path.append(len(states) - 1)
        final[path[-1]] = True
        last = word
    close(path, last, 0)

    number, todo, order = {0: 0}, [0], []
    while todo:
        state = todo.pop()
        order.append(state)
        for child in states[state].values():
            if child not in number:
                number[child] = len(number)
                todo.append(child)
    reach: dict[int, int] = {}

    def count(top: int) -> int:
        stack = [top]
        while stack:
            state = stack[-1]
            open_ = [c for c in states[state].values() if c not in reach]
            if open_:
                stack += open_
            else:
                reach[stack.pop()] = final[state] + sum(reach[c] for c in states[state].values())
        return reach[top]

    count(0)
    rows = []
    for state in order:
        skip = int(final[state])
        for byte, child in sorted(states[state].items()):
            rows.append((number[state] << 8 | byte, number[child], skip))
            skip += reach[child]
    table = np.array(sorted(rows), dtype=np.uint32).reshape(-1, 3)
    ends = np.zeros(len(number), dtype=np.uint32)
    ends[[number[s] for s in order if final[s]]] = 1
    lists = [words[w] for w in ordered]
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.uint32)
    flat = np.array([i for ids in lists for i in ids], dtype=np.uint32)
    head = np.array([len(table), len(ends), len(offsets), len(flat)], dtype=np.uint32)
    return b"".join(x.tobytes() for x in (head, table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), ends, offsets, flat))


def memory_map(data: bytes) -> np.ndarray:
    """The numbers of ``data``, mapped from a file of this executor's temporary folder, written if it isn't there."""
    path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.u32")
    if not os.path.exists(path) or os.path.getsize(path) != len(data):
        with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as out:
            out.write(data)
        os.replace(out.name, path)
    return np.memmap(path, dtype=np.uint32, mode="r")


class Lexicon:
    def __init__(self, numbers: np.ndarray):
        trans, states, offsets, flat = (int(x) for x in numbers[:4])
        cuts = np.cumsum([4, trans, trans, trans, states, offsets, flat])
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (numbers[a:b] for a, b in zip(cuts, cuts[1:]))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word in the lexicon, or -1; all words take a step at a time."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not words or not len(self.keys):
            return out
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths > 0)
        state, number = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        depth = 0
        while len(live):
            key = (state << 8 | data[first[live] + depth]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state, number = self.targets[at].astype(np.int64), number[hit] + self.skips[at]
            depth += 1
            done = lengths[live] == depth
            full = done & (self.final[state] == 1)
            out[live[full]] = number[full]
            live, state, number = live[~done], state[~done], number[~done]
        return out


class Encoder:
    """Encodes texts in one worker; it remembers the words of late, within a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in vocabulary.special)) if vocabulary.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1024, dtype=np.int64)
        self.counts = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(4096, dtype=np.int32)
        self.used = 0
        for text, i in self.vocabulary.special.items():
            self._add([text], [np.array([i])])

    def _add(self, words: list[str], lists: list[np.ndarray]) -> None:
        n, lengths = len(self.known), np.array([len(x) for x in lists], dtype=np.int64)
        new = np.concatenate(lists) if lists else np.zeros(0)
        for name, need in (("starts", n + len(words)), ("counts", n + len(words)), ("ids", self.used + len(new))):
            old = getattr(self, name)
            if need > len(old):
                grown = np.zeros(max(need, 2 * len(old)), dtype=old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.starts[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.counts[n : n + len(words)] = lengths
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)
        self.known.update(zip(words, range(n, n + len(words))))

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        lists: list[np.ndarray | None] = [None] * len(words)
        rest = range(len(words))
        if self.lexicon is not None:
            numbers = self.lexicon.find(raw)
            offsets, flat = self.lexicon.offsets, self.lexicon.ids
            for i in np.flatnonzero(numbers >= 0).tolist():
                k = numbers[i]
                lists[i] = flat[offsets[k] : offsets[k + 1]]
            rest = np.flatnonzero(numbers < 0).tolist()
        for i, ids in zip(rest, self.vocabulary.merge_many([raw[i] for i in rest])):
            lists[i] = ids
        self._add(words, lists)

    def split(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (and the end)."""
        flat: list[str] = []
        cuts = [0]
        for text in texts:
            flat += self.split(text)
            cuts.append(len(flat))
        if len(self.known) > REMEMBERED:
            self._forget()
        if missing := list(set(flat).difference(self.known)):
            self._learn(missing)
        at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[cuts]


_encoders: dict[str, Encoder] = {}


def encoder_of(model: Broadcast) -> Encoder:
    """This worker's encoder for a broadcast (vocabulary text, lexicon bytes)."""
    name = str(model.value[2])
    if name not in _encoders:
        _encoders.clear()
        vocabulary, lexicon, _ = model.value
        _encoders[name] = Encoder(Vocabulary(vocabulary), Lexicon(memory_map(lexicon)) if lexicon else None)
    return _encoders[name]


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the letters that words after a blank begin with: with the blank, these are pre-tokens, and most of a text's."""
    for batch in batches:
        texts = batch.column(0)
        for a, b in pieces(texts, 1 << 20):
            words = Words(texts.slice(a, b - a), hashes=False)
            other = np.flatnonzero(np.append(~_LETTER[words.data], True))
            starts = words.starts[(words.starts > 0) & ~np.isin(words.starts, words.offsets)]
            starts = starts[words.data[starts - 1] == 0x20]
            ends = np.minimum(other[np.searchsorted(other, starts)], words.ends[np.searchsorted(words.ends, starts, side="right")] if len(starts) else 0)
            starts, ends = starts[ends > starts], ends[ends > starts]
            _, first, n = np.unique(words.span_hashes(starts, ends), return_index=True, return_counts=True)
            data = words.data.tobytes()
            found = [" " + data[i:j].decode("utf-8", "ignore") for i, j in zip(starts[first].tolist(), ends[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n)], names=["word", "n"])


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The words, each with the blank before it, that make up at least 1 / ``most`` of all such words of the corpus: so there are ``most`` at the most, at any size."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    frequent = counted.crossJoin(F.broadcast(total)).filter(F.col("n") * most >= F.col("total"))  # one row: the total
    return sorted(r["word"] for r in frequent.select("word").collect())


def model_for(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> Broadcast:
    """Vocabulary and compiled lexicon for the tasks; their size depends on ``words`` and the file only."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    vocabulary = Vocabulary(text)
    frequent = [w.encode() for w in frequent_words(docs, words)] if words else []
    lexicon = compile_lexicon({w: ids.tolist() for w, ids in zip(frequent, vocabulary.merge_many(frequent))})
    name = hashlib.sha256(text.encode() + lexicon).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((text, lexicon, name))


def _encode_decode(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            texts = batch.column("row").field("text").cast(pa.string()).fill_null("")
            for a, b in pieces(texts, 1 << 20):
                ids, cuts = encoder.encode(texts.slice(a, b - a).to_pylist())
                decode, flat, ends = encoder.vocabulary.decode, ids.tolist(), cuts.tolist()
                decoded = [decode(flat[i:j]) for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(a, b - a), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())],
                    names=["row", "ids", "decoded"],
                )

    return run


def encode(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """row (a struct of the input's columns), ids (array<int>), and decoded: the text that the ids give back."""
    model = model_for(docs, path, words)
    rows = docs.select(as_row(docs.columns))
    return rows.mapInArrow(_encode_decode(model), with_row(rows, "ids array<int>, decoded string"))
