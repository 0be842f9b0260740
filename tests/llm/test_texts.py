"""Substring de-duplication, near duplicates, BPE and token counts, against brute force and the tokenizers library."""

import bisect
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidewatch.llm import bpe, near, substring, tokencounts
from tidewatch.llm.queries import tokenizer_path
from tidewatch.llm import words as words_module
from tidewatch.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_words_of_a_batch():
    texts = ["a  b\tc", None, "", " x ", "é z q\x1cr", "end"]
    w = Words(pa.array(texts))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    flat = [x.encode() for t in texts for x in words(t)]
    assert [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)] == flat
    again = Words(pa.array(["zz " + t if t else "zz" for t in texts]))
    assert set(w.hashes) <= set(again.hashes) and len(set(w.hashes)) == len(set(flat))
    assert Words(pa.array([], pa.string())).counts.tolist() == []


def brute_repeats(rows, width):
    seen = Counter(tuple(w[i : i + width]) for _, t in rows for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for name, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((name, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def ours_repeats(df, width):
    return sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, width).collect()), key=repr)


def test_repeats_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ours_repeats(odd, 35) == brute_repeats(rows, 35)
    assert ours_repeats(odd, 5) == brute_repeats(rows, 5)
    assert substring.remove_repeats(none).count() == 0
    assert substring.deduplicated(odd).columns == odd.columns and substring.deduplicated(odd).count() == odd.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_random_texts(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(8, 60))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.6 else [str(rng.random()) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ours_repeats(df, 35) == brute_repeats(rows, 35)
    assert ours_repeats(df, 9) == brute_repeats(rows, 9)


def brute_near(rows, similarity=(4, 5), n=5):
    sets = {}
    for name, text in rows:
        w = words(text)
        sets[name] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    links, parent = Counter(), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common * similarity[1] >= similarity[0] * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in names}


def near_rows(rng, groups, members):
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 120))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = near_rows(random.Random(3), 6, 9) + [(900, ""), (901, None), (902, "short text"), (903, "short  text"), (904, "short text")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_in_many_blocks(spark):
    """A group cut into blocks, down to one text a block, gives the same links."""
    rows = near_rows(random.Random(4), 2, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"block": 60}, {"block": 300}, {"members": 5}):
        assert {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(df, **options).collect()} == brute_near(rows)


def test_blocks_are_compared_in_parts(monkeypatch):
    rng = random.Random(1)
    rows = [(i, 1 + i % 3, int(i >= 9), np.unique(np.array([rng.randrange(12) for _ in range(10)], dtype=np.uint64))) for i in range(20)]
    for apart, members in ((False, rows[:9]), (True, rows)):
        monkeypatch.setattr(near, "ROWS", 256)
        whole = near._verify_block(members, 4, 5, apart)
        monkeypatch.setattr(near, "ROWS", 4)
        assert all((x == y).all() for x, y in zip(whole, near._verify_block(members, 4, 5, apart)))


def test_near_duplicates_of_odd_rows(odd, none):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(odd).collect()}
    assert got[8][0] == got[9][0] == 8 and got[1] == (1, 0) and got[2] == (2, 0) and got[3] == (3, 0)
    assert near.near_duplicates(none).count() == 0
    kept = near.representatives(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.select("doc_id").collect()} >= {1, 2, 3, 4, 8}


def test_representatives_of_null_and_repeated_ids(spark):
    """Unlike rows stay, also without a doc_id or with that of another row; copies, near copies and repeats go."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(5)]
    text = [" ".join(w) for w in base]
    near_ = [" ".join([*w[:-1], "other"]) for w in base]
    rows = [(None, text[0]), (None, text[0]), (None, near_[0]), (None, text[1]), (3, near_[1]), (5, text[2]), (5, text[2]), (5, text[3]), (7, near_[3]), (None, text[4]), (9, ""), (9, ""), (None, ""), (None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in near.representatives(df).collect()), key=repr)
    first = [r for r in kept if r[1] in (text[0], near_[0])]
    assert len(first) == 1 and first[0][0] is None
    want = [(3, near_[1]), (5, text[2]), (5, text[3]), (None, text[4]), (9, ""), (9, ""), (None, ""), (None, None)]
    assert sorted([r for r in kept if r not in first], key=repr) == sorted(want, key=repr)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near.near_duplicates(df).collect())
    assert got == Counter({(None, None, 2): 3, (None, 3, 1): 1, (3, 3, 1): 1, (5, 5, 0): 2, (5, 5, 1): 1, (7, 5, 1): 1, (None, None, 0): 3, (9, 9, 0): 2})


def test_near_duplicates_with_names_as_ids(spark):
    """Ids may be texts; the least one in their order names a class."""
    rows = near_rows(random.Random(6), 3, 4)
    df = spark.createDataFrame([(f"doc-{i:03d}", t) for i, t in rows], "doc_id string, text string")
    want = {f"doc-{i:03d}": (f"doc-{c:03d}", n) for i, (c, n) in brute_near(rows).items()}
    assert {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(df).collect()} == want
    assert {r.doc_id for r in near.representatives(df).collect()} == {c for c, _ in want.values()}


def test_bands_reach_the_recall():
    bands, rows = near.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    with open(tokenizer_path(), encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def test_encoding_equals_the_library(vocabulary, library):
    rng = random.Random(5)
    alphabet = list("ab \n\t'sréé中１½\x1c\x85　᠎😀!​٣ⅷ") + ["  ", "'ll", "<|endoftext|>", "the ", "tion"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["ab" * 400, " " * 300, "x" * 3000]
    frequent = [b" the", b"ab", b" tion", "é".encode()]
    lexicon = bpe.compile_lexicon({w: ids.tolist() for w, ids in zip(frequent, vocabulary.merge_many(frequent))})
    for encoder in (bpe.Encoder(vocabulary, None), bpe.Encoder(vocabulary, bpe.Lexicon(bpe.memory_map(lexicon)))):
        ids, cuts = encoder.encode(texts)
        for i, text in enumerate(texts):
            own = ids[cuts[i] : cuts[i + 1]].tolist()
            assert own == library.encode(text, add_special_tokens=False).ids
            assert vocabulary.decode(own) == library.decode(own, skip_special_tokens=False)
    broken = [rng.randrange(50257) for _ in range(300)]
    assert vocabulary.decode(broken) == library.decode(broken, skip_special_tokens=False)


def test_lexicon_numbers_its_words_and_shares_suffixes():
    words_ = {w.encode(): [i] for i, w in enumerate(["", "walking", "talking", "walked", "talked", "walk", "a"])}
    lexicon = bpe.Lexicon(bpe.memory_map(bpe.compile_lexicon(words_)))
    kept = sorted(w for w in words_ if w)
    assert lexicon.find(kept).tolist() == list(range(6)) and lexicon.find([b"wal", b"walkings", b"", b"zz"]).tolist() == [-1] * 4
    assert [lexicon.ids[lexicon.offsets[i]] for i in range(6)] == [words_[w][0] for w in kept]
    assert len(lexicon.final) < sum(map(len, kept)) / 2
    assert bpe.Lexicon(bpe.memory_map(bpe.compile_lexicon({}))).find([b"a"]).tolist() == [-1]


def test_encode_odd_rows(odd, none, library):
    for r in bpe.encode(odd, tokenizer_path()).collect():
        text = r.row.text or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text
    assert bpe.encode(none, tokenizer_path()).count() == 0


def test_section_tokens(spark, odd, none, library):
    got = {}
    for r in tokencounts.section_tokens(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), tokenizer_path()).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.begin, r.end, r.n_tokens)
    for r in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        text = r.text or ""
        begins = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
        counts = Counter(bisect.bisect_right(begins, a) - 1 for a, _ in library.encode(text, add_special_tokens=False).offsets)
        assert [got[r.doc_id][i] for i in range(len(begins))] == [(b, e, counts[i]) for i, (b, e) in enumerate(zip(begins, [*begins[1:], len(text)]))]
    assert tokencounts.section_tokens(none, tokenizer_path()).count() == 0
    spans = spark.createDataFrame([(1, "one two three", [[0, 3], [3, 3], [4, 7]])], "doc_id long, text string, spans array<array<long>>")
    rows = tokencounts.section_tokens(spans, tokenizer_path(), sections="spans").collect()
    assert sum(r.n_tokens for r in rows) == len(library.encode("one two three", add_special_tokens=False).ids) and {r.section for r in rows} == {0, 1, 2, -1}


def test_attribution_by_the_first_character():
    n, crossing, outside = tokencounts.attribute(np.array([0, 2, 5]), np.array([2, 6, 7]), np.array([[0, 4], [4, 6]]))
    assert n.tolist() == [2, 1] and crossing.tolist() == [1, 1] and outside == 0


def test_attribution_of_odd_sections(spark):
    """Sections out of order, overlapping, empty, turned around or null: each token counts once."""
    rng = random.Random(12)
    for _ in range(200):
        size = rng.randint(1, 30)
        first = np.sort(np.array([rng.randrange(size) for _ in range(rng.randint(0, 12))], dtype=np.int64))
        sections = np.array([[rng.randint(0, size), rng.randint(0, size)] for _ in range(rng.randint(0, 5))], dtype=np.int64).reshape(-1, 2)
        real = sorted((b, i) for i, (b, e) in enumerate(sections.tolist()) if e > b)
        want, outside = [0] * len(sections), 0
        for t in first.tolist():
            before = [(b, i) for b, i in real if b <= t]
            if before and t < sections[before[-1][1], 1]:
                want[before[-1][1]] += 1
            else:
                outside += 1
        n, _, out = tokencounts.attribute(first, first + 1, sections)
        assert n.tolist() == want and out == outside
    spans = spark.createDataFrame([(1, "one two three", [[4, 7], None, [0, 5], [9, None], [8, 3]]), (2, "one two", None)], "doc_id long, text string, spans array<array<long>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in tokencounts.section_tokens(spans, tokenizer_path(), sections="spans").collect()}
    # the blank before a word is its token's first character, so the last word's token begins outside of all sections
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (1, 3): 0, (1, 4): 0, (1, -1): 1, (2, -1): 2}


def test_small_tables_through_queries(spark):
    from tidewatch.llm.queries import queries

    assert queries()["op2_bpe"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def thue_morse(n):
    """The word of n letters a and b, and its complement: polynomials modulo 2**64 take such words for one another."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def structured():
    """Texts that differ in one such word, and texts of two words in such orders."""
    x, y = thue_morse(2048)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [word] + base[30:])) for i, word in enumerate((x, y))]
    return rows + [(i, t.replace("a", "left ").replace("b", "right ")) for i, t in enumerate((x, y), 2)]


def test_structured_words_are_told_apart(spark):
    rows = structured()
    w = Words(pa.array([t for _, t in rows]))
    one, other = w.first[0] + 30, w.first[1] + 30
    assert w.hashes[one] != w.hashes[other] and w.also[one] != w.also[other]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (8, 35):
        assert ours_repeats(df, width) == brute_repeats(rows, width)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(df).collect()}
    assert got == brute_near(rows)


def test_rolling_hashes_are_polynomials():
    codes = np.random.default_rng(1).integers(0, 1 << 64, size=90, dtype=np.uint64)
    for width in (1, 2, 3, 5, 12, 31, 35, 64, 90, 91):
        for number, base in enumerate(words_module._BASES):
            loop = []
            for i in range(len(codes) - width + 1):
                h = 0
                for code in codes[i : i + width].tolist():
                    h = (h * base + (code >> 3)) % words_module.PRIME
                loop.append(h)
            assert words_module.rolled(codes, width, number).tolist() == loop
