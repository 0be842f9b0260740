"""HyperMinHash components, importance resampling and fill-in-the-middle, against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SMALL
from tidewatch.llm import fim, hyper, queries, resample

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LINES = re.compile(r"[^\n]*\n|[^\n]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def near_id(row):
    return (row is None, row if row is not None else 0)


def brute_components(rows, num=85, den=100, n=3):
    sets = []
    for _, text in rows:
        w = SPACED.findall(lower(text))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]) if len(rows) < 400 else None
    for (a, b), c in common.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return Counter((name, len(sets[i]), least.get(root(i)), name is not None and name == least.get(root(i))) for i, (name, _) in enumerate(rows))


def ours_components(df, **options):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hyper.components_of(df, **options).collect())


def copies(rng, groups, members, low=30, high=120, edits=4):
    rows = []
    for _ in range(groups):
        base = [f"W{rng.randrange(10**6)}" for _ in range(rng.randint(low, high))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w) if rng.random() < 0.5 else "\n".join(w).lower()))
    return rows


def test_components_against_all_pairs(spark):
    rows = copies(random.Random(4), 8, 12) + copies(random.Random(5), 12, 6, low=6, high=14, edits=1)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(900, ""), (901, None), (902, "short text"), (903, "Short  text"), (904, " \t"), (905, "a"), (None, rows[0][1]), (None, rows[0][1]), (None, "no id here at all"), (907, rows[3][1]), (907, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ours_components(df) == brute_components(rows)


def test_components_in_many_blocks(spark):
    """Groups cut into blocks of a few texts, with chains whose ends aren't alike, give the same components."""
    rng = random.Random(6)
    rows = copies(rng, 2, 25, low=50, high=60, edits=3)
    chain = [f"c{rng.randrange(10**6)}" for _ in range(90)]
    for i in range(30):
        chain[i * 3 : i * 3 + 2] = [f"x{i}", f"y{i}"]
        rows.append((1000 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert ours_components(df, members=4) == want and ours_components(df, members=1) == want and ours_components(df) == want


def test_components_are_joined_anew_only_where_groups_are_cut(spark, monkeypatch):
    """Groups in one block have their roots from it: no further rounds, whose plans fill the driver's memory."""
    calls, joined = [], hyper.components
    monkeypatch.setattr(hyper, "components", lambda edges: calls.append(1) or joined(edges))
    rows = [(i, " ".join(f"w{j}" for j in range(60) if j != 59 - i % 3) + f" t{i // 6}") for i in range(18)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours_components(df) == brute_components(rows) and len(calls) == 1
    assert ours_components(df, members=2) == brute_components(rows) and len(calls) >= 2


def test_size_estimates_stay_small_where_groups_are_cut(spark):
    """Rounds of components on the links of others: the estimate of the result's size doesn't grow exponentially with them."""
    chain = [f"c{j}" for j in range(90)]
    rows = []
    for i in range(30):
        chain[i * 3 : i * 3 + 2] = [f"x{i}", f"y{i}"]
        rows.append((i, " ".join(chain)))
    found = hyper.components_of(spark.createDataFrame(rows, "doc_id long, text string"), members=4)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 8000
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()) == brute_components(rows)


def test_components_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ours_components(odd) == brute_components(rows)
    assert hyper.components_of(none).count() == 0
    assert hyper.components_of(odd).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_registers_and_estimate():
    values = np.array([1 << 63, (1 << 63) - 1, 1, 0, (1 << 64) - 1, 1 << 40, (1 << 40) + (1 << 35)], dtype=np.uint64)
    r = hyper.registers(values).tolist()
    assert r[0] == 63 << hyper.MANTISSA and r[2] == 0 and r[3] == 0 and r[4] == (1 << 16) - 1
    assert r[5] == 40 << hyper.MANTISSA and r[6] == (40 << hyper.MANTISSA) + (1 << hyper.MANTISSA - 5)
    rng = np.random.default_rng(2)
    for j in (0.0, 0.5, 0.85):
        shared = rng.integers(0, 1 << 63, size=int(800 * j), dtype=np.uint64) * np.uint64(2)
        sets = [np.concatenate([shared, rng.integers(0, 1 << 63, size=int(400 * (1 - j)), dtype=np.uint64)]) for _ in range(2)]
        odds, masks = rng.integers(0, 1 << 63, size=(2, 4000), dtype=np.uint64)
        agree = np.mean([hyper.registers(((sets[0] ^ m) * (o | np.uint64(1))).min(keepdims=True)) == hyper.registers(((sets[1] ^ m) * (o | np.uint64(1))).min(keepdims=True)) for m, o in zip(masks, odds)])
        true = len(shared) / (len(shared) + 2 * int(400 * (1 - j)))
        assert abs(hyper.estimate(agree, np.float64(len(sets[0])), np.float64(len(sets[1]))) - true) < 0.04


def brute_resample(rows, target, percent=5, seed=42, longest=3):
    def features(text):
        w = LETTERS.findall(lower(text))
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000))))
    out, asked = [], []
    for i, (name, text) in enumerate(rows):
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([name, len(f), weight, score, None])
        if len(w) >= 20:
            asked.append((-score, near_id(name), i))
    for rank, (_, _, i) in enumerate(sorted(asked)[: len(asked) * percent // 100], 1):
        out[i][4] = rank
    return Counter(map(tuple, out))


def ours_resample(df, target, **options):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in resample.resample(df, target, **options).collect())


def test_resampling_against_a_loop(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ärger", "中文", "naïve", "X" * 70, "y" * 5000, "B2b"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", ".", "\x7f"]) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 90))) for i in range(300)] + [(400, None), (401, ""), (402, "!!"), (None, text(40)), (403, text(4000))]
    target = [text(30) for _ in range(40)] + [None, ""]
    df, wanted = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")
    assert ours_resample(df, wanted) == brute_resample(rows, target)
    assert ours_resample(df, wanted.filter("false"), percent=50) == brute_resample(rows, [], percent=50)
    features = {bytes(r.feature): (r.n, r.n_target) for r in resample.dictionary(df, wanted, run_bytes=3000, part_strings=2000).collect()}
    count = lambda texts: Counter(" ".join(w[i : i + n]).encode() for w in map(LETTERS.findall, map(lower, texts)) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    raw, aim = count(t for _, t in rows), count(target)
    assert features == {f: (raw[f], aim[f]) for f in raw | aim}


def test_resampling_of_odd_rows(odd, none, spark):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ours_resample(odd, odd.filter("lang = 'en'"), percent=60) == brute_resample(rows, [r.text for r in odd.filter("lang = 'en'").collect()], percent=60)
    assert resample.resample(none, none).count() == 0
    same = spark.createDataFrame([(1, "one two three " * 9)] * 40 + [(2, "four " * 30)] * 3, "doc_id long, text string").repartition(3)
    got = resample.resample(same, same, percent=100).collect()
    assert sorted(r.rank for r in got) == list(range(1, 44))


def test_joined_checksums():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 2, 5, 63, 64, 65, 127, 128, 1000, 70000)]
    for a in parts:
        for b in parts:
            assert resample.joined_sums(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))[0] == zlib.crc32(a + b)


def brute_fim(rows, seed=7, rate=100, spm=50):
    out = []
    for name, text in rows:
        text = text or ""
        lines = LINES.findall(text)
        n = len(lines)
        d = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
        h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
        if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= rate:
            out.append((name, n, "plain", None, None, text))
        elif h[3] % 100 < spm:
            out.append((name, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            out.append((name, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    return Counter(out)


def ours_fim(df, **options):
    rows = fim.transform(df, **options)
    got = rows.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(rows["output"], rows["form"]).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in got)
    return Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got)


def test_fill_in_middle_against_a_loop(spark):
    rng = random.Random(12)
    pieces = ["a", "é", "中", "😀", "\n", "\n", "\n\n", "<", "<P", "<S", "P>", ">", "S>", "M>", "\r", " "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30)))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, "<M>"), (703, "x<P"), (704, ">y"), (None, "l1\nl2\nl3"), (705, "é" * 3000 + "\n" + "z" * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ours_fim(df) == brute_fim(rows)
    assert ours_fim(df, seed=1, rate=40, spm=20) == brute_fim(rows, 1, 40, 20)
    with pytest.raises(ValueError):
        fim.transform(df, marks=("<P>", "<P>", "<M>"))


def test_fill_in_middle_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ours_fim(odd) == brute_fim(rows)
    assert fim.transform(none).count() == 0
    found = fim.cuts(pa.array(["ab\ncd", "x"]).slice(1), [np.array([0])] * 4, 100, 0, fim.MARKS)
    assert found.column("output").to_pylist() == ["<P><S>x<M>"]


def test_queries_on_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter(tuple(r) for r in queries.op13_fill_in_middle(spark, SMALL).collect())
    text = dict(docs)
    assert got == Counter((*r[:5], sha(r[5]), sha(text[r[0]] or "")) for r in brute_fim(docs))
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op12_resampling(spark, SMALL).collect()) == brute_resample(docs, target)
    assert Counter(tuple(r) for r in queries.op11_hyperminhash(spark, SMALL).collect()) == brute_components(docs)
