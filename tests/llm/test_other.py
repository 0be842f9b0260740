"""Language ID, LM scoring, HTML, top-k, mixing, FLAC and the pipeline."""

import hashlib
import itertools
import math
import random
import re
import struct
import subprocess
import sys
import zlib
from fractions import Fraction
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, rows
from tests.conftest import ROOT, SMALL
from tidewatch.llm import flac, htmltext, langid, lmscore, mixing, topk
from tidewatch.llm import queries as llm


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in llm.queries()["op1_language"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
    held = [r for r in docs if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(got[r.doc_id].rejected for r in docs) <= 0.01 * len(docs)


@pytest.mark.parametrize("unlearnt", ["de", "en", "es", "fr"])
def test_language_left_out_is_rejected(spark, unlearnt):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identify(docs, langid.in_training(F.col("doc_id")) & (F.col("lang") != unlearnt), carry=["doc_id", "lang"]).collect()
    other = [r.rejected for r in got if r.row.lang == unlearnt]
    own = [r.rejected for r in got if r.row.lang != unlearnt]
    assert sum(other) >= 0.95 * len(other) and sum(own) <= 0.03 * len(own)


def test_language_limits_come_from_held_back_texts():
    held = [("a", 1 + i / 100) for i in range(40)] + [("a", 9.0), ("b", 2.0)]
    a, b, c = langid.calibrated(["a", "b", "c"], held)
    assert 1.4 < a < 3 and 2 < b == c < 3.5 and np.isinf(langid.calibrated(["a"], [])).all()


def test_language_of_odd_rows(spark, odd, none):
    got = {r.row.doc_id: r for r in langid.identify(odd).collect()}
    for i in (1, 2, 3, 5):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[8].lang_pred in {"en", "de", "fr"} and langid.accepted(odd).columns == odd.columns
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def kneser_ney(counts):
    """Interpolated Kneser-Ney of one language by dictionaries: the log probability of a character after those before it."""
    levels = {langid.ORDER: counts}
    for n in range(langid.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount, total, types = {}, Counter(), Counter()
    for n, grams in levels.items():
        ones, twos = sum(c == 1 for c in grams.values()), sum(c == 2 for c in grams.values())
        discount[n] = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.05), 0.95)
        for g, c in grams.items():
            total[n, g[:-1]] += c
            types[n, g[:-1]] += 1

    def probability(gram):
        n = len(gram)
        if n == 0:
            return 1 / langid.ALPHABET
        lower = probability(gram[1:])
        if not total[n, gram[:-1]]:
            return lower
        have = levels[n][gram]
        return (max(have - discount[n], 0) + discount[n] * types[n, gram[:-1]] * lower) / total[n, gram[:-1]]

    return probability


def test_models_equal_plain_kneser_ney():
    """Probabilities of words seen and unseen, in two languages at once, are those of a plain recursion; seen contexts leave the right mass."""
    import pandas as pd

    rng = random.Random(1)
    own = {lang: Counter() for lang in ("x", "y")}
    for lang, alphabet in (("x", "abc"), ("y", "bcd")):
        for _ in range(300):
            padded = langid.START * 4 + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) + langid.END
            for i in range(len(padded) - 4):
                own[lang][padded[i : i + 5]] += 1
    models = langid.Models(pd.DataFrame([(lang, g, n) for lang, c in own.items() for g, n in c.items()], columns=["lang", "gram", "n"]))
    words = ["".join(w) for n in range(0, 4) for w in itertools.product("abcdz", repeat=n)] + ["abcabcabc", "zzzz"]
    loss, chars = models.losses(words)
    assert chars.tolist() == [len(w) + 1 for w in words]
    for column, lang in enumerate(models.langs):
        p = kneser_ney(own[lang])
        for w, got in zip(words, loss[:, column]):
            padded = langid.START * 4 + w + langid.END
            want = -sum(math.log(p(padded[i : i + 5])) for i in range(len(w) + 1))
            assert float(got) == pytest.approx(want, rel=1e-4)
        # after a seen context, the known characters have all but the floor's share
        for context in (langid.START * 4, langid.START * 3 + "b"):
            assert 0.95 < sum(p(context + c) for c in ["a", "b", "c", "d", langid.END]) <= 1 + 1e-9


def test_language_sample_is_bounded(spark):
    """Many rows of one id, and one text many times, do not make the sample larger; reruns agree."""
    texts = [f"the quick brown fox number {i} jumps over the lazy dog and runs away from here" for i in range(40)]
    rows_ = [(7, t, "en") for t in texts] + [(8, texts[0], "en")] * 3000 + [(i, f"der schnelle braune fuchs {i} springt heute hier", "de") for i in range(20)] + [(None, texts[1], "en")] * 50
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    first = langid.identify(df, F.lit(True), carry=["doc_id", "text"]).select("row.text", "lang_pred", "entropy", "rejected").distinct().collect()
    again = langid.identify(df.repartition(5), F.lit(True), carry=["doc_id", "text"]).select("row.text", "lang_pred", "entropy", "rejected").distinct().collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and {r.lang_pred for r in first if r.text.startswith("der")} == {"de"}
    assert langid.fit(df.filter("doc_id = 8 and lang = 'en'"), F.lit(True)).value.langs == ["en"]


def brute_lm(data, target):
    """(id, words, target loss, background loss) of every row, by models of all the other rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in data]
    unigrams, bigrams = [Counter(), Counter()], [Counter(), Counter()]
    for (i, _), w in zip(data, words):
        for k in (0, 1) if i in target else (0,):
            unigrams[k].update(w)
            bigrams[k].update(zip(w, w[1:]))
    out = []
    for (i, _), w in zip(data, words):
        own, pairs, losses = Counter(w), Counter(zip(w, w[1:])), []
        for k in (1, 0):
            mine = k == 0 or i in target
            size, total = sum(unigrams[k].values()) - mine * len(w) + len(unigrams[0]), 0.0
            for before, x in zip([None, *w], w):
                p = (unigrams[k][x] - mine * own[x] + 1) / size
                if before is not None:
                    p = (bigrams[k][before, x] - mine * pairs[before, x] + lmscore.PRIOR * p) / (unigrams[k][before] - mine * own[before] + lmscore.PRIOR)
                total -= math.log(p)
            losses.append(total / len(w) if w else None)
        out.append((i, len(w), *losses))
    return out


def same_scores(got, want):
    key = lambda r: (str(r[0]), r[1], r[2] or 0, r[3] or 0)
    got, want = sorted((tuple(r)[:4] for r in got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], abs=1e-9) if w[1] else g[2:] == (None, None)


@pytest.mark.parametrize(("split", "bucket"), [(lmscore.SPLIT, lmscore.BUCKET), (20_000, 2_000)])
def test_lm_scores_equal_brute_force(spark, split, bucket):
    """On whole sf0.001, in one split and in many."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    targets = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = lmscore.score(docs, targets, split, bucket).collect()
    same_scores(got, brute_lm(data, {r.doc_id for r in targets.collect()}))
    assert all(math.isclose(r.score, r.background_loss - r.target_loss) for r in got if r.n_tokens)


def test_lm_scores_of_odd_rows(spark, odd, none):
    """Null and repeated ids, with texts alike and unlike; an id that holds most of the text is spread over splits."""
    data = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(7, f"some words of row {i % 3} and more") for i in range(40)] + [(None, "a text without an id")] * 3
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(1,), (7,), (8,), (8,), (None,), (77,)], "doc_id long")
    for split in (lmscore.SPLIT, 400):
        same_scores(lmscore.score(df, targets, split, 50).collect(), brute_lm(data, {1, 7, 8}))
    empty = lmscore.score(odd, odd.filter("doc_id < 0")).collect()
    assert len(empty) == odd.count() and all(r.score == 0.0 for r in empty if not r.n_tokens)
    assert lmscore.score(none, none).count() == 0


def test_lm_scores_tell_copies_and_target_texts(spark):
    """A document is not favoured by its own presence, and copies of others are likely under a model of the whole corpus."""
    rng = random.Random(6)
    text = lambda names: " ".join(rng.choices(names, k=40))
    target, rest = [(i, text(["red", "green", "blue"])) for i in range(20)], [(100 + i, text(["one", "two", "three"])) for i in range(20)]
    odd_ones = [(200 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(6)]
    df = spark.createDataFrame(target + rest + odd_ones + [(300, odd_ones[0][1])], "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.score(df, spark.createDataFrame([(i,) for i in range(10)], "doc_id long")).collect()}
    assert min(got[i].score for i, _ in target) > max(got[i].score for i, _ in rest)
    assert got[200].background_loss + 1 < min(got[200 + i].background_loss for i in range(1, 6)) and got[200].score == got[300].score


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{x:1}</style><script>var t="</p>";</script></head><body class="page">
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, many of them, really.</p></div>
<article><header><h1>A  title &amp; more</h1></header><p>First, with commas, &lt;b&gt; and
 a break.<br><p><b>Second paragraph.<div class="ad">Buy, now, please</div><ul><li>one<li>two</ul><form><p>Name</p></form></article>
<div id="comments"><p>Great, text, thanks, everyone, bye.</p></div><aside>side</aside><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert htmltext.main_text(PAGE).split("\n\n") == ["A title & more", "First, with commas, <b> and a break.", "Second paragraph.", "one", "two"]
    assert htmltext.main_text('<div><p>Hi, there<p>you</div><div><a href="x">a, b</a></div>') == "Hi, there\n\nyou"


@pytest.mark.parametrize("source", [None, "", "<", "<p", "<div>" * 3000, '<a href="x">only a link</a>', "<!-- open", "<script>never closed", "</p></div>", "&amp"])
def test_broken_pages_do_not_break(source):
    assert isinstance(htmltext.main_text(source), str)


def test_pages_as_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "row"), (2, None, None, "x"), (None, "v", "<p>A", "y")], "page_id long, url string, html string, row string")
    got = {r.row.page_id: (r.text, r.n_chars) for r in htmltext.extract(df).collect()}
    assert got[2] == ("", 0) and got[None] == ("A", 1) and got[1][1] == len(got[1][0])
    assert htmltext.extract(df.filter("false")).count() == 0


def test_top_k_matches_sql(spark):
    assert rows(llm.queries()["op5_topk"](spark, SMALL).toPandas()) == rows(connect(SMALL).execute(llm.oracle_sql()["op5_topk"]).df())


def test_top_k_of_odd_vectors(spark):
    data = [(0, [1.0, 2.0], "r"), (1, [1.0, 2.0], "r"), (1, [1.0, 2.0], "r"), (2, None, "r"), (3, [None, 1.0], "r"), (4, [float("nan"), 1.0], "r"), (5, [3.0], "r"), (6, [-1.0, 0.5], "r"), (7, [1.0, 2.0], "r"), (None, [1.0, 1.0], "r"), (100, [1e200, -1e200], "r"), (8, [], "r")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank string")
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, k=2, tile=2).filter("query_id = 0").orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 1] and got[0][3] == 1024 * 1024 + 2048 * 2048
    assert topk.search(df, F.col("vec_id") == 100, k=20).filter("score > 0").count() == 0
    assert topk.search(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    # an unusable vector does not hide a usable one of the same id
    twice = spark.createDataFrame([(0, [1.0, None]), (0, [1.0, 2.0]), (1, [1.0, 1.0]), (0, [float("inf"), 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(twice, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 1024 + 2048 * 1024)]


def test_top_k_of_huge_components(spark):
    """Finite components beyond what doubles scale, beside small ones: scores of Python's integers, cut to 64 bits."""
    big = 1.7e308
    rows_ = [(0, [1e306, 1.0]), (10, [-big, big]), (20, [0.25, -0.5]), (1, [1e306, 2.0]), (2, [-1e306, 1.0]), (3, [0.0, 0.0]), (4, [1e-300, -1e-300]), (5, [big, big]), (6, [3.0, 1e300]), (7, [0.0, 5.0])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [math.floor(1024 * Fraction(x)) for x in v] for i, v in rows_}
    want = []
    for q in (0, 10, 20):
        scores = sorted((-max(-(2**63) + 2, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i in whole if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:10], 1)]
    for tile in (1, 2, 100):
        assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 10 == 0, tile=tile).collect())) == want


def test_top_k_in_many_cells_with_ties(spark):
    rng = random.Random(9)
    rows_ = [(i, [float(rng.randrange(-3, 4)) for _ in range(3 if i % 5 else 2)]) for i in range(400)] + [(i, [5e8, -1.0, 2.0]) for i in (500, 501)]  # the products of two of these are beyond 64 bits
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(4)
    want = []
    for q, v in rows_:
        if q % 10 == 0:
            scores = sorted((-sum(math.floor(8 * a) * math.floor(8 * b) for a, b in zip(v, w)), i) for i, w in rows_ if i != q and len(w) == len(v))
            want += [(q, rank, i, min(-s, 2**63 - 1)) for rank, (s, i) in enumerate(scores[:7], 1)]
    for coalesce in ("true", "false"):  # cells meet also where partitions are many
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = topk.search(df, F.col("vec_id") % 10 == 0, k=7, scale=8.0, tile=16).collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.grid(1, 1) == (1, 1)
    q, c = topk.grid(10**7, 10**9)
    assert 50 < c / q < 200 and q * c * topk.PRODUCTS >= 10**16 / topk.TILE**2 / 2


def fill(sizes, weights, total, caps):
    target, free, rest = dict.fromkeys(sizes, 0.0), set(sizes), total
    while free:
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > caps[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = caps[s]
            rest -= caps[s]
            free.discard(s)
    return target


def mixed(got, source):
    """Of the rows of a mix: sizes and taken words by source, and words by shard and source."""
    sizes, taken, shards = Counter(), Counter(), Counter()
    for r in got:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(x.words for x in r.draws) and all(x.words for x in r.draws)
        for x in r.draws:
            shards[source[r.doc_id], x.shard] += x.words
    return sizes, taken, shards


def test_mix_meets_the_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.mix(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, _ = mixed(got, source)
    targets = {source[r.doc_id]: r.target for r in got}
    order = sorted(sizes)
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), {s: 2 * n for s, n in sizes.items()})
    for s in order:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - targets[s]) <= 1
        parts = [x.words for r in got if source[r.doc_id] == s for x in r.draws if x.words < r["size"]]
        assert len(parts) <= 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_draws_blocks_by_shard(spark):
    """On sf0.01: other seeds and blocks draw other documents; shards' words follow their quotas of blocks."""
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    shards, block = 4, 512
    got = mixing.mix(docs, shards=shards, block_words=block).collect()
    sizes, taken, words = mixed(got, source)
    longest = Counter()
    for r in got:
        longest[source[r.doc_id]] = max(longest[source[r.doc_id]], r["size"])
    by_shard = Counter()
    for (s, shard), n in words.items():
        by_shard[shard] += n
    assert set(by_shard) == set(range(shards)) and max(by_shard.values()) < 1.25 * min(by_shard.values())
    for s in taken:
        # a shard's quota is a hypergeometric draw about a fourth of the source's blocks
        q = taken[s] / block
        for shard in range(shards):
            assert abs(words[s, shard] - taken[s] / shards) <= 4 * block * math.sqrt(q * 3 / 16) + 2 * longest[s]
    other = {r.doc_id: r.taken for r in mixing.mix(docs, seed=5).collect()}
    assert sum(other[r.doc_id] != r.taken for r in got) > len(got) / 10 and sum(other.values()) == pytest.approx(sum(taken.values()), abs=40)


def test_mix_of_odd_rows(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in got)
    # a third of the rows alike in id and text, and many without an id
    data = [(5, "one two three four", "a")] * 60 + [(None, f"row {i} of it", "a") for i in range(60)] + [(i, f"text {i}", "b") for i in range(60)]
    many = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), block_words=64).collect()
    assert len(many) == 180 and len({r.taken for r in many if r.doc_id == 5}) == 1
    total = sum(r.taken for r in many if r.doc_id is None or r.doc_id == 5)
    target = next(r.target for r in many if r.doc_id == 5)
    assert target - 60 <= total <= target + 1


def test_mixed_documents_are_the_draws_in_shuffled_shards(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = Counter()
    for r in mixing.mix(docs, shards=2).collect():
        for x in r.draws:
            want[r.doc_id, x.words] += 1
    out = mixing.mixed_documents(docs, shards=2, part_words=1 << 14)
    got = out.collect()
    assert Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in got) == want
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)
    assert {r.doc_id: r.source for r in got}.items() <= {r.doc_id: r.source for r in docs.collect()}.items()


@pytest.mark.parametrize("chunk", [mixing.CHUNK, 1, 3])
def test_splitting_tree_keeps_quotas(spark, chunk):
    quotas = [(0, 1000), (1, 0), (2, 37), (3, 5000)] + [(i, 3) for i in range(4, 12)]
    runs = mixing.split_quotas(spark.createDataFrame(quotas, "rank int, quota long"), 8, 1, chunk).collect()
    for rank, quota in quotas:
        own = sorted((r.shard, r.first, r.blocks) for r in runs if r.rank == rank)
        assert sum(b for _, _, b in own) == quota and [f for _, f, _ in own] == [sum(b for _, _, b in own[:i]) for i in range(8)]
    loads = Counter()
    for r in runs:
        loads[r.shard] += r.blocks
    assert max(loads.values()) - min(loads.values()) <= 3
    assert abs(max(r.blocks for r in runs if r.rank == 3) - 625) < 80  # near an eighth


def payloads():
    rng = random.Random(2)
    out = [flac.padded(b""), flac.padded(b"a" * 65), bytes(rng.randrange(256) for _ in range(64 * 80)), bytes([128]) * 64, bytes(range(256)) * 40]
    out += [bytes(int(128 + 100 * math.sin(i / 9)) for i in range(n)) for n in (64, 4096, 4160, 12288)]
    return [*out, flac.padded(("Some text, and more. " * 700).encode())]


def test_flac_round_trip_and_seeking():
    streams = flac.encode_many(payloads())
    assert flac.decode_many(streams) == payloads()
    for stream, payload in zip(streams, payloads()):
        for first, count in ((0, 10), (4090, 20), (len(payload) - 5, 50), (len(payload), 3)):
            assert flac.read_samples(stream, first, count) == payload[first : first + count]


def test_flac_streams_of_other_encoders():
    """Fixed predictors of orders 3 and 4 and a linear one, written here bit by bit, are read too."""
    x = [int(50 * math.sin(i / 7)) for i in range(200)]

    def frame(kind, order, coefficients, shift, head_bits):
        bits = f"{kind << 1:08b}" + "".join(f"{v & 255:08b}" for v in x[:order]) + head_bits + "00" + "0000" + f"{4:04b}"
        for t in range(order, len(x)):
            r = x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(coefficients)) >> shift)
            u = r << 1 if r >= 0 else (-r << 1) - 1
            bits += "0" * (u >> 4) + "1" + f"{u & 15:04b}"
        head = bytes([0xFF, 0xF8, 0x74, 0x02, 0]) + struct.pack(">H", len(x) - 1)
        body = head + bytes([flac.crc8(head)]) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        return body + struct.pack(">H", flac.crc16(np.frombuffer(body, np.uint8)))

    frames = [frame(0x08 | o, o, flac.FIXED[o], 0, "") for o in (3, 4)]
    c = [1900, -950]
    frames.append(frame(0x20 | 1, 2, c, 10, f"{12:04b}{10:05b}" + "".join(f"{v & 8191:013b}" for v in c)))
    for f in frames:
        assert next(flac.decode_frames([(f, 0, len(f), len(x))])).tolist() == x


def test_flac_codes_of_other_encoders():
    """Partitions, five-bit parameters, escape codes, wasted bits and streams without a seek table."""
    rng = random.Random(3)
    x = [2 * int(20 * math.sin(i / 7) + rng.randint(-3, 3)) for i in range(256)]
    y = [v >> 1 for v in x]  # with one wasted bit

    def residuals(values, order, method, partitions, escape):
        bits = f"{method:02b}{partitions:04b}"
        part = len(values) >> partitions
        for p in range(1 << partitions):
            own = range(max(order, p * part), (p + 1) * part)
            r = [values[t] - sum(c * values[t - 1 - j] for j, c in enumerate(flac.FIXED[order])) for t in own]
            if escape and p == 1:
                bits += "1" * (4 + method) + f"{9:05b}" + "".join(f"{v & 511:09b}" for v in r)
            else:
                k = p % 4 + 2
                folded = [v << 1 if v >= 0 else (-v << 1) - 1 for v in r]
                bits += f"{k:0{4 + method}b}" + "".join("0" * (u >> k) + "1" + f"{u & (1 << k) - 1:0{k}b}" for u in folded)
        return bits

    def frame(number, bits, n):
        head = bytes([0xFF, 0xF8, 0x74, 0x02, number]) + struct.pack(">H", n - 1)
        body = head + bytes([flac.crc8(head)]) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        return body + struct.pack(">H", flac.crc16(np.frombuffer(body, np.uint8)))

    warm = lambda values, order, width: "".join(f"{v & (1 << width) - 1:0{width}b}" for v in values[:order])
    frames = [frame(i, f"{(8 | 2) << 1:08b}" + warm(x, 2, 8) + residuals(x, 2, method, partitions, escape), 256) for i, (method, partitions, escape) in enumerate([(0, 3, False), (1, 0, False), (1, 2, True), (0, 1, True)])]
    frames.append(frame(4, f"{(8 | 1) << 1 | 1:08b}" + "1" + warm(y, 1, 7) + residuals(y, 1, 0, 0, False), 256))
    for f in frames:
        assert next(flac.decode_frames([(f, 0, len(f), 256)])).tolist() == x
    samples = np.array(x * len(frames), dtype=np.int8).tobytes()
    info = struct.pack(">HH", 256, 256) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    stream = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)
    payload = (np.frombuffer(samples, np.uint8) ^ 0x80).tobytes()
    assert flac.decode_many([stream]) == [payload] and flac.read_samples(stream, 300, 20) == payload[300:320]


def test_flac_of_a_long_text_takes_bounded_memory():
    code = "import resource; from tidewatch.llm import flac; p = bytes(range(32, 96)) * (1 << 18); s = flac.encode_many([p]); assert flac.decode_many(s) == [p]; flac.features(p); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    peak = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True).stdout
    assert int(peak.split()[-1]) < 700_000  # KB, for 16 MB; what is kept is the text, the stream and the payload


def test_flac_checksums_are_verified():
    stream = flac.encode(flac.padded(b"some text to store, again and again " * 9))
    for place in (-1, -20, len(stream) - 40):
        broken = bytearray(stream)
        broken[place] ^= 4
        with pytest.raises(flac.BadStream):
            flac.decode_many([bytes(broken)])
    with pytest.raises(flac.BadStream):
        flac.decode_many([b"RIFF" + stream[4:]])


def test_flac_rows(odd, none):
    for r in flac.store_texts(odd).collect():
        raw = (r.row.text or "").encode()
        assert r.payload == flac.padded(raw) and r.n_bytes == len(raw) and f"samples={len(r.payload)};" in r.feature
    assert flac.store_texts(none).count() == 0
    media = flac.store_texts(odd.filter("doc_id = 4")).selectExpr("row.doc_id as doc_id", "media")
    blocks = sorted(flac.pcm_blocks(media).collect(), key=lambda r: r.block)
    assert b"".join(r.pcm for r in blocks)[: blocks[1].first_sample] == blocks[0].pcm and len(blocks) > 2


def test_flac_query_digests(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in llm.queries()["op8_flac"](spark, SMALL).collect():
        payload = flac.padded(docs[r.doc_id])
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload))


ODD_NAMES = ["a b", "a.b", "a:b", "a`b", "ids?", "row"]


def with_odd_names(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(ODD_NAMES)])


def test_operators_carry_columns_of_any_name(spark, odd):
    """Blanks, dots, colons and backticks in names; values stay with their columns."""
    from tidewatch.llm import bpe, substring

    docs = with_odd_names(odd)
    for rows_ in (bpe.encode(docs, llm.tokenizer_path()), flac.store_texts(docs), substring.remove_repeats(docs), langid.identify(docs), mixing.mix(docs, keep=True), htmltext.extract(docs.withColumnRenamed("text", "html"), carry=ODD_NAMES)):
        own = rows_.select(*[rows_["row"].getField(c).alias(f"c{i}") for i, c in enumerate(ODD_NAMES)]).distinct().collect()
        assert [tuple(r) for r in own] == [tuple(range(len(ODD_NAMES)))]


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, repeats, columns of any name and an empty table pass through every stage."""
    import corpus_pipeline

    for rows_ in (with_odd_names(odd), with_odd_names(none)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows_, SMALL)
            kept = out.collect()
            names = rows_.columns if name != "BPE encoding" else [c for c in rows_.columns if c != "text"] + ["ids"]
            assert out.columns == names, name
            if rows_.isEmpty():
                assert not kept
            else:
                assert kept and all(r["a`b"] == 3 and r["a.b"] == 1 for r in kept), name
    stages = dict(corpus_pipeline.STAGES)
    docs = with_odd_names(odd)
    ids = lambda name: Counter(r.doc_id for r in stages[name](spark, docs, SMALL).collect())
    assert not {1, 2, 3, 5} & set(ids("language ID")) and ids("substring dedup") == ids("BPE encoding") == Counter(r.doc_id for r in docs.collect())
    kept = ids("n-gram Jaccard join")
    assert kept[8] == 1 and kept[9] == 0 and kept[1] == kept[2] == kept[3] == kept[None] == 1
    assert not {1, 2, 3} & set(ids("mixing sources"))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows_ = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows_ = stage(spark, rows_, SMALL)
        assert rows_.columns == docs.columns, name
    out = corpus_pipeline.run(spark, SMALL)
    assert "ids" in out.columns and 0 < out.count() <= 2 * docs.count()
