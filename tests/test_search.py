"""Ranked search against a plain ranker that compares every word with every word asked for."""

import random
import re

from tidewatch.operators import search as SE

SEARCHES = [["flood", "warning", "port"], ["governor"], ["a", "storm"], ["storm", "storm"]]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(docs, search, limit):
    found = []
    for name, *texts, reliability in docs:
        hits = []
        for asked in search:
            most = 2 if len(asked) >= 8 else 1 if len(asked) >= 4 else 0
            said = [(n, p, edits(w, asked)) for n, t in enumerate(texts) for p, w in enumerate(x for x in re.split(r"[^A-Za-z0-9_]+", (t or "").lower()) if x)]
            said = [h for h in said if h[2] <= most]
            if not said:
                break
            hits.append(said)
        if hits:
            typos = [min(h[2] for h in said) for said in hits]
            apart = [min([8, *(max(q - p, 1) if q >= p else p - q + 1 for n, p, _ in a for m, q, _ in b if n == m)]) for a, b in zip(hits, hits[1:])]
            found.append((-len(hits), sum(typos), sum(apart), sum(min(h[0] for h in said) for said in hits), -sum(t == 0 for t in typos), -reliability, name))
    return [(name, -n, t, p, a, -e) for n, t, p, a, e, _, name in sorted(found)[:limit]]


def test_ranking_matches_a_plain_ranker(spark):
    pick = random.Random(3)
    words = "flood floods flod warning warnin wraning port prt governor govenor gobernir a storm storms stom strm the of near Straße x".split()
    text = lambda n: None if pick.random() < 0.05 else " ".join(pick.choice(words) for _ in range(pick.randrange(n)))
    rows = [(i, text(6), text(25), i % 7) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, title string, body string, reliability int")
    got = SE.ranked(SE.postings(docs, ["title", "body"]), docs, SEARCHES, 40).collect()
    for q, search in enumerate(SEARCHES):
        mine = [(r.id, r.words, r.typos, r.proximity, r.attribute, r.exact) for r in sorted((r for r in got if r.search == q), key=lambda r: r.place)]
        assert mine == plain(rows, search, 40)


def test_words_are_found_by_their_stems(spark):
    pick = random.Random(4)
    words = sorted({"".join(pick.choice("abc") for _ in range(pick.randrange(1, 11))) for _ in range(400)})
    asked = [["abca", "abcabcab", "ab", "cccc"]]
    got = {(r.asked, r.word, r.edits) for r in SE.meant(spark.createDataFrame([(w,) for w in words], "word string"), asked).collect()}
    assert got == {(q, w, edits(w, q)) for q in asked[0] for w in words if edits(w, q) <= SE.edits_allowed(q)}
