"""Threads of reports against a plain loop over all pairs of a report and a thread, in batch and as a stream."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Row

from tidewatch.operators import threads as TH
from tidewatch.streaming import streams as ST

SCHEMA = "id long, created_at timestamp, title string, category string, country_code string, region string, tags array<string>"


def made(n, seed):
    pick, start, rows = random.Random(seed), dt.datetime(2024, 1, 1), []
    some = lambda words, none=0.1: None if pick.random() < none else pick.choice(words)
    for i in range(n):
        start += dt.timedelta(seconds=pick.choice([0, 30, 200, 2000, 20000]))
        title = some([f"{a} {b} near {c}" for a in ("Flood", "Große Flut", "flood!") for b in ("hits", "warning") for c in ("Port A", "Port B", "the coast")])
        tags = some([["a", "b"], ["b", "c", "d"], [], ["a", None, "b", "c"], ["e", "e", "f"]])
        rows.append((i, start, title, some(["flood", "storm", "war"]), some(["AA", "BB"]), some(["R1", "R2", "R3"]), tags))
    return rows


def grams(title):
    out = set()
    for run in re.findall("[a-z0-9]+", (title or "").lower()):
        padded = "  " + run + " "
        out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return out


def loop(rows, scope):
    """Members of every thread are kept whole; tags are gathered anew from the members of earlier cycles."""
    threads, placed = [], {}
    cycle = lambda at: int(at.replace(tzinfo=dt.timezone.utc).timestamp()) // 300
    for row in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        name, at, title, category, country, region, tags = row
        best = None
        for members in threads:
            first = members[0]
            if scope and first[4] != country or max(m[1] for m in members) < at - dt.timedelta(hours=12):
                continue
            known = set(first[6] or []) | {t for m in members if cycle(m[1]) < cycle(at) for t in m[6] or []}
            shared = len({t for t in tags or [] if t is not None} & known)
            score = min(0.4, shared * 0.1) if shared >= 2 else 0.0
            score += 0.2 if category and category == first[3] else 0
            score += 0.15 if country and country == first[4] else 0
            score += 0.1 if region and region == first[5] else 0
            if score > 0.1:
                a, b = grams(title), grams(first[2])
                alike = len(a & b) / len(a | b) if a | b else 0
                score += alike * 0.3 if alike >= 0.35 else 0
            if score >= 0.3 and (best is None or score > best[0]):
                best = (score, members)
        if best:
            best[1].append(row)
            placed[name] = (best[1][0][0], round(best[0], 3))
        else:
            threads.append([row])
            placed[name] = (name, 1.0)
    return placed


def found(frame):
    return {r.id: (r.thread, r.relevance) for r in frame.collect()}


@pytest.mark.parametrize("scope", [(), ("country_code",)])
def test_threads_match_a_loop(spark, scope):
    rows = [*made(700, 5), (9000, None, "no time", "war", "AA", "R1", [])]
    expected = loop(rows, scope)
    got = found(TH.assigned(spark.createDataFrame(rows, SCHEMA), scope))
    assert got.keys() == expected.keys() and 1 < len({t for t, _ in got.values()}) < 600
    for name, (thread, relevance) in expected.items():
        assert got[name][0] == thread and got[name][1] == pytest.approx(relevance, abs=1.1e-3)


def test_streamed_threads_equal_batch(spark):
    rows = spark.createDataFrame(made(300, 6), SCHEMA)
    assert found(ST.run_available(ST.threads_of(ST.replayed(rows, "created_at")))) == found(TH.assigned(rows))


def test_state_survives_writing(spark):
    rows, whole, cut = made(200, 7), TH.Walk(), TH.Walk()
    for name, at, *facts in rows:
        micros = int(at.timestamp() * 1_000_000)
        assert whole.place(micros, name, *facts) == cut.place(micros, name, *facts)
        cut = TH.Walk(cut.state())


def test_no_reports_no_threads(spark):
    assert TH.assigned(spark.createDataFrame([], SCHEMA)).count() == 0
    assert Row(n=0) == spark.createDataFrame([Row(n=TH.assigned(spark.createDataFrame([], SCHEMA), ()).count())]).first()
