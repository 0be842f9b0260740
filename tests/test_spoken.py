"""Golden values of the rules on claims, spoken texts, names and domains; kept counts after repeated batches."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import graph as G
from tidewatch.operators import texts as T
from tidewatch.streaming import streams as ST


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,kind,expected", [
    ("GDP grew by 3.5% last quarter.", "statistical", 0.9), ("The economy grew significantly.", "factual", 0.5), ("Data shows inflation rose 5%.", "statistical", 1.0),
    ("I think maybe inflation rose 5%.", "statistical", 0.7), ("Report confirmed 500 cases.", "factual", 0.65), ("In my opinion there are 500 cases.", "factual", 0.4), ("Some text.", "factual", 0.4),
    ("According to official data shows unemployment fell.", "factual", 0.8), ("Some people were out of work.", "predictive", 0.35), ("I believe it might be so", "predictive", 0.0),
])
def test_claim_confidence(spark, text, kind, expected):
    assert one(spark, T.claim_confidence(F.lit(text), F.lit(kind))) == pytest.approx(expected)


@pytest.mark.parametrize("text,expected", [
    ("Um, so uh it is, you know, BASICALLY done .and then", ", so it is,, done. and then"), ("likely umbrella", "likely umbrella"), ("um", ""), ("", ""), (None, None), ("It rose.it fell!so", "It rose. it fell! so"),
])
def test_clean_spoken(spark, text, expected):
    assert one(spark, T.clean_spoken(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("name,expected", [
    ("Minister Benjamin Netanyahu", "Benjamin Netanyahu"), ("Dr. Jane Smith", "Jane Smith"), ("Former Prime Minister X", "X"), ("mr King Charles", "Charles"), ("Generally Known", "Generally Known"), (" Drake ", "Drake"),
    ("acting deputy minister general Lee", "general Lee"),
])
def test_plain_name(spark, name, expected):
    assert one(spark, G.plain_name(F.lit(name))) == expected


@pytest.mark.parametrize("domain,score,verdict,farm,warnings", [
    ("newsnow24.co", 0.9, "unreliable", "confirmed", 2), ("newsnow24.co", 0.3, "unreliable", "confirmed", 3), ("a.org", None, "unknown", "clean", 0), ("a.org", 0.39, "unreliable", "suspected", 1), ("a.org", 0.4, "caution", "clean", 1),
    ("a.org", 0.65, "trusted", "clean", 0),
])
def test_domain_verdict(spark, domain, score, verdict, farm, warnings):
    row = spark.range(1).select(*T.domain_verdict(F.lit(domain), F.lit(score).cast("double"))).first()
    assert (row.verdict, row.farm, len(row.warnings)) == (verdict, farm, warnings)


def test_agreement(spark):
    said = {1: [("so it is", 1.0)] * 3, 2: [("DENIED", 1.0), ("there is no evidence", 0.5)], 3: [("yes", 0.5), ("falsely so", 0.5)], 4: [("untrue", 0.2)], 5: [(None, None)], 6: [("yes", 0.6), ("yes", 0.6)]}
    rows = spark.createDataFrame([(k, *s) for k, found in said.items() for s in found], "key int, snippet string, trust double")
    got = {r.key: (r.agree, r.disagree, r.score, r.status) for r in T.verified(rows, "key").collect()}
    assert got == {1: (3, 0, 1.0, "verified"), 2: (0, 2, 0.0375, "disputed"), 3: (1, 1, 0.3875, "disputed"), 4: (0, 1, 0.23, "disputed"), 5: (1, 0, 0.65, "unverified"), 6: (2, 0, 0.72, "mixed")}


def test_table_function_equals_the_operator(spark):
    texts = ["He said it was 5% of all. It was 1,000 long or more! It will rise because of that? it will rise  because of that?", None, "", "short.", "Ünder 20 million went there. " * 3, *[f"Nr {i} will come to the town because of {i} million. " * (i % 4) for i in range(80)]]
    long = " ".join(f"Item {i} was said to come soon." for i in range(70))
    docs = spark.createDataFrame(list(enumerate([*texts, long])), "id int, body string")
    name = T.register_claims(spark)
    by_sql = spark.sql(f"SELECT d.id, c.* FROM {{docs}} d, LATERAL {name}(d.body) c", docs=docs)
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, T.claims(docs).collect()))


def test_counts_survive_a_repeated_batch(spark, tmp_path):
    changes = spark.createDataFrame([(i % 5, i, 1 if i % 3 else -1) for i in range(200)], "key int, s int, change int").withColumn("ts", F.timestamp_seconds("s"))
    stream = ST.replayed(changes)
    run = lambda: ST.count_each_batch(stream, ["key"], "change", f"{tmp_path}/counts", f"{tmp_path}/log", 3).awaitTermination()
    counts = lambda: {r.key: r.n for r in ST.maintained_counts(spark, f"{tmp_path}/counts", ["key"]).collect()}
    run()
    expected = {r.key: r.n for r in changes.groupBy("key").agg(F.sum("change").alias("n")).collect()}
    assert counts() == expected
    commits = sorted((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) >= 10
    (tmp_path / "log" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].unlink()  # as if the last batch had been written, but not noted
    run()
    assert counts() == expected
