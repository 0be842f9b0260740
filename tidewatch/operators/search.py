"""Ranked search by a positional inverted table and rules that are applied one after the other.

``postings`` and ``neighbours`` are tables of their own that may be written once and searched often.  A word
with typing errors is found by the strings that it and a query's word become when letters are left
out: two words so many edits apart share one, so that looking them up is a join on equal strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters from which a word may be one and two edits away; the distance of words that stand further apart or in different attributes.
ONE_EDIT, TWO_EDITS, APART = 4, 8, 8


def edits_allowed(word: str) -> int:
    return 2 if len(word) >= TWO_EDITS else 1 if len(word) >= ONE_EDIT else 0


def postings(docs: DataFrame, attributes: list[str]) -> DataFrame:
    """(id, attribute, position, word): every word of every attribute; attributes count from 0, in the order of their weight."""
    told = [F.struct(F.lit(n).alias("attribute"), F.filter(F.split(F.lower(c), r"\W+"), lambda w: F.length(w) > 0).alias("words")) for n, c in enumerate(attributes)]
    rows = docs.select("id", F.explode(F.array(*told)).alias("a"))
    return rows.select("id", "a.attribute", F.posexplode("a.words").alias("position", "word"))


def _shorter(words: Column) -> Column:
    """The strings that words become without one of their characters."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), without)))


def neighbours(words: DataFrame, edits: Column) -> DataFrame:
    """Words with (word, stem): the word itself, and what is left without up to so many (0, 1 or 2) of its characters."""
    own = F.array("word")
    once = F.when(edits > 0, _shorter(own)).otherwise(F.array().cast("array<string>"))
    twice = F.when(edits > 1, _shorter(once)).otherwise(F.array().cast("array<string>"))
    return words.select("*", F.explode(F.array_distinct(F.concat(own, once, twice))).alias("stem"))


def meant(vocabulary: DataFrame, searches: list[list[str]]) -> DataFrame:
    """(word) -> (asked, word, edits): the words of the vocabulary within the edits of each word asked for.

    A word is indexed by as many left-out characters as the words of about its length that are asked for allow.
    """
    asked = {w.lower(): edits_allowed(w) for s in searches for w in s}
    rows = vocabulary.sparkSession.createDataFrame(list(asked.items()), "asked string, most int")
    reach = F.lit(0)
    for edits in (1, 2):
        sizes = [len(w) for w, most in asked.items() if most == edits]
        if sizes:
            reach = F.when(F.length("word").between(min(sizes) - edits, max(sizes) + edits), edits).otherwise(reach)
    stems = neighbours(rows.withColumnRenamed("asked", "word"), F.col("most")).withColumnRenamed("word", "asked")
    met = neighbours(vocabulary, reach).join(stems, "stem").select("asked", "word", "most").distinct()
    return met.withColumn("edits", F.levenshtein("asked", "word")).filter(F.col("edits") <= F.col("most")).drop("most")


def ranked(table: DataFrame, facts: DataFrame, searches: list[list[str]], limit: int, sort: list[str] | None = None) -> DataFrame:
    """The best rows of each search: (search, id, place, words, typos, proximity, attribute, exact).

    ``table`` are postings and ``facts`` has (id, reliability) and what ``sort`` names, greatest first.  Rules, each
    among those equal by all before: most leading words of the search that were found (its first one must be);
    fewest edits; least sum of distances of neighbouring words, in one attribute, one more where they stand the other way
    round; least sum of the words' first attributes; ``sort``; most words found as they were written; reliability; id.
    """
    spark, most = table.sparkSession, max(len(s) for s in searches)
    asked = spark.createDataFrame([(q, nth, w.lower()) for q, s in enumerate(searches) for nth, w in enumerate(s)], "search int, nth int, asked string")
    hits = table.join(asked.join(meant(table.select("word").distinct(), searches), "asked"), "word").select("search", "id", "attribute", "position", "nth", "edits")
    so_far = Window.partitionBy("search", "id", "attribute").orderBy("position", "nth", "edits").rowsBetween(Window.unboundedPreceding, 0)
    for c in range(most):
        hits = hits.withColumn(f"at{c}", F.last(F.when(F.col("nth") == c, F.col("position")), ignorenulls=True).over(so_far))
    pick = lambda c, column: F.min(F.when(F.col("nth") == c, F.col(column)))
    ahead = lambda c: F.when((F.col("nth") == c + 1) & F.col(f"at{c}").isNotNull(), F.greatest(F.col("position") - F.col(f"at{c}"), F.lit(1)))
    back = lambda c: F.when(F.col("nth") == c, F.col("position") - F.col(f"at{c + 1}") + 1)
    per = [pick(c, "edits").alias(f"edits{c}") for c in range(most)] + [pick(c, "attribute").alias(f"attribute{c}") for c in range(most)]
    per += [F.min(F.least(ahead(c), back(c))).alias(f"near{c}") for c in range(most - 1)]
    found = hits.groupBy("search", "id").agg(*per)
    leading = F.lit(most)
    for c in reversed(range(most)):
        leading = F.when(F.col(f"edits{c}").isNull(), c).otherwise(leading)
    found = found.withColumn("words", leading).filter("words > 0")
    total = lambda values, less=0: sum((F.when(F.col("words") > c + less, v).otherwise(0) for c, v in enumerate(values)), F.lit(0))
    scored = found.select(
        "search", "id", "words", total([F.col(f"edits{c}") for c in range(most)]).alias("typos"),
        total([F.least(F.coalesce(f"near{c}", F.lit(APART)), F.lit(APART)) for c in range(most - 1)], 1).alias("proximity"),
        total([F.col(f"attribute{c}") for c in range(most)]).alias("attribute"), total([(F.col(f"edits{c}") == 0).cast("int") for c in range(most)]).alias("exact"),
    )
    order = [F.desc("words"), F.asc("typos"), F.asc("proximity"), F.asc("attribute"), *[F.desc(c) for c in sort or []], F.desc("exact"), F.desc("reliability"), F.asc("id")]
    best = scored.join(facts.select("id", "reliability", *(sort or [])), "id").withColumn("place", F.row_number().over(Window.partitionBy("search").orderBy(*order)))
    return best.filter(F.col("place") <= limit).select("search", "id", "place", "words", "typos", "proximity", "attribute", "exact")
