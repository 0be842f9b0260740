"""Operators on texts and transcripts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as W
from ..functions import text as X
from ..functions.classify import ascii_words


def names(docs: DataFrame, pattern: str) -> DataFrame:
    """Distinct runs of ASCII letters in each text that match a pattern in full, a row each."""
    runs = F.filter(F.split("body", "[^A-Za-z]+"), lambda w: w.rlike(f"^(?:{pattern})$"))
    return docs.select("id", F.explode(F.array_distinct(runs)).alias("name"))


def clean_spoken(text: Column) -> Column:
    """Spoken text without filler words, with one blank between words, none before a mark and one after the end of a sentence."""
    for pattern in W.FILLERS:
        text = F.regexp_replace(text, ascii_words(f"(?i){pattern}"), " ")
    text = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s{2,}", " ")), r"\s([.,!?;:])", "$1")
    return F.regexp_replace(text, r"([.!?])\s*([a-z])", "$1 $2")


def claims(docs: DataFrame) -> DataFrame:
    """Sentences that claim something, by five families of patterns: each text's first ones, without repeats, with what stands around them."""

    def family(kind: str, pattern: str) -> Column:
        sentences = F.regexp_extract_all("body", F.lit(ascii_words(pattern)), F.lit(1))
        return F.transform(sentences, lambda x: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("claim")))

    found = [family(*rule) for rule in W.CLAIM_RULES]
    c = docs.select("id", "body", F.posexplode(F.concat(*found)).alias("at", "c")).select("id", "body", "at", "c.*")
    c = c.filter(F.length("claim").between(W.CLAIM_LEAST, W.CLAIM_MOST)).withColumn("same", F.regexp_replace(F.lower("claim"), r"\s+", " "))
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("id", "same").orderBy("at"))).filter("nth = 1")
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("at"))).filter(F.col("place") <= W.CLAIMS)
    begin = F.instr("body", F.col("claim"))
    context = F.substring("body", F.greatest(begin - W.CLAIM_CONTEXT, F.lit(1)), F.least(begin - 1, F.lit(W.CLAIM_CONTEXT)) + F.length("claim") + W.CLAIM_CONTEXT)
    return c.select("id", "place", "kind", "claim", context.alias("context"))


class ExtractClaims:
    """A table function: the claims of a text as ``claims`` finds them, in order; none of a null text."""

    def __init__(self):
        self.rules = [(kind, re.compile(pattern, re.ASCII)) for kind, pattern in W.CLAIM_RULES]

    def eval(self, text: str):
        seen, blank = set(), " \t\n\x0b\f\r"
        for kind, pattern in self.rules:
            for found in pattern.finditer(text or ""):
                claim = found.group(1).strip(blank)
                same = re.sub(r"\s+", " ", claim.lower(), flags=re.ASCII)
                if not W.CLAIM_LEAST <= len(claim) <= W.CLAIM_MOST or same in seen or len(seen) == W.CLAIMS:
                    continue
                seen.add(same)
                begin = text.index(claim)
                yield len(seen), kind, claim, text[max(0, begin - W.CLAIM_CONTEXT) : begin + len(claim) + W.CLAIM_CONTEXT]


def register_claims(spark: SparkSession, name: str = "extract_claims") -> str:
    """Makes the table function known to SQL: ``FROM docs, LATERAL extract_claims(docs.body)``."""
    spark.udtf.register(name, F.udtf(ExtractClaims, returnType="place int, kind string, claim string, context string", useArrow=True))
    return name


def claim_confidence(text: Column, kind: Column) -> Column:
    """How likely a text is a claim that can be checked, 0 to 1: numbers, sources and firm words add, hedges and opinions take away."""
    when = lambda hit, worth: F.when(hit, worth).otherwise(0)
    total = F.lit(W.CLAIM_BASE)
    for pattern, worth in W.CLAIM_POINTS:
        total = total + when(F.lower(text).rlike(pattern), worth)
    for label, worth in W.CLAIM_KINDS.items():
        total = total + when(kind == label, worth)
    (short, less), (long, more) = W.CLAIM_SHORT, W.CLAIM_LONG
    total = total + when(F.length(text) < short, less) + when(F.length(text) > long, more)
    return F.least(F.lit(100), F.greatest(F.lit(0), total)) / 100


def verified(snippets: DataFrame, key: str) -> DataFrame:
    """(key, snippet, trust) -> how far what others say agrees with a claim: a row a claim with its counts, score and status.

    A snippet disagrees if it says a word of contradiction; a null one agrees, and a null trust is 0.5.
    """
    contra = F.lit(False)
    for word in W.CONTRADICTIONS:
        contra = contra | F.contains(F.lower("snippet"), F.lit(word))
    said = snippets.select(key, (~F.coalesce(contra, F.lit(False))).alias("agrees"), F.coalesce("trust", F.lit(0.5)).alias("trust"))
    g = said.groupBy(key).agg(F.count_if("agrees").alias("agree"), F.count_if(~F.col("agrees")).alias("disagree"), F.sum(F.when(F.col("agrees"), F.col("trust")).otherwise(-0.5 * F.col("trust"))).alias("total"))
    n = F.col("agree") + F.col("disagree")
    g = g.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.3 + F.col("total") / n * 0.7)), 6)).drop("total")
    status = F.when((F.col("agree") >= 3) & (F.col("score") >= 0.7), "verified").when(F.col("disagree") >= 2, "disputed").when((n >= 2) & (F.col("score") >= 0.5), "mixed")
    return g.withColumn("status", status.when(F.col("disagree") >= 1, "disputed").otherwise("unverified"))


def domain_verdict(domain: Column, reliability: Column) -> list[Column]:
    """What is said of a domain: verdict, confidence that it is a farm, and warnings."""
    farm, low, medium = domain.isin(W.CONTENT_FARMS), reliability < 0.4, reliability < 0.65
    verdict = F.when(farm, "unreliable").when(reliability.isNull(), "unknown").when(low, "unreliable").when(medium, "caution").otherwise("trusted")
    shown = F.format_string("%.2f", reliability)
    told = [
        F.when(farm, F.concat(domain, F.lit(" is on the list of known content farms"))), F.when(farm, F.lit("Its texts are likely machine-made and unreliable")),
        F.when(low, F.concat(F.lit("Low reliability ("), shown, F.lit("): a poor source"))).when(medium, F.concat(F.lit("Moderate reliability ("), shown, F.lit("): check claims elsewhere"))),
    ]
    return [verdict.alias("verdict"), F.when(farm, "confirmed").when(low, "suspected").otherwise("clean").alias("farm"), F.array_compact(F.array(*told)).alias("warnings")]


def scenes(segments: DataFrame, gap: int) -> DataFrame:
    """Runs of one speaker without a long pause: gaps and islands."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = (F.coalesce(F.col("start_s") - F.lag("end_s").over(w) > gap, F.lit(False))) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    marked = segments.withColumn("new", new.cast("int")).withColumn("scene", F.sum("new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return marked.groupBy("conv_id", "scene").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.first("speaker").alias("speaker"), text.alias("text"))


def trade_amounts(titles: DataFrame) -> DataFrame:
    number = F.regexp_extract("title", r"\$([0-9.]+)([BMK])", 1).cast("double")
    unit = F.regexp_extract("title", r"\$([0-9.]+)([BMK])", 2)
    factor = F.when(unit == "B", 1e9).when(unit == "M", 1e6).otherwise(1e3)
    return titles.withColumn("origin", F.trim(F.get(F.split("title", "→"), F.lit(0)))).withColumn("amount", F.round(number * factor, 2))


def full_text(docs: DataFrame, words: list[str], prefix: str | None = None) -> DataFrame:
    """Documents with all of the words, and a word with the prefix."""
    tokens = F.split(F.lower("body"), r"\W+")
    hit = F.size(F.array_except(F.array(*map(F.lit, words)), tokens)) == 0
    if prefix:
        hit = hit & F.exists(tokens, lambda t: t.startswith(prefix))
    return docs.filter(hit)


def ranked_search(docs: DataFrame, words: list[str], limit: int, k: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over an inverted table; a query word also finds words one edit away if it has four letters, two if it has eight."""
    asked = [(w, 2 if len(w) >= 8 else 1 if len(w) >= 4 else 0) for w in words]

    least, longest = min(len(w) - most for w, most in asked), max(len(w) + most for w, most in asked)

    def read(tokens: Column) -> Column:
        """The number of words, and those that are meant by one that is asked for: told apart in their row, and only hits are exploded."""
        some = F.filter(tokens, lambda w: F.length(w).between(least, longest))
        near = lambda q, most: F.transform(F.filter(some, lambda w: F.length(w).between(len(q) - most, len(q) + most) & (F.levenshtein(w, F.lit(q)) <= most)), lambda w: F.struct(F.lit(q).alias("q"), F.levenshtein(w, F.lit(q)).alias("distance")))
        return F.struct(F.size(F.filter(tokens, lambda w: F.length(w) > 0)).cast("long").alias("size"), F.concat(*[near(q, most) for q, most in asked]).alias("hits"))

    # a text is split once, as the argument of a function
    split = F.element_at(F.transform(F.array(F.split(F.lower("body"), r"\W+")), read), 1)
    told = docs.filter("body is not null").select("id", split.alias("r")).select("id", "r.size", "r.hits").filter("size > 0")
    size = told.groupBy("id").agg(F.sum("size").alias("size"))
    totals = size.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    hits = told.select("id", F.explode("hits").alias("h")).groupBy("id", "h.q", "h.distance").agg(F.count("*").alias("n"))
    hits = hits.groupBy("id", "q").agg(F.sum(F.col("n") / (1 + F.col("distance"))).alias("tf"))
    found = hits.groupBy("q").agg(F.count("*").alias("df"))
    scored = hits.join(found, "q").join(size, "id").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("size") / F.col("mean")))
    return scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _embed(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for words in batch["words"]:
                v = np.zeros(size)
                for word, n in zip(*np.unique(list(words), return_counts=True)):
                    for seed in (5381, 52711, 648391):  # three string hashes of the shift-and-add kind
                        h = seed
                        for c in word.encode():
                            h = (h * 33 + c) & 0xFFFFFFFF
                        v[h % size] += (1 if h & 0x80000000 else -1) * math.log1p(n)
                norm = math.sqrt(float(v @ v))
                out.append((v / norm if norm else v).tolist())
            yield pd.DataFrame({"id": batch["id"], "embedding": out})

    return run


def hashed_embedding(docs: DataFrame, size: int) -> DataFrame:
    """Signed feature hashing of log term counts, with unit length; zero for a text without words."""
    words = F.filter(F.split(F.lower(F.coalesce("body", F.lit(""))), r"\W+"), lambda w: F.length(w) >= 3)
    return docs.select("id", words.alias("words")).mapInPandas(_embed(size), "id long, embedding array<double>")
