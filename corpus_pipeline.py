"""A training-corpus pipeline of the operators of ``tidewatch.llm``.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, langid, mixing, near, substring
from tidewatch.llm.queries import tokenizer_path
from tidewatch.session import ensure_checkpoint_dir, ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or unlike every language that was learnt, go.

    Rows are judged one by one, also where they repeat; without a labelled document all go.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id.

    Documents without words are no one's duplicates and all stay; rows without a
    doc_id stay unless their words are like another row's, and come last in their group.
    """
    ensure_checkpoint_dir(spark)
    return near.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur more than once are removed from the texts; all rows stay, texts without repeats as they are."""
    return substring.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks: none to two times, one a source in part.

    Documents without words go; a null source is a source; documents come by shard, shuffled inside it.
    """
    ensure_checkpoint_dir(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (none for a null text), with its columns but the text."""
    rows = bpe.encode(docs, tokenizer_path())
    return rows.select(*[rows["row"].getField(c).alias(c) for c in docs.columns if c != "text"], "ids")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixture),
    ("BPE encoding", encoded),
]

#: Several stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    ensure_checkpoint_dir(ship(spark))
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
