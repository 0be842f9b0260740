"""The registered queries of this subpackage: one thin query an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship
from . import bpe, fim, flac, htmltext, hyper, langid, lmscore, mixing, near, resample, substring, tokencounts, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_checkpoint_dir(ship(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=["doc_id"])
    return rows.select("row.doc_id", (~langid.in_training(F.col("row.doc_id"))).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.section_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages")).select("row.page_id", "row.url", "text", "n_chars")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lmscore.score(_table(spark, sf_dir, "documents"), targets)


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flac.store_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "row.doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "n_blocks",
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper.components_of(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def queries() -> dict:
    return {
        "op1_language": op1_language,
        "op2_bpe": op2_bpe,
        "op3_token_counts": op3_token_counts,
        "op4_html_text": op4_html_text,
        "op5_topk": op5_topk,
        "op6_mixing": op6_mixing,
        "op7_lm_score": op7_lm_score,
        "op8_flac": op8_flac,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_hyperminhash": op11_hyperminhash,
        "op12_resampling": op12_resampling,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


OP5_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": OP5_SQL}
