"""Queries over the test tables, one an operator, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, hmm, langid, license_scan, line_dedup, minhash, mixing, pii, secret_scan, toxicity, vector_codes, whitening
from .common import documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "repeats", "part")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_summary(documents(spark, sf_dir))


def op3_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand at <source>/<hundreds of the id>/<id>."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return license_scan.scan(documents(spark, sf_dir).withColumn("path", path))


#: The same path in SQL.
_PATH_SQL = "concat_ws('/', coalesce(source, 'unknown'), CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), CAST(doc_id AS VARCHAR))"


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(documents(spark, sf_dir), key="key of the test tables")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_mixing, op2_line_dedup, op3_hmm_scoring, op4_near_duplicates, op5_decontamination, op6_license_scan, op7_neighbours, op8_toxicity, op9_surrogates, op10_language_id, op11_vector_codes, op12_secret_scan, op13_whitening, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.SQL, "op4_near_duplicates": minhash.SQL, "op6_license_scan": license_scan.sql(_PATH_SQL), "op11_vector_codes": vector_codes.sql()}
