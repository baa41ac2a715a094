"""A corpus pipeline over the documents table: language, lines, near duplicates, benchmark passages, mixture.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of docs, whatever they are besides
doc_id, text, lang, source and n_chars. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.llm import decontam, langid, line_dedup, minhash, mixing
from readqc.llm.common import documents, remainder
from readqc.store import scope, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and texts without a letter. Learns from all folds but 2, as the query.

    Null lang values teach nothing; rows that share an id or are equal are judged one by one; without any lang value no
    language is known and every row goes.
    """
    model = langid.train(docs.filter(remainder(F.col("doc_id"), 4) != 2).select("text", "lang"))
    judged = langid.predict(docs.select(F.struct("*").alias("kept"), "text"), model)
    return judged.filter(F.col("lang_pred") != "und").select("kept.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of 40 characters and more that at least 5 documents hold, but for the largest document; text and n_chars follow.

    A null text becomes an empty one. Repeated rows lose the same lines; rows that share an id count as one document, and
    rows without id as none.
    """
    held = docs.select(F.struct("*").alias("kept"), "doc_id", "text")
    out = line_dedup.dedup_lines(held).select("kept", "kept_text")
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near duplicates: shingles of five words, similarity 0.8.

    Empty texts are near nothing and stay; rows that share the kept id all stay, as do rows without id.
    """
    return minhash.drop_near_duplicates(docs, width=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, with all rows of their id. Null and empty texts and items match nothing; rows without id go only if one of them matches."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, with how often they are repeated and the words of a further partial copy.

    Null and empty texts take no part; a null source is a source; of equal rows at the cut some are taken.
    """
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture)]

#: SQL has no expression for the language, edit distance and sampling stages; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents. What a stage stores for itself is deleted after it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
