"""The corpus pipeline: stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of ``documents``, whatever their names.
An empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import crf, exact_dedup, mixing, near_dedup, packing, tokens
from sparkloom.llm.store import Workspace

#: A text is rejected where no language is expected in this share of its words.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter or without a language; the model is learnt from three folds of four.

    A null or empty text has no letter and goes.  Repeated rows are judged alike and stay.
    """
    rows = docs.where(crf.fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")
    judged = crf.identify_language(docs, rows, carry=True)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest doc_id of each group of equal texts; a null id is smaller than any.

    Rows that repeat an id and its text all stay; of rows that repeat an id, only those of
    texts that it keeps.
    """
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("digest"))
    own = F.sha2(F.coalesce(docs.text, F.lit("")), 256)
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.keep) & (own == kept.digest), "left_semi")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates on five-word shingles at 80 %.

    Rows that repeat an id are one document; rows with a null id and texts without words stay.
    """
    kept = near_dedup.near_duplicates(docs, shingle=5, percent=80).where("kept").select(F.col("doc_id").alias("keep"))
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.keep), "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each row as often as the mix of sources takes it (0 to 2 times); repeated rows are decided apart."""
    plan = mixing.mix_sources(docs, weights=(3, 1, 2), share=1.5, cap=2.0, carry=True)
    return plan.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all tokens into sequences of 2048: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null ids stay null; repeated rows have places of their own.
    """
    return packing.pack(tokens.token_pieces(docs, length=2048, with_ids=False), capacity=packing.Capacity())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mixed), ("best_fit_packing", packed)]

#: SQL cannot express the stages on language, near-duplicates and sampling; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` in turn."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
