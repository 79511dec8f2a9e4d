"""A corpus from raw documents to packed sequences: STAGES, each written as Parquet and read again by the next.

All stages read whole tables and whole texts.  Null and empty texts, null ids, ties, repeated rows, empty tables and
further columns have the results that the operators' docstrings name; further columns are left out.

toxicity drops the documents that the classifier chain rejects; line dedup cuts repeated
lines, and documents of which nothing is left; near dedup keeps the first
document of each group; mixing repeats or thins sources to their budgets; packing
deals what is there into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbre.llm.common import materialize
from timbre.llm.line_dedup import line_dedup
from timbre.llm.minhash_dedup import NearDuplicates
from timbre.llm.mixing import mix_sources
from timbre.llm.packing import pack
from timbre.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) for c in COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic stays below the threshold; the chain is fitted on the table of labels.

    Repeated rows are judged alike; a null or empty text is judged by the models' biases alone.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(toxicity(_documents(docs), labels).where("not rejected"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; those of which no word is left go, those that lost nothing stay, even without words.

    n_chars counts what is left; it is null for a null text.
    """
    out = line_dedup(_documents(docs))
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _documents(out.where(left).withColumn("n_chars", F.length("text").cast("long")))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the document with the smallest id of a group stays, with all rows that repeat it.  Documents without words stay."""
    docs = _documents(docs)
    found = NearDuplicates(docs, size=5, percent=80)
    gone = found.components().where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("g_doc"), F.col("rk").alias("g_rk")).distinct()
    here = F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("g_rk"))
    return _documents(docs.join(gone, here, "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's tempered share asks, for 0.95 of the largest entropy; a null source is one of them."""
    return _documents(mix_sources(_documents(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of the documents with their place in a bin; a document without words is one empty chunk in no bin."""
    return pack(_documents(docs))


STAGES = [("toxicity", drop_toxic), ("line dedup", cut_lines), ("near dedup", drop_near), ("mixing", mix), ("packing", pack_sequences)]

#: The stages train a model and break ties by hashes that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
