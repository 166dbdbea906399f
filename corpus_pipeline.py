"""From raw documents to packed token sequences, in five stages.

Each stage takes all that the one before it kept; the driver of a run writes its result as Parquet
and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import labels, minhash, packing, quality, secrets, toxicity
from ridgeline.session import Workspace, roots, small_batches, sweep


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.7 or more, learned from the labelled ones of docs.

    A null text is scored as an empty one and stays; rows that repeat are judged each; a text of any
    length is scored whole; an empty table gives an empty result. All columns stay.
    """
    small_batches(spark)
    model = toxicity.fit(docs, _labels(spark, sf_dir), labels.fold("doc_id", 3) != 1)
    return toxicity.reject(docs, model, 0.7)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose quality score is below 0.3, learned from the labelled ones of docs.

    Nulls, empty and long texts, repeated rows, empty tables and columns: as in drop_toxic().
    """
    small_batches(spark)
    model = quality.fit(docs, _labels(spark, sf_dir), labels.fold("doc_id", 5) != 0)
    return quality.reject(docs, model, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingle sets have a similarity of 0.8 or more: that of the least doc_id.

    Null and empty texts are near to nothing and stay, and so do rows without doc_id. Of rows that
    repeat a doc_id that of the least text stays. An empty table gives an empty result. All columns stay.
    """
    small_batches(spark)
    return minhash.deduplicate(docs, width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret; n_chars follows the text.

    A null text stays null, and so does its n_chars; rows that repeat come back as often; an empty
    table gives an empty result. All columns stay.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of at most 2048 tokens.

    A null or empty text is a piece of the end token alone; rows that repeat are packed each; a longer
    text is cut into pieces; an empty table gives an empty result. Other columns do not stay.
    """
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Trained classifiers and the search for a good packing are not for SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage has written goes when the next stage's input is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        before, made = docs, roots()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.write(docs)
            sweep(spark, made)
            work.drop(before)
    return docs
