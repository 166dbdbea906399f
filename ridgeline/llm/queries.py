"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, chat, labels, media, minhash, oracle, packing, quality, secrets, topk, toxicity, warc
from ridgeline.session import Workspace

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to web archives, and the archives read back."""
    archives = Workspace(spark, "warc").write(warc.write(_table(spark, sf_dir, "pages")))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _judged(scored: DataFrame, parts: int, held: int, least: float) -> DataFrame:
    out = F.coalesce(labels.fold("doc_id", parts) == held, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; every fifth doc_id by crc32 is never learned from."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), labels.fold("doc_id", 5) != 0)
    return _judged(quality.score(docs, model), 5, 0, 0.3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; every third doc_id by crc32 is never learned from."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), labels.fold("doc_id", 3) != 1)
    return _judged(toxicity.tag(docs, model), 3, 1, 0.7)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and their decoded texts, as counts and digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents: counts and places of the base kinds and of the others."""
    return secrets.summary(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, rendered and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    return chat.read_back(chat.format_events(chat.events_of_turns(rows.unionByName(extra)), interleaved=False))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as media containers and read back by their sample tables."""
    return media.read_back(media.store(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    own = (op1_minhash, op2_warc, op3_quality, op4_toxicity, op5_bpe, op6_secrets, op7_packing, op8_chat, op9_topk, op10_media)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
