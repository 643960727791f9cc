"""A pipeline from raw documents to packed training sequences.

Quality rules, line dedup, SimHash near-dedup, secret scan, best-fit packing.
Each stage takes the documents that its predecessor left, as written to the
shared folder, and its decisions take effect; the last returns the bins.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import byte_bpe, line_dedup, packing, quality, secrets, simhash
from kgspark.llm.shared import read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``docs`` without the rows whose ``keys`` and hash of the text are in ``rows`` (columns of keys, then the hash)."""
    rows = rows.toDF(*(f"_{k}" for k in keys), "_hash").distinct()
    cond = F.xxhash64(docs["text"]) == rows["_hash"]
    for k in keys:
        cond = cond & docs[k].eqNullSafe(rows[f"_{k}"])
    return docs.join(rows, cond, "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, each by its own verdict: also where a doc_id is null or repeated.  Null and empty texts are rejected."""
    judged = quality.quality(docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("text_hash")))
    return _without(docs, judged.where("NOT kept").select("doc_id", "lang", "source", "text_hash"), "doc_id", "lang", "source")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines go, and documents of which no word is left.  Null and empty texts stay as they are."""
    out = line_dedup.line_dedup(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _measured(out.where(F.col("text").isNull() | left))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates stays; rows equal in doc_id and text stay or go together.

    Links are confirmed, and none is left out: at least 0.8 of the five-word
    shingles that either text has are shared.  Texts without a word are one group.
    """
    found = simhash.near_duplicates(docs, words=5, similarity=0.8)
    return _without(docs, found.where("NOT kept").select("doc_id", "text_hash"), "doc_id")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, where they stand.  Null and empty texts stay as they are."""
    return _measured(secrets.redacted(docs, secrets.scan(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, n_tokens, ids, doc_ids, starts): sequences of 2,048 byte-level BPE tokens at most.  Empty texts are in none."""
    ids = byte_bpe.encode(packing.clustered(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.sequences(ids)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Estimates, forests and searches are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
