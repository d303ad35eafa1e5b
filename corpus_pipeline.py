"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

1. quality rules: documents that the rules or the classifier reject go; the model is trained on sf_dir's labels.
2. n-gram Jaccard join: one document of each group of near copies stays, the one of the smallest doc_id.
3. PII: the texts are sanitised; no document goes.
4. mixing to target weights: documents are taken, up to three times, until their source's target is met.
5. byte-level BPE: the texts are encoded, decoded again, and the round trip is checked by digest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, jaccard, mixing, pii, quality
from keyloom.llm.common import Scratch, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass. A null text has no words and is rejected."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.keep_one(docs)


def pii_sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.sanitise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256, round_trip) of every row."""
    ship(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    coded = bpe.round_trip(rows, path, pattern)
    decoded = F.sha2("decoded", 256)
    return coded.select("doc_id", "source", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("pii_sanitise", pii_sanitise),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Trained models and token ids have no SQL form: the rows are tested against a brute-force run of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between them is stored in the shared folder: a stage's table goes when the
    next one is written, the last one when the driver exits."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    scratch, before = Scratch(spark), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
