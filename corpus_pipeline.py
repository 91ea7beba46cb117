"""A training-corpus pipeline over whole documents.

Toxic documents go, then low-quality ones; of each near-duplicate component one document stays;
personal data is replaced; what is left is packed into token sequences.  All stages but
the last return the columns of ``documents``, extra ones too.  An empty table passes through all stages; a
document with a null text counts as empty text, is linked with nothing and packs as its closing
id alone.  Of repeated rows of one doc_id all stay or go.  Very long texts count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffmill.llm import neardup, packing, pii, quality, toxicity
from tariffmill.llm.common import materialise
from tariffmill.llm.labelled import in_fold, sample_labels
from tariffmill.llm.queries import QUALITY_SAMPLE, TOXIC_SAMPLE, tokenizer


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = sample_labels(_labels(spark, sf_dir), "toxic", in_fold(4, 0, 1, 3), TOXIC_SAMPLE)
    return toxicity.keep(docs, toxicity.train(docs, sample))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = sample_labels(_labels(spark, sf_dir), "quality", in_fold(3, 0, 2), QUALITY_SAMPLE)
    return quality.keep(docs, quality.train(docs, sample))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return redacted.withColumn("n_chars", F.coalesce(size, "n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, tokenizer(), with_ids=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]
#: Trained models and hashed searches have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage_{name}")
    return docs
