"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tariffmill.llm import oracles
from tariffmill.llm.chat import ORACLE as CHAT_ORACLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Labelled rows of each class, at most, that the classifiers are fitted on.
QUALITY_SAMPLE, TOXIC_SAMPLE = 8_000, 2_500


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tariffmill.llm.bpe import transcode

    return transcode(table(spark, sf_dir, "documents"), tokenizer(), ("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tariffmill.llm import quality
    from tariffmill.llm.labelled import in_fold, sample_labels

    docs = table(spark, sf_dir, "documents")
    sample = sample_labels(table(spark, sf_dir, "labels"), "quality", in_fold(3, 0, 2), QUALITY_SAMPLE)
    scored = quality.score(docs, quality.train(docs, sample))
    return scored.select("doc_id", in_fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tariffmill.llm import toxicity
    from tariffmill.llm.labelled import in_fold, sample_labels

    docs = table(spark, sf_dir, "documents")
    sample = sample_labels(table(spark, sf_dir, "labels"), "toxic", in_fold(4, 0, 1, 3), TOXIC_SAMPLE)
    scored = toxicity.score(docs, toxicity.train(docs, sample), unseen=True)
    return scored.select("doc_id", in_fold(4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tariffmill.llm import pii

    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tariffmill.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tariffmill.llm.packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer(), 2048, 0, with_ids=False), 2048)


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tariffmill.llm import warc

    pages = table(spark, sf_dir, "pages")
    folder = warc.own_folder(pages, "warc")
    return warc.read_all(warc.write(pages, folder), folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tariffmill.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tariffmill.llm.pivots import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tariffmill.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


@query
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tariffmill.llm.mining import mine

    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("id") % 50 == 0).drop("positive_rank")


@query
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tariffmill.llm.fim import transform

    return transform(table(spark, sf_dir, "documents"), ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"))


@query
def op13_cutting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tariffmill.llm.cutting import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 2)


ORACLES |= {"op5_chat": CHAT_ORACLE, "op7_topk": oracles.OP7, "op9_minhash": oracles.OP9, "op10_warc": oracles.OP10, "op11_negatives": oracles.OP11, "op12_fim": oracles.OP12}
