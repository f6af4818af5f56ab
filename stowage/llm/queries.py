"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import batches

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    batches.small_batches(spark)
    return batches.read(spark, sf_dir, table, *columns)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from stowage.llm.multiindex import search

    return search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents", "doc_id", "text"), 24)


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stowage.llm.bpe import Vocabulary, round_trip

    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.ngram_join import similar

    return similar(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.templates import contaminated

    return contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.pii import default_model, detect

    return detect(read(spark, sf_dir, "documents", "doc_id", "text"), default_model())


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stowage.llm.binary_records import binary_output

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    return binary_output(read(spark, sf_dir, "documents", "doc_id", "text"), definition)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.langid import identify

    return identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.quality import assess

    return assess(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from stowage.llm.licenses import scan_sql
    from stowage.llm.sharding import shard_sql

    return {"op1_license_scan": scan_sql(), "op3_jump_sharding": shard_sql(24)}
