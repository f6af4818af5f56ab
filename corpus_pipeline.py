"""A training corpus from documents: five stages of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next one's ``docs``. All but the
last keep the columns of ``documents``.

No SQL can express the stages, so ``ORACLE_SQL`` is None and the tests hold
``run`` against brute force.

Of odd rows, whatever stage they come to: null and empty texts, and texts
without a letter, are of no language and go in the first stage. A null doc_id
makes a document of its own in every stage. Rows that are equal in id and text
are one document behind the second stage; rows that share an id alone stay
apart. Texts of any length are read whole. An empty table passes through all
stages and gives no rows. Columns beyond those of ``documents`` are not read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stowage.llm import langid, ngram_join, pii, templates
from stowage.llm.batches import read, small_batches, stored
from stowage.llm.bpe import Vocabulary, encode_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects, and those without a letter; gives those without a language the one found."""
    small_batches(spark)
    return langid.accepted(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the smallest doc_id; rows without a doc_id and texts without a word are in no group."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs; an empty benchmark drops none."""
    small_batches(spark)
    return templates.decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each piece of personal data, and the new length in n_chars; null texts stay null."""
    small_batches(spark)
    return pii.redact(docs, pii.default_model())


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts: doc_id, lang, source, ids; a null text has no ids."""
    small_batches(spark)
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encode_documents(docs, vocabulary, ("doc_id", "lang", "source"))


STAGES = [
    ("language", identify_language),
    ("near_copies", join_near_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("encode", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
