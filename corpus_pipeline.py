"""A corpus pipeline of five operators, each stage written as Parquet and read again by the next.

Documents in a language that the model knows; one document of each exact text; one of each group of near copies;
none with a benchmark passage; encoded. Every stage but the last returns rows as they came, all columns of them, with
columns of any name; an empty table gives an empty one. Each says below what it does with nulls, ties and repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.bpe import bpe_digests
from seqloom.llm.decontaminate import drop_leaks
from seqloom.llm.exact_dedup import drop_copies
from seqloom.llm.langid import known_languages
from seqloom.llm.ngram_join import one_of_each
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.shared import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the model doesn't reject. Null and empty texts and those without a letter go; repeated rows share
    their fate; a null doc_id or lang makes no difference, but such a row isn't learned from. Without rows to learn
    from all go."""
    return known_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one text that with the largest doc_id; of rows repeated with one doc_id and text one. A null text
    counts as empty, a null doc_id as smaller than any."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id is the smallest that links of similarity reach. Null and empty texts, texts without words and
    rows without doc_id have no links and stay; rows with one doc_id stay or go together."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item in their text; null items count for nothing. Null and empty texts and rows without
    doc_id stay; rows with one doc_id go if one of them has an item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each row. A null text counts as empty; repeated rows and
    null doc_ids give rows of their own."""
    return bpe_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]

#: SQL can express neither the language model nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. The result of the last is not written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
