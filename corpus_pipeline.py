"""Corpus cleaning from raw documents to packed sequences, one training-data operator per stage.

Every stage but the last returns the columns of documents; run() writes each stage's rows as Parquet to the shared
folder and hands what it reads back to the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import decontam, langid, packing, pii, simhash
from sievewright.llm.common import bounded_batches, collected, table, written
from sievewright.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told; the rest keep their columns, whatever these are called.

    A null or empty text, or one without a letter, has no language and goes; ties between languages go, as their margin
    is zero; repeated rows and very long texts are judged like any others; of an empty table nothing is left.
    """
    bounded_batches(spark)
    return langid.known_only(docs, langid.fit(docs.select("doc_id", "text", "lang"), F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates, all columns with it.

    Texts without a word are one group; a row without doc_id stays only if none of its group has one; unlike texts under
    one doc_id or none all stay; rows that repeat doc_id and text count once; ties go by the text's digest; very long
    texts count in whole; of an empty table nothing is left.
    """
    bounded_batches(spark)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs, copied or with few edits.

    Null and empty texts hold no item and stay; null and empty items are ignored; repeated rows are judged alike; very
    long texts are searched in whole; without documents nothing is left, without items everything.
    """
    bounded_batches(spark)
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; no document goes, no column is added or lost.

    Null and empty texts stay as they are; repeated rows are treated alike; of spans that overlap, their union is
    replaced once; very long texts are read in whole; of an empty table nothing is left.
    """
    bounded_batches(spark)
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens: one row per piece, with its token ids.

    A null or empty text is its closing id alone; repeated rows are packed once each; very long texts become full
    sequences and a rest; columns beside doc_id and text are not carried along; an empty table gives no pieces.
    """
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("pack", pack),
]

#: Compression, trie walks and subword vocabularies have no SQL form: tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
            collected(spark)
    return docs
