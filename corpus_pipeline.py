"""The corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, secret redaction and
tokenization. Every stage reads what the one before wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, decontaminate, near_dedup, quality, secrets
from quillspark.llm.common import remove, scope, shared_dir, table

# Every stage judges each row by its own text: rows of a null doc_id, or of one that other rows have too, are told apart by
# their texts. Columns beside those of documents are kept whatever their names, and an empty table gives an empty one.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep. Null and empty texts fail; null languages and sources are groups of their
    own; repeated rows have one verdict."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id, nulls last; of rows equal in doc_id and
    text any one. Texts without words, null ones too, are one class."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none; repeated rows stay or go together."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars put right; null texts stay null."""
    return secrets.redact(docs)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit) of every row; null texts have no tokens."""
    import public_tokenizers as P

    out = byte_bpe.encode_column(docs.select("doc_id", "lang", "source", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("tokenization", tokenization),
]

#: The last stage has no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables go once it is written, and its input once the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scope(spark) as own:
            out = f(spark, docs, sf_dir)
            out.write.parquet(path)
            own.drop()
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
