"""The corpus pipeline: quality filter, near-dedup, redaction, mixing and tokens, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.

Defined cases, for every stage: a null text counts as an empty one, and a null doc_id, lang or source is kept as it is; repeated rows are rows of their own up to the near-dedup, which keeps one of them; an empty table gives an empty
one; extra columns pass through, whatever their names, up to the last stage. Each stage says what else it does with them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, mixing, near_copies, personal, quality
from keelson.session import materialize, release, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects, those with a score under one half. Null and empty texts are scored like others; without labels nothing is
    learned and every document stays."""
    forest = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, forest, "__quality").where(F.col("__quality") >= 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: SimHash fingerprints that differ in three bits or fewer, as op5 links them, or sets of five-word shingles of similarity 0.8 or more. It is the one with the least doc_id (nulls last); texts without
    words are copies of each other."""
    return near_copies.keep_first(docs, prints=True)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes a mark of its kind in the place of each piece of personal data. Null texts stay null, and texts without any as they are."""
    return personal.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix takes them. Documents without words have no size and go, and a null source is a source."""
    return mixing.repeat_mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller parts and a smaller dictionary of common pieces than op10's: executors still hold what the stages before have grown to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), most=100_000, merged_parts=1)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier, the bootstrapped patterns and the tokenizer can't be put in SQL; tests hold each stage and the rows of run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and deleted when the next one is written. What the last stage reads stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage{number}")
            if before is not None:
                release(before)
            before = docs
    return docs
