"""Corpus pipeline: from ``documents`` to token ids of what is worth training on.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns documents' columns, the last one token ids. ``run`` writes every stage's
rows as Parquet to the shared folder and rereads them.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
tables and extra columns of any name (which it drops); what becomes of such rows is in
its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm._common import materialize
from cairn.llm.bpe import encode_documents
from cairn.llm.decontamination import remove_contaminated
from cairn.llm.jaccard import drop_similar
from cairn.llm.linededup import dedup_lines
from cairn.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those without 50 words (so all null and empty texts), repetitive ones, outliers of their language and source. Null lang and source are values of their own; repeated rows are judged alike."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them, the one with the largest doc_id; a null doc_id is below all others, and rows of one doc_id keep the line each."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: by the smallest doc_id, null last, then by text; of rows that repeat both, one. Rows without a word stay."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts and items hold nothing."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids, row by row; null and empty texts have no ids."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("decoded")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("tokenize", tokenize)]

#: Iterated covariance estimates and BPE merges are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
