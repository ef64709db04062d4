"""A training corpus from ``documents`` in five stages, each over all that the one before it kept.

Toxic documents go; lines that many documents repeat go from all but one; of each
group of near-duplicates one document stays; documents that leak benchmark items
go; the rest is encoded.  Each stage's rows are written to the shared folder and
read again, so a lost executor costs no more than the current stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.common import Scratch, drop_side_tables, table
from statuta.llm.decontaminate import drop_leaking
from statuta.llm.line_dedup import drop_lines
from statuta.llm.near_dedup import drop_near_duplicates
from statuta.llm.pieces import encode_documents, model_path
from statuta.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below one half."""
    with Scratch(spark, "toxic") as scratch:
        return drop_toxic(docs, table(spark, sf_dir, "labels"), scratch)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines; n_chars follows the text."""
    with Scratch(spark, "lines") as scratch:
        out = drop_lines(docs, scratch)
        return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of linked ones."""
    with Scratch(spark, "near") as scratch:
        return drop_near_duplicates(docs, scratch)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no benchmark item."""
    with Scratch(spark, "leaks") as scratch:
        return drop_leaking(docs, table(spark, sf_dir, "benchmark"), scratch)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32, and whether decoding gives the text back."""
    with Scratch(spark, "pieces") as scratch:
        return scratch.keep(encode_documents(docs, scratch, model_path()))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: Trained scores and links by shingles can't be told in SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:  # the last stage's result is written already
                docs = scratch.put(docs)
            drop_side_tables(spark)
    return docs
