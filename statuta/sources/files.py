"""Readers: text and Markdown files, query lists, stored tables, word-processor documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def check_file(spark: SparkSession, path: str) -> None:
    """Through Hadoop's file systems, so any store will do."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no such file: {path}")
    if fs.getFileStatus(p).isDirectory():
        raise ValueError(f"not a file: {path}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) per file, with newlines of all kinds as one.  A file that is no UTF-8 makes the job fail, as it is read lazily."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("c"))
    text = F.when(F.expr("is_valid_utf8(string(c))"), F.expr("string(c)")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
    return raw.select("path", F.regexp_replace(text, "\r\n?", "\n").alias("text"))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The same for one file that must exist."""
    check_file(spark, path)
    return read_documents(spark, path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown) of files that are not blank."""
    return read_document(spark, path).where(~tx.is_blank(F.col("text"))).withColumnRenamed("text", "markdown")


def head(docs: DataFrame, most: int = 150, text: str = "text") -> DataFrame:
    """The first lines of each document."""
    return docs.withColumn(text, F.array_join(F.slice(tx.lines(F.col(text)), 1, most), "\n"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query): parts between double newlines, stripped, without empty ones."""
    check_file(spark, path)
    parts = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n\n")).alias("k", "query"))
    return parts.withColumn("query", tx.strip(F.col("query"))).where("query <> ''").select(F.col("k").cast("long").alias("query_id"), "query")


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processor document as lines, a blank one between them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        runs = [x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")]
        out.append("".join(runs))
    return "\n\n".join(out) + "\n"


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) per document file."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(docx_text)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return raw.select("path", tx.clean_entities(run("content")).alias("text"))


def concatenate(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One text per key of all its files in the order of their paths, a newline after each."""
    ordered = F.sort_array(F.collect_list(F.struct("path", "text")))
    return files.groupBy(*(keys or [])).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("text"))
