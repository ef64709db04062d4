"""Writers, and the folders of a jurisdiction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import make_jurisdiction_id
from .files import _path

FOLDERS = ("raw", "processed", "tables")


def make_layout(spark: SparkSession, root: str, state: str, municipality: str) -> str:
    """Creates the folders of a jurisdiction if they are not there, and returns the path."""
    path = f"{root.rstrip('/')}/laws/{make_jurisdiction_id(state, municipality)}"
    for name in FOLDERS:
        p, fs = _path(spark, f"{path}/{name}")
        fs.mkdirs(p)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One document, whole, with its folders."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_markdown(docs: DataFrame, path: str, front_matter: str = "", text: str = "markdown", partition: str | None = None) -> None:
    """Many documents as text files, one row each."""
    rows = docs.select(*([partition] if partition else []), F.concat(F.lit(front_matter), F.col(text)).alias("value"))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).option("lineSep", "\n").text(path)


def write_table(df: DataFrame, path: str, partition: str | None = "jurisdiction_id") -> None:
    """Parquet; of a partitioned table only the partitions at hand are replaced."""
    writer = df.write.mode("overwrite")
    if partition and partition in df.columns:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
