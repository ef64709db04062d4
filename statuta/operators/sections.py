"""Markdown documents to a tree of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.schema import require_columns


def section_structs(markdown: Column) -> Column:
    """An array of (heading_level, heading_text, body_text) per document; text before the first heading is left out.

    The document is split right before its heading lines, so dividing needs neither a shuffle nor a window.
    """
    parts = F.filter(F.split(markdown, tx.HEADING_START), tx.is_heading)
    return F.transform(
        parts,
        lambda p: F.struct(
            tx.heading_level(p).alias("heading_level"),
            tx.heading_text(p).alias("heading_text"),
            F.nullif(tx.strip_lines(F.regexp_replace(p, r"\A[^\n]*\n?", "")), F.lit("")).alias("body_text"),
        ),
    )


def divide(docs: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """One row per section: the key columns, section_idx from 0, heading_level, heading_text, body_text."""
    require_columns(docs, [*keys, text])
    each = docs.select(*keys, F.posexplode(section_structs(F.col(text))).alias("section_idx", "s"))
    return each.select(*keys, F.col("section_idx").cast("long").alias("section_idx"), "s.heading_level", "s.heading_text", "s.body_text")


def latest_by_level(keys: list[str]) -> list[Column]:
    """For each of the six levels the last section of it before a section's own, carried along each document."""
    before = Window.partitionBy(*keys).orderBy("section_idx").rowsBetween(Window.unboundedPreceding, -1)
    return [F.last(F.when(F.col("heading_level") == level, F.col("section_idx")), ignorenulls=True).over(before) for level in range(1, 7)]


def with_parents(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Adds parent: the latest section before with a lower level, null for none.

    Among the last sections of the lower levels the latest is the parent.
    """
    require_columns(sections, [*keys, "section_idx", "heading_level"])
    lower = [F.when(F.col("heading_level") > level, c) for level, c in enumerate(latest_by_level(keys), 1)]
    return sections.withColumn("parent", F.greatest(*lower).cast("long"))


def children_count(sections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section_idx, children): how many sections have this one as parent."""
    counted = sections.where("parent is not null").groupBy(*keys, F.col("parent").alias("section_idx")).agg(F.count("*").alias("children"))
    return sections.select(*keys, "section_idx").join(counted, [*keys, "section_idx"], "left").select(*keys, "section_idx", F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def ancestor_path(sections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section_idx, path): the indexes from the root to the section, in one pass over each document.

    The last section of a lower level is an ancestor if it comes after the last ones of all levels below its own.
    """
    require_columns(sections, [*keys, "section_idx", "heading_level"])
    names = [f"last_{level}" for level in range(1, 7)]
    seen = sections.select(*keys, "section_idx", "heading_level", *(c.alias(n) for n, c in zip(names, latest_by_level(keys), strict=True)))
    above = []
    for level, n in enumerate(names, 1):
        earlier = F.greatest(F.lit(-1).cast("long"), F.lit(-1).cast("long"), *(F.col(x).cast("long") for x in names[: level - 1]))
        above.append(F.when((F.col("heading_level") > level) & (F.col(n) > earlier), F.col(n).cast("long")))
    return seen.select(*keys, "section_idx", F.array_append(F.array_compact(F.array(*above)), F.col("section_idx").cast("long")).alias("path"))
