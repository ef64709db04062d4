"""Plain legal text to Markdown."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.schema import require_columns, require_text
from .models import Client, call

SAMPLE_LINES = 150


@dataclass
class HeadingLevel:
    level: int
    regex_pattern: str
    markdown_prefix: str
    example_heading: str = ""


@dataclass
class HeadingStructure:
    levels: list[HeadingLevel] = field(default_factory=list)
    total_levels: int = 0
    file_sample_size: int = 0


def check_patterns(spark: SparkSession, structure: HeadingStructure | None) -> list[HeadingLevel]:
    """The levels in rising order.  A pattern must be valid for Python and, translated, for the JVM."""
    if structure is None or not structure.levels:
        raise ValueError("the heading structure has no levels")
    levels = sorted(structure.levels, key=lambda x: x.level)
    for level in levels:
        try:
            spark.range(1).where(tx.starts_with_pattern(F.lit("x"), level.regex_pattern)).count()
        except ValueError:
            raise
        except Exception as e:
            raise ValueError(f"invalid pattern {level.regex_pattern!r}: {e}") from e
    return levels


def head_lines(text: str, most: int = SAMPLE_LINES) -> list[str]:
    if not text:
        raise ValueError("the document is empty")
    return re.findall(r"[^\n]*\n|[^\n]+", re.sub("\r\n?", "\n", text))[:most]


def detect_headings(client: Client, text: str, most: int = SAMPLE_LINES, model: str | None = None) -> HeadingStructure:
    """Asks a model for the heading levels of the first lines; its counts are set right and its patterns checked."""
    sample = head_lines(text, most)
    prompt = f"These are the first {len(sample)} lines of an ordinance. Name its heading levels, outermost first, with a pattern for each.\n\n{''.join(sample)}"
    try:
        found = call(client, prompt, "heading_structure", system="You read the structure of legal texts and answer with patterns.", model=model)
        levels = [HeadingLevel(int(x["level"]), x["regex_pattern"], x["markdown_prefix"], x.get("example_heading", "")) for x in found["levels"]]
    except Exception as e:
        raise ValueError(f"no heading structure was found: {e}") from e
    for level in levels:
        tx.java_pattern(level.regex_pattern)
    return HeadingStructure(levels, len(levels), len(sample))


def heading_line(line: Column, levels: list[HeadingLevel]) -> Column:
    """The Markdown heading that a line stands for by the first level that fits, else null."""
    own = tx.strip(line)
    return F.coalesce(*(F.when(tx.starts_with_pattern(own, x.regex_pattern), F.concat(F.lit(f"{x.markdown_prefix} "), own)) for x in levels), F.lit(None).cast("string"))


def to_lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, line); a newline at the end of the document ends its last line."""
    require_columns(docs, [*keys, text])
    whole = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"\n\z", "")
    return docs.where(F.col(text) != "").select(*keys, F.posexplode(tx.lines(whole)).alias("line_no", "line"))


def merge_paragraphs(lines: DataFrame, keys: list[str], levels: list[HeadingLevel]) -> DataFrame:
    """(keys, line_no, line): runs of text lines become one line; headings and blank lines stand alone.

    A run starts wherever the kind of line isn't text or was not text before.
    """
    kind = F.when(F.col("heading").isNotNull(), "heading").when(tx.is_blank(F.col("line")), "blank").otherwise("text")
    marked = lines.withColumn("heading", heading_line(F.col("line"), levels)).withColumn("kind", kind)
    order = Window.partitionBy(*keys).orderBy("line_no")
    starts = (F.col("kind") != "text") | (F.coalesce(F.lag("kind").over(order), F.lit("")) != "text")
    runs = marked.withColumn("start", starts.cast("int")).withColumn("run", F.sum("start").over(order))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", tx.strip(F.col("line")).alias("line")))), lambda x: x["line"]), " ")
    return runs.groupBy(*keys, "run").agg(F.coalesce(F.max("heading"), texts).alias("line"), F.min("line_no").alias("line_no")).select(*keys, "line_no", "line")


def to_markdown(docs: DataFrame, keys: list[str], structure: HeadingStructure, text: str = "text") -> DataFrame:
    """(keys, markdown): headings marked and paragraphs on one line each."""
    levels = check_patterns(docs.sparkSession, structure)
    merged = merge_paragraphs(to_lines(docs, keys, text), keys, levels)
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return merged.groupBy(*keys).agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"))


def front_matter(structure: HeadingStructure, state: str, municipality: str, now: datetime | None = None) -> str:
    """YAML between marker lines; strings are quoted as JSON, which YAML reads alike."""
    require_text(state=state, municipality=municipality)
    state, municipality = state.strip().upper(), municipality.strip()
    q = lambda s: json.dumps(s, ensure_ascii=False)
    rows = ["---", "jurisdiction:", f"  state: {q(state)}", f"  municipality: {q(municipality)}", f"  full_name: {q(f'{state} - {municipality}')}", "heading_patterns:"]
    for x in structure.levels:
        rows += [f"- level: {x.level}", f"  regex_pattern: {q(x.regex_pattern)}", f"  markdown_prefix: {q(x.markdown_prefix)}", f"  example_heading: {q(x.example_heading)}"]
    stamp = (now or datetime.now(timezone.utc)).isoformat()
    return "\n".join([*rows, f"created_at: {q(stamp)}", "---", "", ""])


def strip_front_matter(c: Column) -> Column:
    """Drops a leading block between two marker lines and strips the rest; without a closing marker nothing changes."""
    mark = rf"{tx.INLINE}*---{tx.INLINE}*"
    block = rf"\A{mark}\n(?:(?!{mark}(?:\n|\z))[^\n]*\n)*+{mark}(?:\n|\z)"
    return F.when(c.rlike(block), tx.strip(F.regexp_replace(c, block, ""))).otherwise(c)
