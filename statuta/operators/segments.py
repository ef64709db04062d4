"""Sections to segments of bounded length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.schema import SEGMENTS, require_columns, require_positive

TOKENS, WORDS_PER_TOKEN = 1024, 0.78
#: Up to this many words a segment is one match of a pattern; matching recurses by words, and Java's stack ended between 2,000 and 4,000.
DEEP = 1000
_GAP, _STOP = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")


def word_limit(token_limit: float = TOKENS, words_per_token: float = WORDS_PER_TOKEN) -> int:
    require_positive(token_limit=token_limit, words_per_token=words_per_token)
    limit = int(token_limit * words_per_token)
    if limit < 1:
        raise ValueError("the limits allow no word in a segment")
    return limit


def chunk_text(text: str, limit: int) -> list[str]:
    """Paragraphs that fit stay whole; others are packed sentence by sentence, and what is still too long is cut by words."""
    out: list[str] = []
    for paragraph in filter(None, map(str.strip, _GAP.split(text.strip()))):
        if len(paragraph.split()) <= limit:
            out.append(paragraph)
            continue
        held: list[str] = []
        n = 0
        for sentence in filter(None, map(str.strip, _STOP.split(paragraph))):
            size = len(sentence.split())
            if held and n + size > limit:
                out.append(" ".join(held))
                held, n = [], 0
            held.append(sentence)
            n += size
        out.append(" ".join(held))
    return [" ".join(w[k : k + limit]) if len(w) > limit else s for s in out for w in (s.split(),) for k in range(0, len(w), limit)]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though it is used many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pack(found: Column, limit: int) -> Column:
    """Sentences joined greedily up to the limit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("any"))

    def step(a: Column, s: Column) -> Column:
        size = tx.word_count(s)
        full = a["any"] & (a["n"] + size > limit)
        return F.when(
            full, F.struct(F.concat(a["done"], F.array(a["held"])).alias("done"), s.alias("held"), size.alias("n"), F.lit(True).alias("any"))
        ).otherwise(
            F.struct(a["done"].alias("done"), F.when(a["any"], F.concat(a["held"], F.lit(" "), s)).otherwise(s).alias("held"), (a["n"] + size).alias("n"), F.lit(True).alias("any"))
        )

    return F.aggregate(found, start, step, lambda a: F.when(a["any"], F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]))


def _cut(c: Column, limit: int) -> Column:
    return _let(
        tx.words(c),
        lambda w: F.when(F.size(w) <= limit, F.array(c)).otherwise(
            F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / limit) - 1), lambda k: F.array_join(F.slice(w, (k * limit + 1).cast("int"), F.lit(limit)), " "))
        ),
    )


def _longer(c: Column, limit: int) -> Column:
    """Whether a stripped text has more words than the limit; reads no further than that."""
    return c.rlike(rf"\A(?:{tx.WORD}{tx.SPACE}){{{limit}}}+{tx.NOT_WS}")


def _matched(paragraph: Column, limit: int) -> Column:
    """``_pack`` and ``_cut`` by patterns: as many words as fit, back to the last end of a sentence, or one sentence that is too long."""
    one_gap = F.regexp_replace(paragraph, rf"(?![!-~])(?<=[.!?]){tx.WS}++", " ")
    fits = rf"{tx.WORD}(?:{tx.SPACE}{tx.WORD}){{0,{limit - 1}}}(?:(?<=[.!?])|\z)"
    found = F.regexp_extract_all(one_gap, F.lit(rf"{fits}|(?:[!-~]|{tx.NOT_WS}|(?<![.!?]){tx.WS})++"), 0)
    by_words = lambda s: F.regexp_extract_all(F.regexp_replace(s, rf"(?![!-~]){tx.WS}++", " "), F.lit(rf"{tx.WORD}(?: {tx.WORD}){{0,{limit - 1}}}+"), 0)
    return F.flatten(F.transform(found, lambda s: F.when(_longer(s, limit), by_words(s)).otherwise(F.array(s))))


def chunk_column(text: Column, limit: int) -> Column:
    """``chunk_text`` as an expression, without Python."""
    if limit <= DEEP:
        packed = lambda p: _matched(p, limit)
    else:
        packed = lambda p: F.flatten(F.transform(_pack(tx.sentences(p), limit), lambda s: _cut(s, limit)))
    each = F.transform(tx.paragraphs(text), lambda p: F.when(_longer(p, limit), packed(p)).otherwise(F.array(p)))
    return F.coalesce(F.flatten(each), F.array().cast("array<string>"))


def chunk(text: Column, token_limit: float = TOKENS, words_per_token: float = WORDS_PER_TOKEN, python: bool = True) -> Column:
    """An array of segments; null and blank texts give an empty one.

    By default an Arrow batch at a time in Python; otherwise by patterns in the JVM.
    """
    limit = word_limit(token_limit, words_per_token)
    if not python:
        return chunk_column(text, limit)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: chunk_text(t, limit) if isinstance(t, str) else [])

    return run(text)


def flatten(
    sections: DataFrame, keys: list[str], text: str = "body_text", token_limit: float = TOKENS, words_per_token: float = WORDS_PER_TOKEN, python: bool = True
) -> DataFrame:
    """The segments table: key columns, then segment_idx from 0 per key, section, position and text."""
    require_columns(sections, [*keys, "section_idx", "heading_text", "heading_level", text])
    each = sections.where(~tx.is_blank(F.col(text))).select(
        *keys,
        F.col("section_idx").cast("long").alias("section_ref"),
        F.col("heading_text").alias("section_heading"),
        F.col("heading_level").cast("long").alias("section_level"),
        F.posexplode(chunk(F.col(text), token_limit, words_per_token, python)).alias("segment_position", "segment_text"),
    )
    order = Window.partitionBy(*keys).orderBy("section_ref", "segment_position")
    names = [f.split()[0] for f in SEGMENTS.split(", ")]
    return (
        each.withColumn("segment_position", F.col("segment_position").cast("long"))
        .withColumn("word_count", tx.word_count(F.col("segment_text")))
        .withColumn("segment_idx", (F.row_number().over(order) - 1).cast("long"))
        .select(*keys, *names)
    )


def aggregate(segments: DataFrame, keys: list[str], ref: str = "section_ref") -> DataFrame:
    """Per section its segments in order, their number and words; rows without a section are left out."""
    require_columns(segments, [*keys, ref, "segment_position", "segment_text", "word_count"])
    ordered = F.sort_array(F.collect_list(F.struct("segment_position", "segment_text")))
    return (
        segments.where(F.col(ref).isNotNull())
        .groupBy(*keys, F.col(ref).alias("section_idx"))
        .agg(
            F.transform(ordered, lambda s: s["segment_text"]).alias("segments"),
            F.count("*").alias("segment_count"),
            F.sum(F.coalesce("word_count", F.lit(0))).alias("total_words"),
        )
    )


def attach(sections: DataFrame, keys: list[str], text: str = "body_text", token_limit: float = TOKENS, words_per_token: float = WORDS_PER_TOKEN) -> DataFrame:
    """Every section with its segments, their number and words; an empty list where there is no text.

    A section's segments come from its own row, so nothing is aggregated or joined.
    """
    require_columns(sections, [*keys, "section_idx", text])
    rest = [c for c in sections.columns if c != "section_idx"]
    made = sections.withColumn("segments", chunk(F.col(text), token_limit, words_per_token))
    total = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + tx.word_count(s))
    return made.select("section_idx", *rest, "segments", F.size("segments").cast("long").alias("segment_count"), total.alias("total_words"))


def attach_by_join(sections: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """The same from a stored segments table: a left join that keeps sections without segments."""
    out = sections.join(aggregate(segments, keys), [*keys, "section_idx"], "left")
    rest = [c for c in sections.columns if c != "section_idx"]
    none = F.array().cast("array<string>")
    return out.select("section_idx", *rest, F.coalesce("segments", none).alias("segments"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("segment_count", "total_words")))
