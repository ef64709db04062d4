"""Texts that a reader or a model gets: embedding input, context blocks, answer reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def embedding_input(heading: Column, text: Column) -> Column:
    """Heading, blank line, text; one alone where the other is null or empty."""
    return F.array_join(F.filter(F.array(heading, text), lambda x: x.isNotNull() & (x != "")), "\n\n")


def context_block(number: Column, heading: Column, score: Column, body: Column, matches: Column, most: int = 3) -> Column:
    """A section for a model: number, heading, score to three places, body, and its first matches.

    ``matches`` is an array of structs with segment_text.  Blank ones are skipped but keep their numbers.
    """
    texts = F.slice(F.transform(matches, lambda m: m["segment_text"]), 1, most)
    numbered = F.transform(texts, lambda t, k: F.when(t.isNotNull() & (t != ""), F.concat(F.lit("  - Segment "), (k + 1).cast("string"), F.lit(": "), t, F.lit("\n"))).otherwise(""))
    return F.concat(
        F.lit("\nSection "), number.cast("string"), F.lit(": "), F.coalesce(heading, F.lit("Untitled Section")),
        F.lit("\nRelevance Score: "), F.format_string("%.3f", F.coalesce(score, F.lit(0.0))),
        F.lit("\nContent: "), F.coalesce(body, F.lit("")), F.lit("\n\nMatching Segments:\n"), F.array_join(numbered, ""),
    )


def _numbered(items: Column, quote: bool, none: str) -> Column:
    mark = F.lit('"' if quote else "")
    listed = F.transform(items, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), mark, x, mark, F.lit("\n")))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(listed, "")).otherwise(none)


def answer_report(answer: Column, confidence: Column, reasoning: Column, citations: Column, passages: Column, limitations: Column) -> Column:
    """The full report; empty lists say so, and limitations appear only if there are any."""
    return F.concat(
        F.lit("## Legal Analysis\n\n**Answer:** "), answer,
        F.lit("\n\n**Confidence:** "), F.format_string("%.1f%%", confidence * 100),
        F.lit("\n\n### Reasoning\n"), reasoning,
        F.lit("\n\n### Citations\n"), _numbered(citations, False, "No specific citations available.\n"),
        F.lit("\n### Supporting Passages\n"), F.regexp_replace(
            F.concat(
                _numbered(passages, True, "No supporting passages available.\n"),
                F.when(limitations.isNotNull() & (limitations != ""), F.concat(F.lit("\n### Limitations\n"), limitations, F.lit("\n"))).otherwise(""),
            ), r"\s+\z", ""),
    )


def short_report(answer: Column, confidence: Column, citations: Column, passages: Column) -> Column:
    """The notebook's form: no reasoning or limitations, passages unquoted, empty parts left out."""
    part = lambda title, items: F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(f"### {title}\n"), _numbered(items, False, ""), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("## Query Response\n\n**Answer:** "), answer, F.lit("\n\n**Confidence:** "), F.format_string("%.1f%%", confidence * 100), F.lit("\n\n"))
    return F.concat(head, part("Citations", citations), part("Supporting Passages", passages))
