"""Operators that ask a language model, row by row, with failures as data.

A client is anything with ``complete(kind, prompt, system, model, **params)`` that
returns a dict; it travels to workers and opens connections there.  The offline
clients here are deterministic stand-ins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.schema import ANSWER, ASSESSMENT, REWRITE, require_columns, require_share, require_text

#: Returned without a call where retrieval found no section.
NO_ANSWER = {
    "short_answer": "The question cannot be answered: no relevant provisions were found.",
    "reasoning": "The search returned no section of the law that bears on the question.",
    "citations": [],
    "supporting_passages": [],
    "confidence": 0.0,
    "limitations": "Nothing relevant was available.",
}


class Client(Protocol):
    def complete(self, kind: str, prompt: str, system: str | None, model: str | None, **params: Any) -> dict: ...


def call(client: Client | None, prompt: str, kind: str, system: str | None = None, model: str | None = None, **params: Any) -> dict:
    """One structured call.  A blank prompt or a missing client is an error, and errors of the client pass through."""
    if client is None:
        raise ValueError("a client is required")
    require_text(prompt=prompt)
    return client.complete(kind, prompt, system if system and system.strip() else None, model, **config.llm_params(**params))


def rewrite(client: Client | None, query: str, model: str | None = None) -> dict:
    """A passage of law that would answer the question, to search with."""
    require_text(query=query)
    out = call(client, f"Question: {query}\nWrite the passage of an ordinance that would answer it.", "rewrite", "You draft plausible ordinance text for retrieval.", model or config.fast_model())
    require_share("confidence", out["confidence"])
    return out


def assess(client: Client | None, query: str, text: str, model: str | None = None) -> dict:
    """Whether a text bears on a question."""
    require_text(query=query, text=text)
    out = call(client, f"Question: {query}\nText: {text}\nDoes the text help to answer the question?", "relevance", "You judge relevance strictly.", model or config.fast_model())
    require_share("confidence", out["confidence"])
    return out


def answer(client: Client | None, query: str, context: str, sections: int, model: str | None = None, temperature: float = 0.1, max_retries: int = 3) -> dict:
    """An answer from context blocks; a fixed one, without a call, where there are no sections."""
    if client is None:
        raise ValueError("a client is required")
    require_text(query=query)
    if not sections:
        return dict(NO_ANSWER)
    prompt = f"Question: {query}\n\nProvisions:\n{context}\nAnswer from these provisions only; cite them and quote what supports the answer."
    out = call(client, prompt, "answer", "You answer questions on municipal law.", model or config.powerful_model(), temperature=temperature, max_retries=max_retries)
    require_share("confidence", out["confidence"])
    return out


def rewrite_queries(queries: DataFrame, client: Client, query: str = "query", model: str | None = None) -> DataFrame:
    """Adds rewritten_query, confidence, reasoning and query_type."""
    require_columns(queries, [query])

    @F.pandas_udf(REWRITE)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [rewrite(client, t, model) for t in texts]
        return pd.DataFrame(rows, columns=["rewritten_query", "confidence", "reasoning", "query_type"])

    return queries.withColumn("r", run(F.col(query))).select(*queries.columns, "r.*")


def prepare_queries(queries: DataFrame, provider: Any, client: Client | None = None, model: str | None = None) -> DataFrame:
    """``queries`` (query_id, query) with p: rewritten_query where a client is given, vector, error and when it began.

    Texts are embedded together, as many as a request takes; where that fails, one by one, so that an error
    stays with its question.
    """
    from .vectors import embed_texts

    @F.pandas_udf("rewritten_query string, vector array<double>, error string, began double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time

        for texts in batches:
            rows = []
            for q in texts:
                row = {"rewritten_query": None, "vector": None, "error": None, "began": time.time()}
                try:
                    if client is not None:
                        row["rewritten_query"] = rewrite(client, q, model)["rewritten_query"]
                except Exception as e:
                    row["error"] = str(e)
                rows.append((row, q))
            good = [(row, row["rewritten_query"] or q) for row, q in rows if row["error"] is None]
            try:
                found = embed_texts(provider, [t for _, t in good]) if good else []
                for (row, _), v in zip(good, found, strict=True):
                    row["vector"] = [float(x) for x in v]
            except Exception:
                for row, t in good:
                    try:
                        row["vector"] = [float(x) for x in embed_texts(provider, [t])[0]]
                    except Exception as e:
                        row["error"] = str(e)
            yield pd.DataFrame([row for row, _ in rows], columns=["rewritten_query", "vector", "error", "began"])

    return queries.withColumn("p", run("query"))


def assess_hits(hits: DataFrame, client: Client, query: str = "query", document: str = "document", model: str | None = None) -> DataFrame:
    """Adds assessment (is_relevant, confidence, reasoning) to every hit; a failed call is an assessment that says so."""
    require_columns(hits, [query, document])

    @F.pandas_udf(ASSESSMENT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for queries, texts in batches:
            rows = []
            for q, t in zip(queries, texts, strict=True):
                try:
                    out = assess(client, q, t, model)
                    rows.append((bool(out["is_relevant"]), float(out["confidence"]), str(out["reasoning"])))
                except Exception as e:
                    rows.append((False, 0.0, f"the assessment failed: {e}"))
            yield pd.DataFrame(rows, columns=["is_relevant", "confidence", "reasoning"])

    return hits.withColumn("assessment", run(F.col(query), F.col(document)))


def filter_hits(assessed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The hits that are relevant with at least this confidence."""
    require_share("threshold", threshold)
    return assessed.where(F.col("assessment.is_relevant") & (F.col("assessment.confidence") >= threshold))


def filter_counts(assessed: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys, original_count, filtered_count, threshold)."""
    kept = F.col("assessment.is_relevant") & (F.col("assessment.confidence") >= threshold)
    return assessed.groupBy(*keys).agg(F.count("*").alias("original_count"), F.count_if(kept).alias("filtered_count"), F.lit(threshold).alias("threshold"))


def answer_queries(contexts: DataFrame, client: Client, model: str | None = None, temperature: float = 0.1, max_retries: int = 3) -> DataFrame:
    """``contexts`` (query, context, sections_found, ...) with an answer struct and error, null if there was none."""
    require_columns(contexts, ["query", "context", "sections_found"])

    @F.pandas_udf(f"{ANSWER}, error string, seconds double, finished double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import time

        names = list(NO_ANSWER)
        for queries, texts, counts in batches:
            rows = []
            for q, c, n in zip(queries, texts, counts, strict=True):
                began = time.perf_counter()
                try:
                    out, error = answer(client, q, c, int(n), model, temperature, max_retries), None
                except Exception as e:
                    error = str(e)
                    out = NO_ANSWER | {"short_answer": f"Error: {error}", "reasoning": error, "limitations": "The question could not be processed."}
                rows.append([*(out.get(k) for k in names), error, time.perf_counter() - began, time.time()])
            yield pd.DataFrame(rows, columns=[*names, "error", "seconds", "finished"])

    return contexts.withColumn("answer", run("query", "context", "sections_found"))


_TOKEN = re.compile(r"[a-z0-9]+")


def _field(prompt: str, name: str) -> str:
    m = re.search(rf"(?ms)^{name}: (.*?)(?=\n(?:Text: |Write the passage|Does the text|\nProvisions:)|\Z)", prompt)
    return m[1] if m else ""


class OfflineClient:
    """Rewrites by a template, finds relevance by shared tokens, answers with the first provision of the context."""

    def complete(self, kind: str, prompt: str, system: str | None, model: str | None, **params: Any) -> dict:
        query = _field(prompt, "Question")
        if kind == "rewrite":
            words = _TOKEN.findall(query.lower())
            sort = "definition" if "definition" in words or "define" in words else "permission" if "may" in words or "permit" in words else "general"
            return {"rewritten_query": f"This section provides: {query}", "confidence": 0.5, "reasoning": "template", "query_type": sort}
        if kind == "relevance":
            asked, told = set(_TOKEN.findall(query.lower())), set(_TOKEN.findall(_field(prompt, "Text").lower()))
            share = len(asked & told) / len(asked) if asked else 0.0
            return {"is_relevant": share > 0, "confidence": share, "reasoning": f"{len(asked & told)} of {len(asked)} words"}
        if kind == "answer":
            head = re.search(r"(?m)^Section 1: (.*)$", prompt)
            score = re.search(r"(?m)^Relevance Score: (.*)$", prompt)
            first = re.search(r"(?ms)^  - Segment 1: (.*?)(?=\n  - Segment |\n\nSection |\nAnswer from these|\Z)", prompt)
            return {
                "short_answer": head[1] if head else "", "reasoning": "the nearest provision", "citations": [head[1]] if head else [],
                "supporting_passages": [first[1].rstrip("\n")] if first else [], "confidence": 1 / (1 + float(score[1])) if score else 0.0, "limitations": "extractive",
            }
        raise ValueError(f"no such kind of call: {kind}")


class FailingClient(OfflineClient):
    """Fails wherever a marker stands in the prompt."""

    def __init__(self, marker: str):
        self.marker = marker

    def complete(self, kind: str, prompt: str, system: str | None, model: str | None, **params: Any) -> dict:
        if self.marker in prompt:
            raise RuntimeError("the service failed")
        return super().complete(kind, prompt, system, model, **params)
