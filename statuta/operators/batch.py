"""Many questions at once: one plan for retrieval over all of them, then an answer per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reports import context_block
from ..functions.schema import ANSWERS, require_text
from . import models, retrieve
from .vectors import EmbeddingProvider


def query_table(spark: SparkSession, queries: list[str | None]) -> DataFrame:
    """(query_id, query) of the questions that are texts and not blank, numbered as given."""
    if not isinstance(queries, list) or not queries:
        raise ValueError("queries must be a list of questions")
    return spark.createDataFrame([(k, q) for k, q in enumerate(queries) if isinstance(q, str) and q.strip()], "query_id long, query string")


def contexts(rolled: DataFrame) -> DataFrame:
    """(query_id, context, sections_found) from sections in their order."""
    block = context_block(F.col("place"), F.col("heading_text"), F.col("relevance_score"), F.col("body_text"), F.col("matching_segments"))
    ordered = F.sort_array(F.collect_list(F.struct("place", block.alias("block"))))
    return rolled.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("context"), F.count("*").alias("sections_found"))


def run(
    spark: SparkSession,
    client: models.Client,
    queries: list[str | None],
    jurisdiction: str,
    sections: DataFrame,
    index: DataFrame,
    provider: EmbeddingProvider,
    model: str | None = None,
    temperature: float = 0.1,
    max_retries: int = 3,
    k: int = 10,
    hyde: bool = False,
    keys: list[str] | None = None,
) -> DataFrame:
    """The answers table, a row per question in the order given.  What fails for a question becomes its row.

    processing_time runs from a question's rewriting to its answer, with the retrieval between them.
    """
    if client is None:
        raise ValueError("a client is required")
    if sections is None or index is None or provider is None:
        raise ValueError("sections, an index and an embedding provider are required")
    require_text(jurisdiction=jurisdiction)
    keys = ["jurisdiction_id"] if keys is None else keys
    asked = query_table(spark, queries).orderBy("query_id").collect()
    prepared = models.prepare_queries(spark.createDataFrame(asked, "query_id long, query string").repartition(max(1, -(-len(asked) // 100)), "query_id"), provider, client if hyde else None, model).collect() if asked else []
    good = [(r["query_id"], r["query"], r["p"]["rewritten_query"], r["p"]["vector"]) for r in prepared if r["p"]["error"] is None]
    bad = [(r["query_id"], r["query"], r["p"]["error"]) for r in prepared if r["p"]["error"] is not None]
    began = {r["query_id"]: r["p"]["began"] for r in prepared}
    table = spark.createDataFrame(good, "query_id long, query string, rewritten_query string, vector array<double>")
    hits = retrieve.search(index, table, k, jurisdiction=jurisdiction)
    rolled = retrieve.roll_up(hits, sections.where(F.col("jurisdiction_id") == jurisdiction) if "jurisdiction_id" in sections.columns else sections, keys)
    counts = retrieve.query_info(table, hits, rolled).select("query_id", F.col("total_segments_found").alias("segments_found"))
    starts = spark.createDataFrame([(i, b) for i, b in began.items()], "query_id long, began double")
    whole = (
        table.select("query_id", "query")
        .join(starts, "query_id")
        .join(contexts(rolled), "query_id", "left")
        .join(counts, "query_id", "left")
        .select("query_id", "query", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("sections_found", F.lit(0)).alias("sections_found"), "segments_found", "began")
    )
    told = models.answer_queries(whole, client, model, temperature, max_retries)
    failed = F.col("answer.error").isNotNull()
    zero = lambda c: F.when(failed, F.lit(0)).otherwise(F.col(c)).cast("long")
    done = told.select(
        "query_id", "query", *(f"answer.{c}" for c in ("short_answer", "reasoning", "citations", "supporting_passages", "confidence", "limitations")),
        zero("sections_found").alias("sections_found"), zero("segments_found").alias("segments_found"), (F.col("answer.finished") - F.col("began")).alias("processing_time"),
    )
    errors = spark.createDataFrame([(i, q, f"Error: {e}", e, [], [], 0.0, "The question could not be processed.", 0, 0, 0.0) for i, q, e in bad], f"query_id long, {ANSWERS}")
    return done.unionByName(errors).orderBy("query_id").drop("query_id")


def summary(answers: DataFrame) -> DataFrame:
    return answers.agg(F.count("*").alias("answers"), F.avg("confidence").alias("mean_confidence"), F.avg("processing_time").alias("mean_seconds"))


def text_view(answers: DataFrame) -> DataFrame:
    """The same with lists of citations and passages as texts, items on lines of their own; an empty list is an empty text."""
    return answers.withColumns({c: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n") for c in ("citations", "supporting_passages")})
