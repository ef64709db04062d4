"""Exact nearest-neighbour search, roll-up to sections, comparison and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import nsmallest
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.filters import document_filter, metadata_filter, with_jurisdiction
from ..functions.schema import require_columns, require_positive
from . import models
from .vectors import EmbeddingProvider, embed_column, squared_distance_to

#: Most queries of one block of a search; what a task holds of them is a matrix of this many rows.
QUERIES = 10_000


def narrowed(index: DataFrame, jurisdiction: str | None = None, where: dict[str, Any] | None = None, where_document: dict[str, Any] | None = None, text: str = "document") -> DataFrame:
    """The rows that fit the filters, which reach the scan."""
    for c in (metadata_filter(with_jurisdiction(jurisdiction, where)), document_filter(where_document, F.col(text))):
        index = index if c is None else index.where(c)
    return index


def nearest(index: DataFrame, vector: list[float], k: int = 10, embedding: str = "embedding", tie: str = "id") -> DataFrame:
    """The k rows nearest to one vector, with distance and rank from 1; a top-k per task, then of those."""
    require_positive(k=k)
    found = index.withColumn("distance", squared_distance_to(F.col(embedding), vector)).where("distance is not null").orderBy("distance", tie).limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", tie)))


def query_blocks(queries: DataFrame) -> Iterator[list]:
    """The queries with a vector in blocks of at most ``QUERIES``; one empty block if there are none."""
    found = queries.select("query_id", "vector").where("vector is not null").toLocalIterator()
    block = list(islice(found, QUERIES))
    while True:
        yield block
        if not (block := list(islice(found, QUERIES))):
            return


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    jurisdiction: str | None = None,
    where: dict[str, Any] | None = None,
    where_document: dict[str, Any] | None = None,
    embedding: str = "embedding",
    text: str = "document",
    tie: str = "id",
) -> DataFrame:
    """``queries`` (query_id, vector) against all rows that fit: query_id, rank, distance and the index's columns but the vector.

    Tasks hold the queries as one matrix and keep their k nearest rows of each as they go, so no more than k
    rows a query and task are shuffled, and of those only the id.  The other columns are joined to the k rows
    that are left, by ``tie``, which must tell the index's rows apart.  Beyond ``QUERIES`` they are searched
    block by block.  Rows without a vector, or with a null in it, are not found; the tasks leave them out, as a
    condition on a vector that a plan computes would have it computed again for each place that reads it.
    """
    require_positive(k=k)
    require_columns(index, [embedding, tie])
    require_columns(queries, ["query_id", "vector"])
    rows = narrowed(index, jurisdiction, where, where_document, text)
    rest = [c for c in rows.columns if c != embedding]
    types = [queries.schema["query_id"].dataType, rows.schema[tie].dataType]
    kind = ", ".join(f"{n} {t.simpleString()}" for n, t in zip(("query_id", "near_id"), types, strict=True))
    arrow = [to_arrow_type(t) for t in types]

    def block_nearest(asked: list) -> DataFrame:
        matrix = np.array([r["vector"] for r in asked], np.float64)
        numbers = [r["query_id"] for r in asked]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Nearest(matrix, k)
            for big in batches if numbers else ():
                big = big.filter(big.column(1).is_valid())
                for batch in (big.slice(j, 1000) for j in range(0, big.num_rows, 1000)):
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    if x.shape[1] != matrix.shape[1]:
                        raise ValueError(f"vectors of {x.shape[1]} numbers in the index, of {matrix.shape[1]} in the queries")
                    best.add(x, batch.column(0))
            for lo in range(0, len(numbers), 1000):
                found = [(numbers[q], i, d) for q in range(lo, min(lo + 1000, len(numbers))) for d, _, i in best.kept[q]]
                columns = [pa.array([r[0] for r in found], arrow[0]), pa.array([r[1] for r in found], arrow[1]), pa.array([r[2] for r in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "near_id", "distance"])

        return rows.select(tie, embedding).mapInArrow(run, f"{kind}, distance double")

    near = reduce(DataFrame.unionByName, map(block_nearest, query_blocks(queries)))
    order = Window.partitionBy("query_id").orderBy("distance", "near_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return near.join(rows.select(*rest), F.col("near_id").eqNullSafe(F.col(tie))).select("query_id", "rank", "distance", *rest)


class Nearest:
    """The k nearest rows of each query among all that were added: (distance, whether there is an id, id), nearest first."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.size = (queries**2).sum(1) if len(queries) else np.zeros(0)
        self.kept: list[list[tuple]] = [[] for _ in queries]
        self.bound = np.full(len(queries), np.inf)

    def add(self, x: np.ndarray, ids: pa.Array) -> None:
        """Products of matrices rule most rows out; what is left is measured exactly."""
        good = np.flatnonzero(~np.isnan(x).any(1))
        x, own = x[good], ids.take(pa.array(good)).to_pylist()
        size = (x**2).sum(1)
        slack = 1e-9 * (1 + float(size.max(initial=0)) + float(self.size.max(initial=0)))
        for lo in range(0, len(self.queries), 1000):
            part = slice(lo, lo + 1000)
            about = size[:, None] + self.size[None, part] - 2 * (x @ self.queries[part].T)
            bound = self.bound[part]
            if len(x) > self.k:
                bound = np.minimum(bound, np.partition(about, self.k - 1, axis=0)[self.k - 1])
            at, q = np.nonzero((about <= bound + slack).T)[::-1]
            far = reduce(np.add, ((x[at] - self.queries[lo + q]) ** 2).T, np.zeros(len(at)))  # from the left, as ``nearest`` and SQL add: sum(1) differs in the last bit
            edges = np.searchsorted(q, np.arange(about.shape[1] + 1))
            for j in np.flatnonzero(np.diff(edges)).tolist():
                i, end = int(edges[j]), int(edges[j + 1])
                new = [(d, own[r] is not None, own[r]) for d, r in zip(far[i:end].tolist(), at[i:end].tolist(), strict=True)]
                self.kept[lo + j] = nsmallest(self.k, self.kept[lo + j] + new)
                if len(self.kept[lo + j]) == self.k:
                    self.bound[lo + j] = self.kept[lo + j][-1][0]


def compare(
    index: DataFrame, vector: list[float], jurisdictions: list[str], n: int = 5, group: str = "jurisdiction_id", embedding: str = "embedding", tie: str = "id"
) -> DataFrame:
    """The n nearest rows of each listed jurisdiction; one without rows keeps a row of nulls."""
    require_positive(n=n)
    wanted = index.sparkSession.createDataFrame([(j,) for j in dict.fromkeys(jurisdictions)], f"{group} string")
    near = index.where(F.col(group).isin(list(dict.fromkeys(jurisdictions)))).withColumn("distance", squared_distance_to(F.col(embedding), vector))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("distance", tie))).where(F.col("rank") <= n)
    return wanted.join(ranked.drop(embedding), group, "left")


def roll_up(hits: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Hits to sections: the best distance, the number of hits and the hits in order, with the section's own columns.

    Hits without a section reference and sections that are not there drop out.  ``place`` orders the sections of
    a query by their best distance, ties by the first hit.
    """
    require_columns(hits, ["query_id", "rank", "distance", "section_ref", *keys])
    require_columns(sections, ["section_idx", "heading_text", "body_text", *keys])
    have = set(hits.columns)
    parts = ["distance", "rank", *(c for c in ("segment_idx", "segment_text", "document", "segment_position") if c in have)]
    grouped = (
        hits.where("section_ref is not null")
        .groupBy("query_id", *keys, F.col("section_ref").alias("section_idx"))
        .agg(F.min("distance").alias("relevance_score"), F.count("*").alias("segment_count"), F.min("rank").alias("first_rank"), F.sort_array(F.collect_list(F.struct(*parts))).alias("matches"))
    )
    order = Window.partitionBy("query_id").orderBy("relevance_score", "first_rank", *keys, "section_idx")
    own = [c for c in ("heading_text", "body_text", "heading_level", "parent") if c in sections.columns]
    text = F.lit(None).cast("string") if not have & {"segment_text", "document"} else None
    matching = F.transform(
        "matches",
        lambda m: F.struct(
            (m["segment_idx"] if "segment_idx" in have else F.lit(None).cast("long")).alias("segment_idx"),
            (text if text is not None else m["segment_text" if "segment_text" in have else "document"]).alias("segment_text"),
            m["distance"].alias("distance"),
            (m["segment_position"] if "segment_position" in have else F.lit(None).cast("long")).alias("segment_position"),
        ),
    )
    joined = grouped.join(sections.select(*keys, "section_idx", *own), [*keys, "section_idx"])
    return joined.withColumn("place", F.row_number().over(order)).select("query_id", "place", *keys, "section_idx", *own, matching.alias("matching_segments"), "relevance_score", "segment_count")


def query_info(queries: DataFrame, hits: DataFrame, rolled: DataFrame) -> DataFrame:
    """A row per query, also of those without hits: its texts, all its hits, and the sections that were returned."""
    n_hits = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    n_sections = rolled.groupBy("query_id").agg(F.count("*").alias("found"))
    rewritten = F.col("rewritten_query") if "rewritten_query" in queries.columns else F.lit(None).cast("string")
    return (
        queries.join(n_hits, "query_id", "left")
        .join(n_sections, "query_id", "left")
        .select("query_id", F.col("query").alias("original_query"), rewritten.alias("rewritten_query"), F.coalesce("hits", F.lit(0)).cast("long").alias("total_segments_found"), F.coalesce("found", F.lit(0)).cast("long").alias("unique_sections"))
    )


def stats(index: DataFrame, dimensions: tuple[str, ...] = ("jurisdiction_id", "state", "municipality")) -> DataFrame:
    """(dimension, key, n) for every value of every dimension and for the total; one pass.  Nulls count in the total alone."""
    present = [d for d in dimensions if d in index.columns]
    each = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("").alias("key")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in present))
    return index.select(F.explode(each).alias("x")).where("x.key is not null").groupBy("x.dimension", "x.key").agg(F.count("*").alias("n"))


def distinct_values(hits: DataFrame, columns: list[str]) -> DataFrame:
    """The sorted distinct values of each column, as arrays in one row."""
    return hits.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in columns))


def retrieve(
    index: DataFrame, queries: DataFrame, provider: EmbeddingProvider, k: int = 10, client: models.Client | None = None, rewrite: bool = False, model: str | None = None, **options: Any
) -> tuple[DataFrame, DataFrame]:
    """``queries`` (query_id, query) to their nearest segments in one call: (the queries with rewritten_query and vector, the hits).

    With ``rewrite`` the passage that a model makes of the question is embedded in its place.  ``options`` are those of ``search``.
    """
    require_columns(queries, ["query_id", "query"])
    asked = models.rewrite_queries(queries.select("query_id", "query"), client, model=model).select("query_id", "query", "rewritten_query") if rewrite else queries.select("query_id", "query", F.lit(None).cast("string").alias("rewritten_query"))
    asked = asked.withColumn("vector", embed_column(provider, F.coalesce("rewritten_query", "query")).cast("array<double>"))
    return asked, search(index, asked, k, **options)


def retrieve_sections(
    index: DataFrame, sections: DataFrame, queries: DataFrame, provider: EmbeddingProvider, keys: list[str], k: int = 10, client: models.Client | None = None, rewrite: bool = False, model: str | None = None, **options: Any
) -> tuple[DataFrame, DataFrame]:
    """The same, rolled up: (the sections of every query, a row per query of what was searched and found)."""
    asked, hits = retrieve(index, queries, provider, k, client, rewrite, model, **options)
    rolled = roll_up(hits, sections, keys)
    return rolled, query_info(asked.drop("vector"), hits, rolled)
