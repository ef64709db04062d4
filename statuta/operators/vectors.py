"""Embedding vectors, distances and the vector index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx
from ..functions.reports import embedding_input
from ..functions.schema import EMBEDDING, require_columns, require_frame

_TOKEN = re.compile(r"[a-z0-9]+")


class EmbeddingProvider(Protocol):
    """Turns texts into vectors of one length.  It travels to workers, so it opens connections only when called."""

    name: str
    batch: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Deterministic vectors without a model: signed counts of hashed tokens, of length one.  A stand-in for tests."""

    name, batch = "hashing", 100

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for token in _TOKEN.findall(text.lower()):
                digest = hashlib.md5(token.encode()).hexdigest()
                row[int(digest[:8], 16) % self.dim] += 1 if int(digest[8], 16) < 8 else -1
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()


class ClientProvider:
    """A provider from a factory of clients with an ``embed(model, texts)`` method; one request per ``batch`` texts."""

    def __init__(self, name: str, factory, model: str | None = None, batch: int | None = None):
        self.name, self.factory = name, factory
        self.model, self.batch = model or config.embedding_model(name), batch or (1 if name == "ollama" else 100)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not hasattr(self, "client"):
            self.client = self.factory()
        return self.client.embed(self.model, texts)


def detect_provider(client: object) -> str:
    """From the names of a client's class and module, else from what it can do."""
    told = f"{type(client).__module__}.{type(client).__name__}".lower()
    for name in config.EMBEDDINGS:
        if name in told:
            return name
    return "mistral" if hasattr(client, "embeddings") else "ollama"


def embed_texts(provider: EmbeddingProvider, texts: list[str]) -> np.ndarray:
    """A row per text.  A reply that is null, empty, ragged or of another number of rows is an error."""
    if provider is None:
        raise ValueError("an embedding provider is required")
    if not texts:
        raise ValueError("no texts to embed")
    rows: list[np.ndarray] = []
    lengths: set[int] = set()
    for k in range(0, len(texts), provider.batch):
        part = texts[k : k + provider.batch]
        reply = provider.embed(part)
        if reply is None or len(reply) != len(part) or any(r is None or len(r) == 0 for r in reply):
            raise ValueError(f"{provider.name} gave no vector for each text")
        lengths |= {len(r) for r in reply}
        if len(lengths) != 1:
            raise ValueError(f"{provider.name} gave vectors of different lengths")
        rows.append(np.array(reply, np.float32))
    return np.concatenate(rows)


def embed_column(provider: EmbeddingProvider, text: Column) -> Column:
    """An array of floats per row; the provider is opened once per task.  Null texts are embedded as empty ones."""

    @F.pandas_udf(EMBEDDING)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embed_texts(provider, batch.fillna("").tolist())) if len(batch) else [], index=batch.index, dtype=object)

    return run(text)


def with_embeddings(segments: DataFrame, provider: EmbeddingProvider, heading: str = "section_heading", text: str = "segment_text", name: str = "embedding") -> DataFrame:
    """Appends the vector of heading and text.  No rows, no calls."""
    require_columns(segments, [heading, text])
    return segments.withColumn(name, embed_column(provider, embedding_input(F.col(heading), F.col(text))))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, for vectors of any length."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def squared_distance_to(a: Column, vector: list[float]) -> Column:
    """To one known vector: a plain sum, which stays in generated code."""
    terms = [(F.element_at(a, k + 1).cast("double") - F.lit(float(v))) * (F.element_at(a, k + 1).cast("double") - F.lit(float(v))) for k, v in enumerate(vector)]
    return reduce(lambda s, t: s + t, terms, F.lit(0.0))


def metadata_columns(df: DataFrame, id_col: str, text: str, embedding: str) -> list[str]:
    return [c for c in df.columns if c not in (id_col, text, embedding)]


def index_rows(
    embedded: DataFrame,
    jurisdiction: str | None = None,
    state: str | None = None,
    municipality: str | None = None,
    id_col: str = "segment_idx",
    text: str = "segment_text",
    embedding: str = "embedding",
    metadata: list[str] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """(id, document, embedding, metadata...).  Ids are made of the jurisdiction (or ``keys``) and the segment, so they differ between jurisdictions."""
    require_frame(embedded)
    require_columns(embedded, [id_col, text, embedding, *(metadata or []), *(keys or [])])
    if jurisdiction is None and state and municipality:
        jurisdiction = tx.make_jurisdiction_id(state, municipality)
    if jurisdiction and not (state and municipality) and "-" in jurisdiction:
        first, _, rest = jurisdiction.partition("-")
        state, municipality = state or first, municipality or rest
    names = metadata if metadata is not None else metadata_columns(embedded, id_col, text, embedding)
    prefix = [F.lit(jurisdiction)] if jurisdiction else [F.col(c).cast("string") for c in keys or []]
    extra = {"jurisdiction_id": jurisdiction, "state": state, "municipality": municipality}
    return embedded.select(
        F.concat_ws(":", *prefix, F.col(id_col).cast("string")).alias("id"),
        F.col(text).alias("document"),
        F.col(embedding).cast("array<float>").alias("embedding"),
        *(n for n in names if n not in extra or not extra[n]),
        *(F.lit(v).alias(k) for k, v in extra.items() if v),
    )


class VectorIndex:
    """A collection of vectors as Parquet under a root folder, partitioned by jurisdiction where it has one."""

    def __init__(self, spark: SparkSession, root: str, name: str, provider: str | None = None):
        self.spark, self.name = spark, tx.collection_name(name, provider)
        self.path = f"{root.rstrip('/')}/{self.name}"

    def read(self) -> DataFrame:
        """All rows; none, with the least schema, before the first ``append``."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], "id string, document string, embedding array<float>")
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Adds the rows whose id is not there yet; appending the same again changes nothing."""
        require_columns(rows, ["id", "document", "embedding"])
        known = self.read().select("id")
        new = rows.dropDuplicates(["id"]).join(known, "id", "left_anti")
        writer = new.write.mode("append")
        (writer.partitionBy("jurisdiction_id") if "jurisdiction_id" in rows.columns else writer).parquet(self.path)

    def count(self) -> int:
        return self.read().count()


def new_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Insert-if-absent as a plan: the rows whose id is not known."""
    return rows.join(known.select("id"), "id", "left_anti")


def embed_and_store(
    segments: DataFrame, provider: EmbeddingProvider, index: VectorIndex, parquet: str | None = None, jurisdiction: str | None = None, state: str | None = None, municipality: str | None = None
) -> DataFrame:
    """Vectors of all segments, kept as Parquet where a path is given, and added to the index."""
    embedded = with_embeddings(segments, provider)
    if parquet:
        embedded.write.mode("overwrite").parquet(parquet)
        embedded = segments.sparkSession.read.parquet(parquet)
    index.append(index_rows(embedded, jurisdiction, state, municipality))
    return embedded
