"""New documents to sections, segments and vectors as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sections, segments
from ..operators.vectors import EmbeddingProvider, VectorIndex, index_rows, with_embeddings

SCHEMA = "jurisdiction_id string, doc_id string, markdown string"


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(batch: DataFrame, index: VectorIndex, provider: EmbeddingProvider) -> None:
    """Ids are made of the document and the segment, and known ones are not added again, so a repeated batch changes nothing."""
    keys = ["jurisdiction_id", "doc_id"]
    rows = segments.flatten(sections.divide(batch, keys), keys)
    index.append(index_rows(with_embeddings(rows, provider), keys=keys))


def start(docs: DataFrame, index: VectorIndex, provider: EmbeddingProvider, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest(batch, index, provider))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def events_per_window(events: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes", by: str | None = None) -> DataFrame:
    """Counts in tumbling windows; later arrivals than the watermark are left out."""
    keys = [F.window(time, window), *([by] if by else [])]
    return events.withWatermark(time, late).groupBy(*keys).agg(F.count("*").alias("n"))
