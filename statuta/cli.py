"""``python -m statuta.cli STAGE ...``: layout, convert, segment, embed, query.

Folders are those of ``make_layout`` under a data root; a missing folder or file, or a name without
a hyphen, ends with status 1.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import batch, ingest, models, providers, sections, segments, vectors
from .sources import files, sinks

INDEX = "legal_code_all"


def _folder(spark: SparkSession, root: str, name: str) -> tuple[str, str, str]:
    if "-" not in name:
        raise ValueError(f"{name} is not of the form STATE-Municipality")
    state, _, municipality = name.partition("-")
    path = f"{root.rstrip('/')}/laws/{name}"
    p, fs = files._path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no such folder: {path}")
    return path, state.upper(), municipality


def convert(spark: SparkSession, root: str, name: str, structure: str | None, client: models.Client | None = None) -> None:
    path, state, municipality = _folder(spark, root, name)
    docs = files.read_document(spark, f"{path}/processed/code.txt")
    if structure:
        given = json.load(open(structure))
        found = ingest.HeadingStructure([ingest.HeadingLevel(**x) for x in given["levels"]], len(given["levels"]))
    else:
        found = ingest.detect_headings(client or models.OfflineClient(), docs.first()["text"], model=config.fast_model())
    markdown = ingest.to_markdown(docs.select(F.lit(name).alias("jurisdiction_id"), "text"), ["jurisdiction_id"], found)
    row = markdown.first()
    sinks.write_text(spark, f"{path}/processed/code.md", ingest.front_matter(found, state, municipality) + (row["markdown"] if row else ""))


def segment(spark: SparkSession, root: str, name: str, token_limit: float, words_per_token: float) -> None:
    path, _, _ = _folder(spark, root, name)
    docs = files.read_markdown(spark, f"{path}/processed/code.md").select(F.lit(name).alias("jurisdiction_id"), ingest.strip_front_matter(F.col("markdown")).alias("markdown"))
    keys = ["jurisdiction_id"]
    tree = sections.with_parents(sections.divide(docs, keys), keys)
    sinks.write_table(tree, f"{path}/tables/sections.parquet", None)
    sinks.write_table(segments.flatten(spark.read.parquet(f"{path}/tables/sections.parquet"), keys, token_limit=token_limit, words_per_token=words_per_token), f"{path}/tables/segments.parquet", None)


def embed(spark: SparkSession, root: str, name: str, provider: vectors.EmbeddingProvider) -> int:
    path, state, municipality = _folder(spark, root, name)
    index = vectors.VectorIndex(spark, f"{root.rstrip('/')}/index", INDEX, provider.name)
    vectors.embed_and_store(spark.read.parquet(f"{path}/tables/segments.parquet"), provider, index, f"{path}/tables/embeddings.parquet", name, state, municipality)
    return index.count()


def query(spark: SparkSession, root: str, name: str, questions: str, output: str, provider: vectors.EmbeddingProvider, client: models.Client, k: int, hyde: bool) -> None:
    path, _, _ = _folder(spark, root, name)
    asked = [r["query"] for r in files.read_queries(spark, questions).orderBy("query_id").collect()]
    index = vectors.VectorIndex(spark, f"{root.rstrip('/')}/index", INDEX, provider.name)
    tree = spark.read.parquet(f"{path}/tables/sections.parquet")
    batch.run(spark, client, asked, name, tree, index.read(), provider, k=k, hyde=hyde).write.mode("overwrite").parquet(output)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="statuta")
    parser.add_argument("stage", choices=["layout", "convert", "segment", "embed", "query"])
    parser.add_argument("jurisdiction", help="STATE-Municipality")
    parser.add_argument("--root", default="data")
    parser.add_argument("--structure", help="JSON file of heading levels, instead of asking a model")
    parser.add_argument("--token-limit", type=float, default=segments.TOKENS)
    parser.add_argument("--words-per-token", type=float, default=segments.WORDS_PER_TOKEN)
    parser.add_argument("--questions")
    parser.add_argument("--output", default="query_results.parquet")
    parser.add_argument("-k", type=int, default=10)
    parser.add_argument("--hyde", action="store_true")
    a = parser.parse_args(args)
    config.load_env()
    spark = SparkSession.builder.appName("statuta").getOrCreate()
    try:
        provider, client = providers.embedding_provider(), providers.llm_client()
        if a.stage == "layout":
            state, _, municipality = a.jurisdiction.partition("-")
            print(sinks.make_layout(spark, a.root, state, municipality))
        elif a.stage == "convert":
            convert(spark, a.root, a.jurisdiction, a.structure, client)
        elif a.stage == "segment":
            segment(spark, a.root, a.jurisdiction, a.token_limit, a.words_per_token)
        elif a.stage == "embed":
            print(embed(spark, a.root, a.jurisdiction, provider))
        else:
            query(spark, a.root, a.jurisdiction, a.questions, a.output, provider, client, a.k, a.hyde)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
