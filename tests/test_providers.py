"""Clients of services, with stand-ins for the services' libraries."""

import json
import pickle
import sys
import types

import pytest

from statuta import config
from statuta.operators import batch, ingest, models, providers, retrieve, vectors


def fake(monkeypatch, name, **members):
    module = types.ModuleType(name)
    module.__dict__.update(members)
    monkeypatch.setitem(sys.modules, name, module)


class Box:
    def __init__(self, **members):
        self.__dict__.update(members)


def test_embeddings(monkeypatch):
    seen = []

    class Local:
        def __init__(self, host=None):
            self.host = host

        def embed(self, model, input):
            seen.append((self.host, model, len(input)))
            return {"embeddings": [[float(len(t)), 1.0] for t in input]}

    class Mistral:
        def __init__(self, api_key):
            self.key = api_key
            self.embeddings = Box(create=lambda model, inputs: Box(data=[Box(embedding=[2.0, float(len(t))]) for t in inputs]))

    fake(monkeypatch, "ollama", Client=Local)
    fake(monkeypatch, "mistralai", Mistral=Mistral)
    local = providers.embedding_provider("ollama", "http://host")
    assert vectors.embed_texts(local, ["a", "bcd"]).tolist() == [[1.0, 1.0], [3.0, 1.0]] and seen == [("http://host", "embeddinggemma", 1)] * 2
    with pytest.raises(ValueError, match="MISTRAL_API_KEY"):
        monkeypatch.delenv("MISTRAL_API_KEY", raising=False)
        providers.embedding_provider("mistral")
    monkeypatch.setenv("MISTRAL_API_KEY", "k")
    monkeypatch.setenv("STATUTA_EMBEDDING_PROVIDER", "Mistral")
    assert vectors.embed_texts(providers.embedding_provider(), ["abcd"]).tolist() == [[2.0, 4.0]]
    with pytest.raises(ValueError, match="unsupported"):
        providers.embedding_provider("other")
    assert vectors.detect_provider(Mistral("k")) == "mistral" and vectors.detect_provider(Local()) == "ollama"


def test_chat(monkeypatch):
    replies, asked = [], []

    def send(**given):
        asked.append(given)
        return Box(choices=[Box(message=Box(content=replies.pop(0)))])

    class OpenAI:
        def __init__(self, api_key):
            self.chat = Box(completions=Box(create=send))

    fake(monkeypatch, "openai", OpenAI=OpenAI)
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    monkeypatch.setenv("STATUTA_LLM_PROVIDER", "openai")
    client = providers.llm_client()
    replies += ["no json", json.dumps({"is_relevant": "true"}), json.dumps({"is_relevant": "true", "confidence": "0.5", "reasoning": None})]
    assert models.assess(client, "q", "t") == {"is_relevant": True, "confidence": 0.5, "reasoning": ""}
    assert len(asked) == 3 and asked[0]["model"] == config.fast_model() and asked[0]["messages"][0]["content"].startswith("You judge")
    replies += ["{}"] * 3
    with pytest.raises(ValueError, match="reply 3"):
        models.assess(client, "q", "t")
    assert pickle.loads(pickle.dumps(client)).provider == "openai"
    replies.append(json.dumps({"levels": [{"level": 1, "regex_pattern": "Title", "markdown_prefix": "#", "example_heading": None}]}))
    assert ingest.detect_headings(client, "Title I\n").levels[0].markdown_prefix == "#"
    with pytest.raises(ValueError):
        client.complete("other", "p", None, None)
    monkeypatch.setenv("STATUTA_LLM_PROVIDER", "offline")
    assert isinstance(providers.llm_client(), models.OfflineClient)


def test_one_call(spark):
    index = spark.createDataFrame([(f"x:{k}", f"goats and {w}", k) for k, w in enumerate(["dogs", "fences", "noise"])], "id string, document string, section_ref long")
    index = index.withColumn("embedding", vectors.embed_column(vectors.HashingProvider(), index["document"]))
    tree = spark.createDataFrame([(k, f"# {k}", "body") for k in range(3)], "section_idx long, heading_text string, body_text string")
    asked = spark.createDataFrame([(1, "fences"), (2, "noise")], "query_id long, query string")
    rolled, info = retrieve.retrieve_sections(index, tree, asked, vectors.HashingProvider(), [], k=1, client=models.OfflineClient(), rewrite=True)
    assert {(r["query_id"], r["section_idx"]) for r in rolled.collect()} == {(1, 1), (2, 2)}
    assert [(r["original_query"], r["rewritten_query"], r["unique_sections"]) for r in info.orderBy("query_id").collect()] == [(q, f"This section provides: {q}", 1) for q in ("fences", "noise")]


def test_preparation_isolates_errors(spark):
    class Picky(vectors.HashingProvider):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return super().embed(texts)

    asked = spark.createDataFrame([(0, "good"), (1, "bad"), (2, "explode")], "query_id long, query string").coalesce(1)
    got = {r["query_id"]: r["p"] for r in models.prepare_queries(asked, Picky(), models.FailingClient("explode")).collect()}
    assert len(got[0]["vector"]) == 64 and got[1]["error"] == "refused" and got[2]["error"] and got[0]["rewritten_query"].endswith("good")


def test_views_and_lines(spark):
    df = spark.createDataFrame([(["a", "b"], None), ([], ["c"])], "citations array<string>, supporting_passages array<string>")
    assert [tuple(r) for r in batch.text_view(df).collect()] == [("- a\n- b", ""), ("", "- c")]
    assert ingest.head_lines("a\x0cb\r\nc d\re", 2) == ["a\x0cb\n", "c d\n"]
