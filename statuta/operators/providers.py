"""Clients of real services behind the two small protocols, chosen by settings.

The services' own libraries are imported when a client is opened, in the worker that
uses it, so none of them is needed until then.
"""

from __future__ import annotations

import json
from typing import Any

from .. import config
from .models import Client, OfflineClient
from .vectors import ClientProvider, EmbeddingProvider, HashingProvider

#: What each kind of call must return, as field names with example values of their types.
REPLIES: dict[str, dict[str, Any]] = {
    "rewrite": {"rewritten_query": "", "confidence": 0.0, "reasoning": "", "query_type": ""},
    "relevance": {"is_relevant": True, "confidence": 0.0, "reasoning": ""},
    "answer": {"short_answer": "", "reasoning": "", "citations": [""], "supporting_passages": [""], "confidence": 0.0, "limitations": ""},
    "heading_structure": {"levels": [{"level": 1, "regex_pattern": "", "markdown_prefix": "", "example_heading": ""}]},
}


class OllamaEmbeddings:
    """A local server; one request per call."""

    def __init__(self, host: str | None = None):
        import ollama

        self.client = ollama.Client(host=host) if host else ollama.Client()

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        reply = self.client.embed(model=model, input=texts)
        return [list(v) for v in reply["embeddings"]]


class MistralEmbeddings:
    def __init__(self, key: str | None):
        from mistralai import Mistral

        self.client = Mistral(api_key=key)

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        reply = self.client.embeddings.create(model=model, inputs=texts)
        return [list(x.embedding) for x in reply.data]


def embedding_provider(name: str | None = None, host: str | None = None) -> EmbeddingProvider:
    """The provider of a name, or that of ``STATUTA_EMBEDDING_PROVIDER``."""
    name = name or config.embedding_provider()
    if name == "hashing":
        return HashingProvider()
    if name == "ollama":
        return ClientProvider(name, lambda: OllamaEmbeddings(host))
    if name == "mistral":
        config.api_key(name)  # a missing key is told before any task runs
        return ClientProvider(name, lambda: MistralEmbeddings(config.api_key(name)))
    raise ValueError(f"unsupported embedding provider {name!r}; known are {', '.join(sorted(config.EMBEDDINGS))}")


def fit(value: Any, like: Any) -> Any:
    """A reply's value in the shape of an example; what can't be put so is an error."""
    if isinstance(like, dict):
        return {k: fit(value[k], v) for k, v in like.items()}
    if isinstance(like, list):
        return [fit(x, like[0]) for x in value or []]
    if isinstance(like, bool):
        if isinstance(value, str):
            return value.strip().lower() in ("true", "yes", "1")
        return bool(value)
    return type(like)("" if value is None and isinstance(like, str) else value)


class ChatClient:
    """Structured calls through a chat service that can answer in JSON; replies that don't fit are asked for again."""

    def __init__(self, provider: str):
        self.provider = provider
        config.api_key(provider)

    def __getstate__(self) -> dict:
        return {"provider": self.provider}  # connections stay where they were opened

    def ask(self, model: str, messages: list[dict], temperature: float) -> str:
        if not hasattr(self, "client"):
            if self.provider == "openai":
                from openai import OpenAI

                self.client = OpenAI(api_key=config.api_key("openai"))
            else:
                from mistralai import Mistral

                self.client = Mistral(api_key=config.api_key("mistral"))
        send = self.client.chat.completions.create if self.provider == "openai" else self.client.chat.complete
        reply = send(model=model, messages=messages, temperature=temperature, response_format={"type": "json_object"})
        return reply.choices[0].message.content

    def complete(self, kind: str, prompt: str, system: str | None, model: str | None, **params: Any) -> dict:
        if kind not in REPLIES:
            raise ValueError(f"no such kind of call: {kind}")
        shape = f"Answer with one JSON object of this shape: {json.dumps(REPLIES[kind])}"
        messages = [{"role": "system", "content": f"{system}\n{shape}" if system else shape}, {"role": "user", "content": prompt}]
        for attempt in range(max(1, int(params.get("max_retries", config.RETRIES)))):
            try:
                return fit(json.loads(self.ask(model or config.fast_model(), messages, params.get("temperature", config.TEMPERATURE))), REPLIES[kind])
            except (ValueError, KeyError, TypeError) as e:
                error = f"reply {attempt + 1} had not the shape asked for: {e}"
        raise ValueError(error)


def llm_client(name: str | None = None) -> Client:
    """The client of a name, or that of ``STATUTA_LLM_PROVIDER``."""
    name = name or config.llm_provider()
    if name not in config.MODELS:
        raise ValueError(f"unsupported provider {name!r}; known are {', '.join(sorted(config.MODELS))}")
    return OfflineClient() if name == "offline" else ChatClient(name)
