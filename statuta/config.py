"""Settings from the environment: which provider and which models to use.

``STATUTA_LLM_PROVIDER``, ``STATUTA_EMBEDDING_PROVIDER``, ``STATUTA_FAST_MODEL``, ``STATUTA_POWERFUL_MODEL`` and
``STATUTA_EMBEDDING_MODEL``; an empty variable counts as unset.
"""

from __future__ import annotations

import os
from pathlib import Path

#: Fixed defaults per provider: fast model, powerful model.
MODELS = {"offline": ("extractive-small", "extractive"), "openai": ("gpt-4.1-mini", "gpt-4.1"), "mistral": ("mistral-medium-latest", "magistral-medium-latest")}
EMBEDDINGS = {"hashing": "hashing-64", "ollama": "embeddinggemma", "mistral": "mistral-embed"}
KEYS = {"mistral": "MISTRAL_API_KEY", "openai": "OPENAI_API_KEY"}
TEMPERATURE, RETRIES = 0.1, 3


def load_env(path: str = ".env") -> None:
    """Sets what a file of NAME=value lines names and the environment doesn't."""
    if Path(path).is_file():
        for line in Path(path).read_text().splitlines():
            name, sep, value = line.partition("=")
            if sep and not line.lstrip().startswith("#"):
                os.environ.setdefault(name.strip(), value.strip().strip("'\""))


def _env(name: str, default: str) -> str:
    return os.environ.get(f"STATUTA_{name}") or default


def llm_provider() -> str:
    name = _env("LLM_PROVIDER", "offline").lower()
    if name not in MODELS:
        raise ValueError(f"unsupported provider {name!r}; known are {', '.join(sorted(MODELS))}")
    return name


def embedding_provider() -> str:
    return _env("EMBEDDING_PROVIDER", "hashing").lower()


def fast_model() -> str:
    return _env("FAST_MODEL", MODELS[llm_provider()][0])


def powerful_model() -> str:
    return _env("POWERFUL_MODEL", MODELS[llm_provider()][1])


def embedding_model(provider: str) -> str:
    if provider not in EMBEDDINGS:
        raise ValueError(f"unsupported embedding provider {provider!r}; known are {', '.join(sorted(EMBEDDINGS))}")
    return _env("EMBEDDING_MODEL", EMBEDDINGS[provider])


def api_key(provider: str) -> str | None:
    """The key of a provider that needs one."""
    if provider not in KEYS:
        return None
    if not (key := os.environ.get(KEYS[provider])):
        raise ValueError(f"{KEYS[provider]} is not set")
    return key


def llm_params(**given) -> dict:
    return {"temperature": TEMPERATURE, "max_retries": RETRIES} | given
