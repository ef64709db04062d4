"""The queries of this subpackage and the SQL that some of them can be checked against."""

from __future__ import annotations

import importlib

#: Fixed list: the module of each operator, by its number.
MODULES = ["html_extract", "pieces", "decontaminate", "line_dedup", "token_shards", "toxicity", "near_dedup", "personal_data", "url_filters", "image_copies"]


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f".{name}", __package__)
        queries |= module.QUERIES
        sql |= getattr(module, "SQL", {})
    return queries, sql
