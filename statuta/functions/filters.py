"""The filter language of vector stores, compiled to column conditions that reach the scan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}
CONTENT = {
    "$contains": lambda c, v: c.contains(v),
    "$not_contains": lambda c, v: ~c.contains(v),
    "$regex": lambda c, v: c.rlike(v),
    "$not_regex": lambda c, v: ~c.rlike(v),
}


def _join(parts: list[Column], either: bool) -> Column:
    if not parts:
        raise ValueError("$and and $or need at least one condition")
    return reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), parts)


def metadata_filter(where: dict[str, Any] | None, column=F.col) -> Column | None:
    """A condition on metadata columns; None for no filter.  Rows without a value fit no comparison."""
    if not where:
        return None
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts.append(_join([c for w in value if (c := metadata_filter(w, column)) is not None], key == "$or"))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, dict):
            for op, operand in value.items():
                if op not in COMPARE:
                    raise ValueError(f"unknown operator {op}")
                parts.append(COMPARE[op](column(key), operand))
        else:
            parts.append(column(key) == F.lit(value))
    return _join(parts, either=False)


def document_filter(where: dict[str, Any] | None, text: Column) -> Column | None:
    """A condition on the document's text; None for no filter."""
    if not where:
        return None
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts.append(_join([c for w in value if (c := document_filter(w, text)) is not None], key == "$or"))
        elif key in CONTENT:
            parts.append(CONTENT[key](text, value))
        else:
            raise ValueError(f"unknown operator {key}")
    return _join(parts, either=False)


def with_jurisdiction(jurisdiction: str | None, where: dict[str, Any] | None) -> dict[str, Any] | None:
    """Both conditions where both are given; an empty one counts as none."""
    own = {"jurisdiction_id": jurisdiction} if jurisdiction else None
    if own and where:
        return {"$and": [own, where]}
    return own or where or None
