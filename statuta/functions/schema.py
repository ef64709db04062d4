"""Table schemas and checks on inputs, made when a plan is built, without a job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SECTIONS = "section_idx long, heading_level long, heading_text string, body_text string, parent long"
SEGMENTS = "segment_idx long, section_ref long, section_heading string, section_level long, segment_position long, segment_text string, word_count long"
EMBEDDING = T.ArrayType(T.FloatType(), containsNull=False)
ANSWERS = (
    "query string, short_answer string, reasoning string, citations array<string>, supporting_passages array<string>, "
    "confidence double, limitations string, sections_found long, segments_found long, processing_time double"
)
ASSESSMENT = "is_relevant boolean, confidence double, reasoning string"
REWRITE = "rewritten_query string, confidence double, reasoning string, query_type string"
ANSWER = "short_answer string, reasoning string, citations array<string>, supporting_passages array<string>, confidence double, limitations string"


def require_frame(df: object) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(f"a DataFrame is needed, not {type(df).__name__}")
    return df


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in require_frame(df).columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_positive(**numbers: float) -> None:
    for name, value in numbers.items():
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"{name} must be a number, not {type(value).__name__}")
        if value <= 0:
            raise ValueError(f"{name} must be positive, not {value}")


def require_text(**texts: str | None) -> None:
    for name, value in texts.items():
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"{name} must not be blank")


def require_share(name: str, value: float) -> float:
    """Values out of range are rejected, not clamped."""
    if not 0 <= float(value) <= 1:
        raise ValueError(f"{name} must lie between 0 and 1, not {value}")
    return float(value)
