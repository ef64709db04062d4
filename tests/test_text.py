"""The text expressions against Python's own rules (white space, lines, headings)."""

import re
import sys

import pytest
from pyspark.sql import functions as F

from statuta.functions import text as tx

SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
SAMPLES = ["", " ", "a", "  a b ", " x　", "a b", "\x1cq\x1f", "line\r\n\r\nnext", "One. Two!  Three?Four", "# T", "#  T", "####### no", "#x", " # x", "# ", "## y z \r", "a\n\n b \n \t\n\nc", "tail.\n", "...", "# A B"]


def column(spark, texts, expression):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [r["x"] for r in df.select("k", expression(F.col("t")).alias("x")).orderBy("k").collect()]


def test_all_29_spaces(spark):
    assert len(SPACES) == 29
    texts = [f"{s}a{s}b{s}" for s in SPACES]
    assert column(spark, texts, tx.strip) == [t.strip() for t in texts]
    assert column(spark, texts, tx.word_count) == [2] * 29


@pytest.mark.parametrize(
    ("expression", "python"),
    [
        (tx.strip, str.strip),
        (tx.word_count, lambda t: len(t.split())),
        (tx.is_blank, lambda t: not t.strip()),
        (tx.paragraphs, lambda t: [p.strip() for p in re.split(r"\n\s*\n", t.strip()) if p.strip()]),
        (tx.sentences, lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]),
        (tx.strip_lines, lambda t: "\n".join(x.strip() for x in t.split("\n")).strip()),
        (tx.is_heading, lambda t: bool(re.match(r"^(#{1,6})\s+(.+)$", t.split("\n")[0])) if "\n" not in t else None),
    ],
)
def test_like_python(spark, expression, python):
    got = column(spark, SAMPLES, expression)
    for text, x in zip(SAMPLES, got, strict=True):
        if (want := python(text)) is not None:
            assert x == want, text


def test_heading_parts(spark):
    assert column(spark, ["#  T  x ", "###\tabc"], tx.heading_text) == ["# T  x ", "### abc"]
    assert column(spark, ["#  T", "######\tabc"], tx.heading_level) == [1, 6]


def test_names():
    assert tx.make_jurisdiction_id(" ca ", "Los Angeles") == "CA-LosAngeles"
    for state, place in (("", "x"), ("CA", " "), ("C!", "x")):
        with pytest.raises(ValueError):
            tx.make_jurisdiction_id(state, place)
    assert tx.collection_name("legal_code_all", "mistral") == "legal_code_mistral"
    assert tx.collection_name("a_mistral", "mistral") == "a_mistral"
    assert tx.collection_name("a", None) == "a"


def test_patterns():
    assert tx.java_pattern("(?P<n>a)(?P=n)") == r"(?<n>a)\k<n>"
    with pytest.raises(ValueError, match="invalid pattern"):
        tx.java_pattern("(")
