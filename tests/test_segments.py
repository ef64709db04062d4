import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.operators import segments

WORDS = st.text(alphabet="ab .!?\n\t", max_size=200)


@given(WORDS, st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_chunks_keep_words_and_limit(text, limit):
    out = segments.chunk_text(text, limit)
    assert [w for s in out for w in s.split()] == text.split()
    assert all(0 < len(s.split()) <= limit for s in out)


def test_python_and_expression_agree(spark):
    texts = ["", " \n ", "One two. Three four five! Six\n\nseven eight nine ten eleven twelve thirteen", "a " * 100, "x.\n\n\n y. z.", "a.b c.  d? e", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    for limit in (1, 2, 3, 5, 39):
        got = df.select("k", segments.chunk_column(F.col("t"), limit).alias("x")).orderBy("k").collect()
        assert [r["x"] for r in got] == [segments.chunk_text(t, limit) if t else [] for t in texts], limit


def test_long_texts_by_expression(spark, monkeypatch):
    """Segments come from patterns and not from a fold in interpreted lambdas, up to the limit where Java's stack is safe; both agree with Python."""
    texts = ["word " * 5000, "One two. " * 3000 + "x " * 70 + "end! Next", " ".join(f"w{k}{'.' if k % 97 == 0 else ''}" for k in range(4000)), "é ü. \u3000a\u00a0b\x85c\n d!  e\x1cf? " * 300, "!? . .. a.b ? " * 200, "a.  b\tc. d\n" + "e\n f.\x0bg " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for limit in (1, 7, 50, 1000, 1001):
        cut = df.select("k", segments.chunk_column(F.col("t"), limit).alias("x")).orderBy("k")
        assert [r["x"] for r in cut.collect()] == [segments.chunk_text(t, limit) for t in texts], limit
        assert ("aggregate(" in cut._jdf.queryExecution().analyzed().toString()) == (limit > segments.DEEP)
    monkeypatch.setattr(segments, "DEEP", 0)
    cut = df.select("k", segments.chunk_column(F.col("t"), 50).alias("x")).orderBy("k")
    assert [r["x"] for r in cut.collect()] == [segments.chunk_text(t, 50) for t in texts]


def test_boundary():
    assert segments.word_limit(1024, 0.78) == 798 and segments.word_limit(50) == 39
    assert len(segments.chunk_text("w " * 39, 39)) == 1
    assert segments.chunk_text("a b.\n\nc d.\n\ne f.", 40) == ["a b.", "c d.", "e f."]


def test_bad_limits():
    for bad in (0, -5):
        with pytest.raises(ValueError):
            segments.word_limit(bad)
        with pytest.raises(ValueError):
            segments.word_limit(10, bad)
    with pytest.raises(TypeError):
        segments.word_limit("ten")
    with pytest.raises(ValueError):
        segments.word_limit(1, 0.5)


@pytest.fixture()
def tree(spark):
    rows = [(0, 1, "# A", "two words"), (1, 2, "## B", None), (2, 2, "## C", ""), (3, 2, "## D", "one. two three four five six seven. eight")]
    return spark.createDataFrame([("CA-X", *r) for r in rows], "jurisdiction_id string, section_idx long, heading_level long, heading_text string, body_text string")


def test_flat_table(tree):
    rows = segments.flatten(tree, ["jurisdiction_id"], token_limit=6).orderBy("segment_idx").collect()
    assert [r["segment_idx"] for r in rows] == list(range(len(rows)))
    assert [r["section_ref"] for r in rows][:1] == [0] and {r["section_ref"] for r in rows} == {0, 3}
    assert [r["segment_position"] for r in rows if r["section_ref"] == 3] == list(range(len(rows) - 1))
    assert all(r["word_count"] == len(r["segment_text"].split()) <= 4 for r in rows)


def test_attach_both_ways(tree):
    a = segments.attach(tree, ["jurisdiction_id"], token_limit=6)
    b = segments.attach_by_join(tree, segments.flatten(tree, ["jurisdiction_id"], token_limit=6), ["jurisdiction_id"])
    assert a.columns == b.columns and a.columns[0] == "section_idx"
    x, y = (df.orderBy("section_idx").collect() for df in (a, b))
    assert x == y
    assert [r["segment_count"] for r in x] == [1, 0, 0, 4] and x[1]["segments"] == [] and x[2]["total_words"] == 0


def test_no_rows(tree):
    none = tree.where("false")
    assert segments.flatten(none, ["jurisdiction_id"]).count() == 0
    assert segments.aggregate(segments.flatten(none, ["jurisdiction_id"]), ["jurisdiction_id"]).count() == 0


def test_custom_column_and_missing(tree):
    own = tree.withColumnRenamed("body_text", "custom_text")
    assert segments.flatten(own, ["jurisdiction_id"], text="custom_text").count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        segments.flatten(own, ["jurisdiction_id"])
