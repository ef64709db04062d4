import pytest
from pyspark.sql import functions as F

from statuta.operators import sections


def divide(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc long, markdown string")
    return sections.divide(df, ["doc"]).orderBy("doc", "section_idx").collect()


def test_levels_and_bodies(spark):
    rows = divide(spark, "# A\none\ntwo\n## B\nx\n### C\ny\n## D\nz\n")
    assert [(r["section_idx"], r["heading_level"], r["heading_text"], r["body_text"]) for r in rows] == [
        (0, 1, "# A", "one\ntwo"), (1, 2, "## B", "x"), (2, 3, "### C", "y"), (3, 2, "## D", "z"),
    ]


def test_bodies_may_be_missing(spark):
    assert [r["body_text"] for r in divide(spark, "# A\n# B\n# C\ntext\n# D")] == [None, None, "text", None]


def test_no_sections(spark):
    assert divide(spark, "", "   \n ", "plain\ntext", None) == []


def test_preamble_and_white_space(spark):
    rows = divide(spark, "before\n\n# A\n   one  \n  \n\t two\n")
    assert [(r["heading_text"], r["body_text"]) for r in rows] == [("# A", "one\n\ntwo")]


def test_parents(spark):
    for levels, want in (
        ([1, 2, 3, 2, 4, 3], [None, 0, 1, 0, 3, 3]),
        ([1, 2, 3, 4, 3, 2, 3, 1, 2], [None, 0, 1, 2, 1, 0, 5, None, 7]),
        ([1, 2, 3, 4, 5, 6], [None, 0, 1, 2, 3, 4]),
        ([1, 2, 2, 2], [None, 0, 0, 0]),
        ([2, 1, 3], [None, None, 1]),
    ):
        df = spark.createDataFrame([(0, k, lv, "kept") for k, lv in enumerate(levels)], "doc long, section_idx long, heading_level long, more string")
        rows = sections.with_parents(df, ["doc"]).orderBy("section_idx").collect()
        assert [r["parent"] for r in rows] == want
        assert {r["more"] for r in rows} == {"kept"}


def test_many_sections(spark):
    rows = divide(spark, "".join(f"## S{k}\nbody {k}\n" for k in range(100)))
    assert [r["section_idx"] for r in rows] == list(range(100))


def test_paths(spark):
    df = spark.createDataFrame([(0, k, lv) for k, lv in enumerate([1, 2, 3, 4, 5, 6, 1])], "doc long, section_idx long, heading_level long")
    tree = sections.with_parents(df, ["doc"])
    paths = {r["section_idx"]: r["path"] for r in sections.ancestor_path(tree, ["doc"]).collect()}
    assert paths[5] == [0, 1, 2, 3, 4, 5] and paths[6] == [6]
    assert {r["section_idx"]: r["children"] for r in sections.children_count(tree, ["doc"]).collect()}[0] == 1


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns: section_idx"):
        sections.with_parents(spark.range(1).select(F.lit(1).alias("heading_level")), [])
    with pytest.raises(TypeError):
        sections.divide("text", [])
