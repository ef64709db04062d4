import io
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from statuta import cli
from statuta.operators import ingest, models, vectors
from statuta.sources import files, sinks
from statuta.streaming import ingest as stream

LEVELS = ingest.HeadingStructure([ingest.HeadingLevel(2, r"SECTION \d+", "##"), ingest.HeadingLevel(1, r"(?:CHAPTER|TITLE) [IVX]+", "#"), ingest.HeadingLevel(3, r"\(\w\)", "###")])


def markdown(spark, text, structure=LEVELS):
    row = ingest.to_markdown(spark.createDataFrame([(0, text)], "doc long, text string"), ["doc"], structure).first()
    return row["markdown"] if row else None


def test_headings_and_paragraphs(spark):
    text = "TITLE I\nfirst line\nsecond line\n\n\nSECTION 1. Name\n  (a) sub\ntext\nlast"
    assert markdown(spark, text) == "# TITLE I\nfirst line second line\n\n\n## SECTION 1. Name\n### (a) sub\ntext last\n"
    assert markdown(spark, "only\r\ntext\r\n") == "only text\n" and markdown(spark, "") is None
    assert markdown(spark, "see SECTION 1") == "see SECTION 1\n"


def test_bad_structures(spark):
    for bad in (None, ingest.HeadingStructure(), ingest.HeadingStructure([ingest.HeadingLevel(1, "(", "#")])):
        with pytest.raises(ValueError):
            markdown(spark, "x", bad)


class Levels:
    def __init__(self, levels):
        self.levels = levels

    def complete(self, kind, prompt, system, model, **params):
        assert "line 149" in prompt and "line 150" not in prompt
        return {"levels": self.levels, "total_levels": 99}


def test_detection():
    text = "".join(f"line {k}\n" for k in range(200))
    good = {"level": 1, "regex_pattern": "^line", "markdown_prefix": "#"}
    found = ingest.detect_headings(Levels([good]), text)
    assert (found.total_levels, found.file_sample_size) == (1, 150)
    for client, t in ((Levels([good | {"regex_pattern": "["}]), text), (Levels([good]), ""), (None, text)):
        with pytest.raises(ValueError):
            ingest.detect_headings(client, t)


def test_front_matter(spark):
    text = ingest.front_matter(LEVELS, " ca ", "LosAngeles", datetime(2024, 1, 2, tzinfo=timezone.utc))
    assert text.startswith("---\njurisdiction:\n") and 'state: "CA"' in text and 'full_name: "CA - LosAngeles"' in text and text.endswith("---\n\n")
    strip = lambda t: spark.createDataFrame([(t,)], "t string").select(ingest.strip_front_matter(F.col("t")).alias("x")).first()["x"]
    assert strip(text + "# A\nb\n") == "# A\nb"
    assert strip("---\nnever closed\n") == "---\nnever closed\n" and strip(" --- \na\n---\t\n\n x ") == "x" and strip("a\n---\nb\n---\n") == "a\n---\nb\n---\n"
    for a, b in ((" ", "x"), ("CA", "")):
        with pytest.raises(ValueError):
            ingest.front_matter(LEVELS, a, b)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\ny\n".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    assert files.read_document(spark, str(tmp_path / "a.txt")).first()["text"] == "x\ny\n"
    with pytest.raises(FileNotFoundError):
        files.read_document(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError, match="not a file"):
        files.read_document(spark, str(tmp_path))
    with pytest.raises(Exception, match="not UTF-8"):
        files.read_document(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "q.txt").write_text("one\n\n\n two\nlines \n\n  \n\nthree")
    assert [r["query"] for r in files.read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()] == ["one", "two\nlines", "three"]
    assert files.head(files.read_document(spark, str(tmp_path / "q.txt")), 1).first()["text"] == "one"


def test_word_documents(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
    for name, text in (("b", "second"), ("a", "first &amp;nbsp;x")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("word/document.xml", body.format(f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p><w:p/>"))
        (tmp_path / f"{name}.docx").write_bytes(data.getvalue())
    assert files.concatenate(files.read_docx(spark, str(tmp_path))).first()["text"] == "first  x\n\n\n\nsecond\n\n\n\n"


def test_command_line(spark, tmp_path):
    root = str(tmp_path / "data")
    assert cli.main(["layout", "CA-Los Angeles", "--root", root]) == 0 and cli.main(["layout", "CA-Los Angeles", "--root", root]) == 0
    folder = tmp_path / "data/laws/CA-LosAngeles"
    assert sorted(p.name for p in folder.iterdir()) == ["processed", "raw", "tables"]
    assert cli.main(["convert", "CA-LosAngeles", "--root", root]) == 1 and cli.main(["convert", "nohyphen", "--root", root]) == 1 and cli.main(["segment", "NY-None", "--root", root]) == 1
    (folder / "processed/code.txt").write_text("CHAPTER I\n\nSECTION 1 Goats\nGoats may\nbe kept.\n\nSECTION 2 Fences\nLow ones only.\n")
    (tmp_path / "levels.json").write_text('{"levels": [{"level": 1, "regex_pattern": "CHAPTER", "markdown_prefix": "#"}, {"level": 2, "regex_pattern": "SECTION", "markdown_prefix": "##"}]}')
    assert cli.main(["convert", "CA-LosAngeles", "--root", root, "--structure", str(tmp_path / "levels.json")]) == 0
    assert "## SECTION 1 Goats\nGoats may be kept.\n" in (folder / "processed/code.md").read_text()
    assert cli.main(["segment", "CA-LosAngeles", "--root", root]) == 0 and cli.main(["embed", "CA-LosAngeles", "--root", root]) == 0
    (tmp_path / "q.txt").write_text("May goats be kept?\n\nfences")
    assert cli.main(["query", "CA-LosAngeles", "--root", root, "--questions", str(tmp_path / "q.txt"), "--output", str(tmp_path / "out.parquet"), "-k", "1"]) == 0
    rows = spark.read.parquet(str(tmp_path / "out.parquet")).collect()
    assert {r["short_answer"] for r in rows} == {"## SECTION 1 Goats", "## SECTION 2 Fences"}


def test_stream_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("CA-X", "d1", "# A\nsome text"), ("CA-X", "d2", "# B\nmore text\n# C\nlast")], stream.SCHEMA)
    docs.write.parquet(str(tmp_path / "in"))
    index = vectors.VectorIndex(spark, str(tmp_path), "codes")
    for checkpoint in ("c1", "c2"):
        stream.start(stream.stream_documents(spark, str(tmp_path / "in")), index, vectors.HashingProvider(8), str(tmp_path / checkpoint)).awaitTermination(120)
        assert index.count() == 3


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "jurisdiction_id string, markdown string")
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_table(df.where("jurisdiction_id = 'a'").withColumn("markdown", F.lit("z")), str(tmp_path / "t"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("jurisdiction_id", "markdown").collect()} == {("a", "z"), ("b", "y")}
    sinks.write_markdown(df, str(tmp_path / "m"), "---\n---\n", partition="jurisdiction_id")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "m"), wholetext=True).collect()) == ["---\n---\nx\n", "---\n---\ny\n"]


def test_offline_client_refuses_other_kinds():
    with pytest.raises(ValueError):
        models.OfflineClient().complete("song", "p", None, None)


def test_counts_per_window(spark):
    from statuta.streaming.ingest import events_per_window

    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:59", "a"), ("2024-01-01 00:10:00", "b")], "t string, kind string").selectExpr("timestamp(t) AS t", "kind")
    got = [(r["window"]["start"].minute, r["kind"], r["n"]) for r in events_per_window(rows, "t", by="kind").orderBy("window.start").collect()]
    assert got == [(0, "a", 2), (10, "b", 1)]
