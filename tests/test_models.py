import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from statuta import config
from statuta.functions import reports
from statuta.operators import batch, models, vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Spy:
    def __init__(self, **reply):
        self.reply, self.seen = reply, []

    def complete(self, kind, prompt, system, model, **params):
        self.seen.append((kind, prompt, system, model, params))
        return self.reply


def test_call():
    spy = Spy(a=1)
    assert models.call(spy, "p", "answer") == {"a": 1}
    assert spy.seen[0][2] is None and spy.seen[0][4] == {"temperature": 0.1, "max_retries": 3}
    models.call(spy, "p", "answer", system=" ", temperature=0.7)
    assert spy.seen[1][2] is None and spy.seen[1][4]["temperature"] == 0.7
    for client, prompt in ((spy, " "), (None, "p")):
        with pytest.raises(ValueError):
            models.call(client, prompt, "answer")


@pytest.mark.parametrize(("confidence", "good"), [(0.0, True), (1.0, True), (-0.1, False), (1.1, False)])
def test_ranges(confidence, good):
    spy = Spy(is_relevant=True, confidence=confidence, reasoning="", rewritten_query="x", query_type="t")
    for f in (lambda: models.assess(spy, "q", "t"), lambda: models.rewrite(spy, "q")):
        if good:
            f()
        else:
            with pytest.raises(ValueError):
                f()


def test_guards():
    for f in (lambda: models.rewrite(Spy(), " "), lambda: models.rewrite(None, "q"), lambda: models.assess(Spy(), "q", ""), lambda: models.answer(None, "q", "c", 1), lambda: models.answer(Spy(), "", "c", 1)):
        with pytest.raises(ValueError):
            f()
    spy = Spy()
    assert models.answer(spy, "q", "", 0)["confidence"] == 0.0 and spy.seen == []


def test_relevance_filter(spark):
    hits = spark.createDataFrame([(1, "red house", "a red house"), (2, "red house", "MARK red"), (3, "red house", "red"), (4, "red house", "none")], "id long, query string, document string")
    assessed = models.assess_hits(hits, models.FailingClient("MARK"))
    rows = {r["id"]: r["assessment"] for r in assessed.collect()}
    assert rows[1]["confidence"] == 1.0 and rows[3]["confidence"] == 0.5 and not rows[4]["is_relevant"]
    assert not rows[2]["is_relevant"] and rows[2]["confidence"] == 0.0 and "the service failed" in rows[2]["reasoning"]
    assert sorted(r["id"] for r in models.filter_hits(assessed).collect()) == [1, 3]
    counts = models.filter_counts(assessed, [], 0.6).first()
    assert (counts["original_count"], counts["filtered_count"], counts["threshold"]) == (4, 1, 0.6)
    with pytest.raises(ValueError):
        models.filter_hits(assessed, 1.5)


def test_rewrites(spark):
    df = spark.createDataFrame([("May I keep goats?",)], "query string")
    row = models.rewrite_queries(df, models.OfflineClient()).first()
    assert row["query_type"] == "permission" and "goats" in row["rewritten_query"] and row["confidence"] == 0.5


def test_context_and_reports(spark):
    match = F.array(*(F.struct(F.lit(t).alias("segment_text")) for t in ("x", "", "z", "w")))
    block = spark.range(1).select(reports.context_block(F.lit(1), F.lit(None).cast("string"), F.lit(0.25), F.lit(None).cast("string"), match).alias("b")).first()["b"]
    assert block == "\nSection 1: Untitled Section\nRelevance Score: 0.250\nContent: \n\nMatching Segments:\n  - Segment 1: x\n  - Segment 3: z\n"
    full = spark.range(1).select(reports.answer_report(F.lit("Yes"), F.lit(0.9), F.lit("why"), F.array(F.lit("c1"), F.lit("c2")), F.array(F.lit("p1"), F.lit("p2")), F.lit("")).alias("r")).first()["r"]
    assert "90.0%" in full and "1. c1\n2. c2" in full and '2. "p2"' in full and "Limitations" not in full and full == full.strip()
    none = F.array().cast("array<string>")
    bare = spark.range(1).select(reports.answer_report(F.lit("No"), F.lit(0.0), F.lit("r"), none, none, F.lit("much")).alias("r"), reports.short_report(F.lit("No"), F.lit(0.0), none, none).alias("s")).first()
    assert bare["r"].count("available.") == 2 and bare["r"].endswith("### Limitations\nmuch") and "Citations" not in bare["s"]


class Refusing(vectors.HashingProvider):
    def embed(self, texts):
        if any("refuse" in t for t in texts):
            raise RuntimeError("no vector")
        return super().embed(texts)


def test_batch(spark):
    provider = Refusing(16)
    tree = spark.createDataFrame([("J", 0, "# Goats", "Goats are allowed."), ("J", 1, "# Fences", "Fences are low.")], "jurisdiction_id string, section_idx long, heading_text string, body_text string")
    segs = tree.select("jurisdiction_id", F.col("section_idx").alias("section_ref"), F.col("section_idx").alias("segment_idx"), F.lit(0).cast("long").alias("segment_position"), F.col("heading_text").alias("section_heading"), F.col("body_text").alias("segment_text"))
    index = vectors.index_rows(vectors.with_embeddings(segs, provider), keys=["jurisdiction_id"])
    out = batch.run(spark, models.FailingClient("explode"), ["goats", "", "explode", None, "refuse"], "J", tree, index, provider, k=2)
    assert [f.dataType.simpleString() for f in out.schema if f.name in ("confidence", "sections_found", "processing_time")] == ["double", "bigint", "double"]
    rows = out.collect()
    assert [r["query"] for r in rows] == ["goats", "explode", "refuse"] and len(out.columns) == 10
    assert rows[0]["short_answer"] == "# Goats" and rows[0]["sections_found"] == 2 and rows[0]["segments_found"] == 2
    for r, why in ((rows[1], "the service failed"), (rows[2], "no vector")):
        assert why in r["short_answer"] and r["confidence"] == 0.0 and r["sections_found"] == r["segments_found"] == 0 and r["citations"] == []
    nothing = batch.run(spark, models.OfflineClient(), ["goats"], "elsewhere", tree, index, provider).first()
    assert nothing["confidence"] == 0.0 and nothing["short_answer"] == models.NO_ANSWER["short_answer"]
    hyde = batch.run(spark, models.OfflineClient(), ["goats"], "J", tree, index, provider, hyde=True)
    assert hyde.count() == 1 and batch.summary(hyde).first()["answers"] == 1
    for bad in ([], "goats"):
        with pytest.raises(ValueError):
            batch.run(spark, models.OfflineClient(), bad, "J", tree, index, provider)
    with pytest.raises(ValueError):
        batch.run(spark, None, ["q"], "J", tree, index, provider)
    with pytest.raises(ValueError):
        batch.run(spark, models.OfflineClient(), ["q"], " ", tree, index, provider)
    assert batch.run(spark, models.OfflineClient(), ["", None], "J", tree, index, provider).collect() == []


def test_config(monkeypatch, tmp_path):
    for v in ("LLM_PROVIDER", "FAST_MODEL", "POWERFUL_MODEL", "EMBEDDING_MODEL"):
        monkeypatch.delenv(f"STATUTA_{v}", raising=False)
    assert config.llm_provider() == "offline" and config.fast_model() == config.MODELS["offline"][0]
    monkeypatch.setenv("STATUTA_LLM_PROVIDER", "mistral")
    assert config.powerful_model() == config.MODELS["mistral"][1]
    monkeypatch.setenv("STATUTA_POWERFUL_MODEL", "own")
    assert config.powerful_model() == "own"
    monkeypatch.setenv("STATUTA_POWERFUL_MODEL", "")
    assert config.powerful_model() == config.MODELS["mistral"][1]
    monkeypatch.setenv("STATUTA_LLM_PROVIDER", "nobody")
    with pytest.raises(ValueError):
        config.llm_provider()
    with pytest.raises(ValueError):
        config.embedding_model("nobody")
    monkeypatch.delenv("MISTRAL_API_KEY", raising=False)
    with pytest.raises(ValueError):
        config.api_key("mistral")
    (tmp_path / ".env").write_text("# note\nMISTRAL_API_KEY='k'\n")
    config.load_env(str(tmp_path / ".env"))
    assert config.api_key("mistral") == "k" and config.llm_params(temperature=0)["temperature"] == 0
