"""The pipeline stage by stage: each acts on what the one before it kept, and keeps clean documents."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from statuta.llm import decontaminate

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ko", "lu", "mi", "se", "ta") for b in ("ran", "tel", "vor", "nis", "dap", "kem", "pol")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line = "All rights to this line are kept by whoever wrote it first."
    item = f"{text(25)}. {text(8)} answer."
    rows, marks = [], []
    for k in range(700):
        body = text(rng.randint(40, 120))
        if k % 7 == 0:
            w = body.split()
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["snarl", "grubble", "vexing"]))
            body = " ".join(w)
        rows.append((k, body))
        marks.append((k, int(k % 7 == 0)))
    rows += [(1000 + k, f"{text(60)}\n{line}\n{text(60)}") for k in range(8)]
    copy = text(100)
    rows += [(2000 + k, copy + (" end" if k else "")) for k in range(5)]
    rows += [(3000, f"{text(30)} {item} {text(30)}"), (4000, None), (4001, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert after.columns == docs.columns if k < 4 else after.columns[0] == "doc_id"
        now = after
        seen.append({r["doc_id"] for r in now.select("doc_id").collect()})
    toxic = {i for i, t in marks if t}
    everything = {i for i, _ in rows}
    assert len(toxic & seen[0]) <= 5 and len((everything - toxic) - seen[0]) <= 3
    assert seen[1] == seen[0]
    lines = spark.read.parquet(f"{tmp_path}/stage1").where(F.col("text").contains(line))
    assert [r["doc_id"] for r in lines.collect()] == [1007]
    assert spark.read.parquet(f"{tmp_path}/stage1").where("n_chars <> length(text)").count() == 0
    assert seen[1] - seen[2] == {2001, 2002, 2003, 2004} and seen[2] - seen[3] == {3000} and seen[4] == seen[3]
    assert now.where("not round_trip").count() == 0


def test_decontamination_learns_from_all_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    item = " ".join(words[:24])
    # Windows with a word of the item: one of each even text of less than 33 words, two of each odd one; the last texts have none.
    rows = [(k, " ".join(rng.choices(words[:40], k=(20, 40)[k % 2]))) for k in range(4_000)]
    rows += [(9_000 + k, "foreign words only") for k in range(50)] + [(9_100, None), (9_101, f"before it {item} after it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, product = [], decontaminate.gram_product

    def counted(*args):
        seen.append(product(*args))
        return seen[-1]

    monkeypatch.setattr(decontaminate, "gram_product", counted)
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert {n for _, n in seen} == {2_000 + 2 * 2_000 + 1} and len(seen) == 2
    assert 9_101 not in kept and {9_000, 9_049, 9_100} <= kept


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
