"""The registered queries over the smallest tables, against SQL or brute force, and over empty ones."""

import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
import corpus_pipeline
from statuta.llm import near_dedup, pieces, token_shards
from test_native import brute_near, plain_base

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
NAMES = sorted(n for n in __spark_entry__.queries() if re.match(r"op[0-9]+_", n))


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def rows_of(spark, name, folder=DATA):
    return __spark_entry__.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", ["op4_line_dedup", "op9_url_filters"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(repr([r[x] for x in want.columns]) for r in got.collect()) == sorted(repr(list(r)) for r in want.fetchall())


def test_tokens_and_pieces(spark, texts):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(token_shards.tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    start, want = 0, []
    for i in sorted(texts):
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in rows_of(spark, "op5_token_shards")) == want
    ids = {i: sp.encode(t or "") for i, t in texts.items()}
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op2_sentencepiece")) == sorted((i, len(x), crc(x)) for i, x in ids.items())


def test_links_and_base_spans(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(spark, "op7_minhash_near_dedup")}
    assert got == brute_near(sorted(texts.items()))
    for r in rows_of(spark, "op8_personal_data"):
        base = plain_base(texts[r["doc_id"]] or "")
        spans = set(filter(None, r["spans"].split(",")))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= spans and len(spans) == r["n_spans"]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(k == x for x, _, _ in base) for k in ("email", "ip", "card", "phone")]


def test_leaks_of_the_benchmark(spark, texts):
    """What shares a run of words with an item must be found."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = {}
    for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        runs[r["item_id"]] = " ".join(w)
    want = {(d, i) for d, t in texts.items() for i, w in runs.items() if w and f" {w} " in f" {' '.join(words(t))} "}
    assert want <= {(r["doc_id"], r["item_id"]) for r in rows_of(spark, "op3_decontamination")}


def test_the_pipeline(spark, texts):
    got = corpus_pipeline.run(spark, DATA).collect()
    assert 0 < len(got) == len({r["doc_id"] for r in got}) and {r["doc_id"] for r in got} <= set(texts) and all(r["round_trip"] for r in got)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        pq.write_table(pq.read_schema(f"{DATA}/{t}.parquet").empty_table(), f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert rows_of(spark, name, empty) == []


def test_pipeline_of_empty_tables(spark, empty, tmp_path):
    assert corpus_pipeline.run(spark, empty).collect() == []
    for t in ("labels", "benchmark"):
        os.symlink(f"{empty}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    text = " ".join(f"word{k}" for k in range(30))
    pq.write_table(pa.table({"doc_id": [1, 2, None], "text": [text, text, None], "lang": ["en"] * 3, "source": ["s"] * 3, "n_chars": [1, 1, 1]}), f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1]


def test_all_ten_are_registered():
    assert [sum(n.startswith(f"op{k}_") for n in NAMES) for k in range(1, 11)] == [1] * 10 and near_dedup.PERCENT == 75
