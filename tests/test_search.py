import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.functions.filters import document_filter, metadata_filter, with_jurisdiction
from statuta.operators import retrieve, vectors


@pytest.fixture()
def index(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{k:02}", f"text {k}", [float(x) for x in rng.integers(-2, 3, 4)], "CA-X" if k % 2 else "NY-Y", k % 5, k) for k in range(40)]
    return spark.createDataFrame(rows, "id string, document string, embedding array<float>, jurisdiction_id string, section_ref long, segment_position long")


def brute(index, vector, k, keep=lambda r: True):
    rows = [(sum((a - b) ** 2 for a, b in zip(r["embedding"], vector, strict=True)), r["id"]) for r in index.collect() if keep(r)]
    return [i for _, i in sorted(rows)[:k]]


def test_topk_with_ties(spark, index):
    queries = spark.createDataFrame([(0, [0.0, 0.0, 0.0, 0.0]), (1, [1.0, 2.0, 0.0, -1.0])], "query_id long, vector array<double>")
    got = retrieve.search(index, queries, 7).orderBy("query_id", "rank").collect()
    for q, v in ((0, [0, 0, 0, 0]), (1, [1, 2, 0, -1])):
        assert [r["id"] for r in got if r["query_id"] == q] == brute(index, v, 7)
        assert [r["id"] for r in retrieve.nearest(index, v, 7).orderBy("rank").collect()] == brute(index, v, 7)
    narrow = retrieve.search(index, queries, 5, jurisdiction="CA-X", where={"section_ref": {"$gte": 2}}, where_document={"$not_contains": "text 1"})
    assert [r["id"] for r in narrow.where("query_id = 1").orderBy("rank").collect()] == brute(index, [1, 2, 0, -1], 5, lambda r: r["jurisdiction_id"] == "CA-X" and r["section_ref"] >= 2 and "text 1" not in r["document"])
    assert retrieve.search(index.where("false"), queries, 3).count() == 0
    assert retrieve.search(index, queries.where("false"), 3).count() == 0


def test_distances_are_summed_from_the_left(spark):
    """Another order of adding differs in the last bit and so in the order of near ties; the SQL adds from the left."""
    rng = np.random.default_rng(7)
    unit = lambda x: (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32).tolist()
    vectors_, (q, *_) = unit(rng.integers(-3, 4, (400, 32)).astype(float)), unit(rng.integers(-3, 4, (1, 32)).astype(float))

    def far(v):
        total = 0.0
        for a, b in zip(v, q, strict=True):
            total += (a - b) * (a - b)
        return total

    index = spark.createDataFrame([(f"i{k:03}", v) for k, v in enumerate(vectors_)], "id string, embedding array<float>")
    queries = spark.createDataFrame([(0, q)], "query_id long, vector array<double>")
    want = sorted((far(v), f"i{k:03}") for k, v in enumerate(vectors_))[:200]
    assert [(r["distance"], r["id"]) for r in retrieve.search(index, queries, 200).orderBy("rank").collect()] == want
    assert [(r["distance"], r["id"]) for r in retrieve.nearest(index, q, 200).orderBy("rank").collect()] == want


def test_vectors_of_a_plan_are_computed_once(spark):
    """Each evaluation has Python workers of its own, beside those of the search."""
    df = spark.createDataFrame([(k, f"text {k}" if k % 3 else None, "h") for k in range(9)], "segment_idx long, segment_text string, section_heading string")
    index = vectors.index_rows(vectors.with_embeddings(df, vectors.HashingProvider(4)), "CA-X")
    index = index.withColumn("embedding", F.when(F.col("id") != "CA-X:4", F.col("embedding")))
    found = retrieve.search(index, spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<double>"), 9)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r["id"] for r in found.collect()) == [f"CA-X:{k}" for k in range(9) if k != 4]


def test_no_vector_at_all(spark, index):
    queries = spark.createDataFrame([(0, [0.0, 0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    assert retrieve.search(index.withColumn("embedding", F.lit(None).cast("array<float>")), queries, 3).count() == 0


def test_more_queries_than_a_block(spark, index, monkeypatch):
    queries = spark.createDataFrame([(k, [float(k % 3), 1.0, -float(k % 2), 0.0]) for k in range(8)] + [(8, None)], "query_id long, vector array<double>")
    want = sorted(map(tuple, retrieve.search(index, queries, 4).collect()))
    monkeypatch.setattr(retrieve, "QUERIES", 3)
    assert sorted(map(tuple, retrieve.search(index, queries, 4).collect())) == want and len(want) == 32


def test_distance_forms(index):
    v = [1.0, 2.0, 0.0, -1.0]
    one = index.select(vectors.squared_distance("embedding", F.array(*(F.lit(float(x)) for x in v))).alias("a"), vectors.squared_distance_to(F.col("embedding"), v).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in one)


def test_compare(index):
    rows = retrieve.compare(index, [0.0, 0.0, 0.0, 0.0], ["CA-X", "none", "NY-Y", "CA-X"], 3).collect()
    assert sorted((r["jurisdiction_id"], r["rank"]) for r in rows if r["rank"]) == [(j, k) for j in ("CA-X", "NY-Y") for k in (1, 2, 3)]
    assert [r["id"] for r in rows if r["jurisdiction_id"] == "none"] == [None]


def sections_of(spark):
    return spark.createDataFrame([(0, "# A", "body", 1, None), (1, "# B", None, 1, None)], "section_idx long, heading_text string, body_text string, heading_level long, parent long")


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, distance double, section_ref long, segment_text string, segment_position long, segment_idx long")


def test_roll_up(spark):
    found = hits_of(spark, [(7, 1, 0.1, 0, "a", 0, 0), (7, 2, 0.2, 1, "b", 0, 3), (7, 3, 0.3, 0, "c", 1, 1), (7, 4, 0.4, None, "d", 0, 9), (7, 5, 0.5, 99, "e", 0, 8)])
    rolled = retrieve.roll_up(found, sections_of(spark), [])
    rows = rolled.orderBy("place").collect()
    assert [(r["section_idx"], r["segment_count"], r["relevance_score"]) for r in rows] == [(0, 2, 0.1), (1, 1, 0.2)]
    assert [m["segment_text"] for m in rows[0]["matching_segments"]] == ["a", "c"]
    queries = spark.createDataFrame([(7, "q"), (8, "none")], "query_id long, query string")
    info = {r["query_id"]: (r["total_segments_found"], r["unique_sections"]) for r in retrieve.query_info(queries, found, rolled).collect()}
    assert info == {7: (5, 2), 8: (0, 0)}
    with pytest.raises(ValueError, match="missing columns"):
        retrieve.roll_up(found, sections_of(spark).drop("heading_text"), [])


def test_stats(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x")], "jurisdiction_id string, state string")
    assert {(r["dimension"], r["key"], r["n"]) for r in retrieve.stats(df).collect()} == {("total", "", 3), ("jurisdiction_id", "a", 2), ("state", "x", 2)}


def test_filters(index):
    n = lambda where: index.where(metadata_filter(where)).count()
    assert n({"section_ref": 1}) == 8 and n({"section_ref": {"$in": [1, 2]}}) == 16 and n({"$or": [{"section_ref": 1}, {"section_ref": {"$gt": 3}}]}) == 16
    assert metadata_filter({}) is None and metadata_filter(None) is None and document_filter(None, F.col("document")) is None
    assert with_jurisdiction("a", {"b": 1}) == {"$and": [{"jurisdiction_id": "a"}, {"b": 1}]} and with_jurisdiction("a", {}) == {"jurisdiction_id": "a"} and with_jurisdiction(None, None) is None
    assert index.where(document_filter({"$regex": "1$"}, F.col("document"))).count() == 4
    for bad in ({"a": {"$near": 1}}, {"$not": []}, {"$and": []}):
        with pytest.raises(ValueError):
            metadata_filter(bad)
    with pytest.raises(ValueError):
        document_filter({"$like": "x"}, F.col("document"))
    plan = index._jdf.queryExecution().toString()
    assert plan


class Broken:
    name, batch = "broken", 2

    def __init__(self, reply):
        self.reply = reply

    def embed(self, texts):
        return self.reply


def test_embedding(spark):
    p = vectors.HashingProvider(8)
    m = vectors.embed_texts(p, [f"text number {k}" for k in range(101)])
    assert m.shape == (101, 8) and m.dtype == np.float32 and np.allclose((m**2).sum(1), 1)
    with pytest.raises(ValueError):
        vectors.embed_texts(p, [])
    for reply in (None, [], [[1.0], []], [[1.0], [1.0, 2.0]], [None, None]):
        with pytest.raises(ValueError):
            vectors.embed_texts(Broken(reply), ["a", "b"])
    df = spark.createDataFrame([("h", "t", 1), ("h", None, 2), (None, "t", 3)], "section_heading string, segment_text string, more int")
    out = vectors.with_embeddings(df, p)
    assert out.columns == [*df.columns, "embedding"] and out.schema["embedding"].dataType.simpleString() == "array<float>"
    assert len(out.collect()) == 3
    assert vectors.with_embeddings(df.where("false"), Broken(None)).count() == 0
    with pytest.raises(ValueError):
        vectors.with_embeddings(df, p, heading="nope")


def test_index(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}", [1.0, float(k)], 3) for k in range(3)], "segment_idx long, segment_text string, embedding array<float>, word_count long")
    index = vectors.VectorIndex(spark, str(tmp_path), "legal_code_all", "hashing")
    assert index.name == "legal_code_hashing" and index.count() == 0
    index.append(vectors.index_rows(df, jurisdiction="ca-X"))
    index.append(vectors.index_rows(df, state="NY", municipality="New York"))
    index.append(vectors.index_rows(df, jurisdiction="ca-X"))
    rows = index.read().orderBy("id").collect()
    assert [r["id"] for r in rows] == sorted([*(f"NY-NewYork:{k}" for k in range(3)), *(f"ca-X:{k}" for k in range(3))])
    assert {(r["state"], r["municipality"], r["word_count"]) for r in rows} == {("ca", "X", 3), ("NY", "New York", 3)}
