"""Registered queries and their SQL counterparts, by the operators that they exercise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, reports
from ..functions import text as tx
from ..operators import batch, ingest, models, retrieve, sections, segments, vectors
from ..sources import files
from . import corpora
from .corpora import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
LEVELS = ingest.HeadingStructure([ingest.HeadingLevel(1, r"Turn [0-9]+ system", "#"), ingest.HeadingLevel(2, r"(?:Turn|Part) [0-9]+", "##")])


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


W = "WITH "
_tree = W + corpora.SQL_REGIONS + "," + corpora.sql_sections("region") + "," + corpora.sql_parents("region")
_secs = W + corpora.SQL_CONVERSATIONS + "," + corpora.sql_sections("conv_id")
_join = lambda c: F.array_join(c, "|")


@register(f"{_secs} SELECT * FROM secs")
def sections_from_markdown(spark: SparkSession, d: str) -> DataFrame:
    return corpora.conversation_sections(spark, d)


@register(f"{_tree} SELECT region, section_idx, heading_level, heading_text, parent FROM tree")
def section_parents_windows(spark: SparkSession, d: str) -> DataFrame:
    return corpora.region_sections(spark, d).drop("body_text")


@register(f"{_tree} SELECT a.region, a.section_idx, count(b.section_idx) AS children FROM tree a LEFT JOIN tree b ON a.region = b.region AND b.parent = a.section_idx GROUP BY ALL")
def section_children_count(spark: SparkSession, d: str) -> DataFrame:
    return sections.children_count(corpora.region_sections(spark, d), ["region"])


@register(
    f"""{_tree} SELECT a.region, a.section_idx, concat_ws('|', c.section_idx, b.section_idx, a.section_idx) AS path FROM tree a
LEFT JOIN tree b ON a.region = b.region AND a.parent = b.section_idx LEFT JOIN tree c ON b.region = c.region AND b.parent = c.section_idx"""
)
def section_ancestor_path(spark: SparkSession, d: str) -> DataFrame:
    out = sections.ancestor_path(corpora.region_sections(spark, d), ["region"])
    return out.withColumn("path", _join(F.col("path").cast("array<string>")))


_wide = "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"


def _doubled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@register(f"WITH w AS ({_wide}) SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(trim(text, {corpora.SPACES}), '\\n\\s*\\n'), lambda x: trim(x, {corpora.SPACES})), lambda x: x <> '')) AS paragraph FROM w")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return _doubled(spark, d).select("doc_id", F.explode(tx.paragraphs(F.col("text"))).alias("paragraph"))


@register(f"SELECT doc_id, len(s) AS n, array_to_string(s, '|') AS whole FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {corpora.SPACES})), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), _join("s").alias("whole"))


@register("SELECT source, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words, round(avg(len(regexp_extract_all(text, '\\S+'))), 6) AS mean, max(len(regexp_extract_all(text, '\\S+'))) AS most FROM documents GROUP BY source")
def word_count_stats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("source", tx.word_count(F.col("text")).alias("n"))
    return n.groupBy("source").agg(F.sum("n").alias("words"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


def _chunks(spark: SparkSession, d: str, tokens: int, python: bool) -> DataFrame:
    docs = _doubled(spark, d).select("doc_id", F.posexplode(segments.chunk(F.col("text"), tokens, python=python)).alias("segment_position", "segment_text"))
    return docs.select("doc_id", F.col("segment_position").cast("long").alias("segment_position"), tx.word_count(F.col("segment_text")).alias("word_count"), "segment_text")


def _chunk_sql(tokens: int) -> str:
    return f"WITH w AS ({_wide}), {corpora.sql_chunks('w', 'doc_id', 'text', int(tokens * 0.78))} SELECT doc_id, pos AS segment_position, {corpora.wc('seg')} AS word_count, seg AS segment_text FROM chunks"


@register(_chunk_sql(1024))
def chunk_segments(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, 1024, True)


@register(_chunk_sql(65))
def chunk_small_limit(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, 65, True)


@register(_chunk_sql(65))
def chunk_without_python(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, 65, False)


@register(f"{W}{corpora.SQL_SEGMENTS} SELECT * FROM segs")
def segments_table(spark: SparkSession, d: str) -> DataFrame:
    return corpora.conversation_segments(spark, d)


_attached = f"""{W}{corpora.SQL_SEGMENTS} SELECT conv_id, section_idx, coalesce(string_agg(segment_text, '|' ORDER BY segment_position), '') AS segments,
  count(segment_text) AS segment_count, coalesce(sum(word_count), 0)::BIGINT AS total_words FROM secs LEFT JOIN (SELECT conv_id, section_ref AS section_idx, segment_position, segment_text, word_count FROM segs) USING (conv_id, section_idx) GROUP BY ALL"""


@register(_attached)
def section_segment_join(spark: SparkSession, d: str) -> DataFrame:
    out = segments.attach_by_join(corpora.conversation_sections(spark, d), corpora.conversation_segments(spark, d), ["conv_id"])
    return out.select("conv_id", "section_idx", _join("segments").alias("segments"), "segment_count", "total_words")


@register(_attached)
def section_segments_attach(spark: SparkSession, d: str) -> DataFrame:
    out = segments.attach(corpora.conversation_sections(spark, d), ["conv_id"], token_limit=corpora.TOKENS)
    return out.select("conv_id", "section_idx", _join("segments").alias("segments"), "segment_count", "total_words")


def _plain(spark: SparkSession, d: str) -> DataFrame:
    turn = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), "text", F.lit("\n\n"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", turn.alias("t"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("text"))


_merged = f"""WITH src AS (SELECT conv_id, string_agg('Turn ' || turn || ' ' || role || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
body AS (SELECT conv_id, regexp_replace(text, '\\n$', '') AS t FROM src),
ln AS (SELECT conv_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS n FROM body),
own AS (SELECT *, trim(line, {corpora.SPACES}) AS s FROM ln),
kinds AS (SELECT *, CASE WHEN regexp_matches(s, '^(?:Turn [0-9]+ system)') THEN '# ' || s WHEN regexp_matches(s, '^(?:(?:Turn|Part) [0-9]+)') THEN '## ' || s END AS h FROM own),
marked AS (SELECT *, CASE WHEN h IS NOT NULL THEN 'h' WHEN s = '' THEN 'b' ELSE 't' END AS k FROM kinds),
runs AS (SELECT *, sum(CASE WHEN k <> 't' OR prev <> 't' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS r FROM (SELECT *, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY n), '') AS prev FROM marked)),
merged AS (SELECT conv_id, min(n) AS line_no, coalesce(max(h), string_agg(s, ' ' ORDER BY n)) AS line FROM runs GROUP BY conv_id, r)"""


@register(f"{_merged} SELECT conv_id, line_no, line FROM merged")
def paragraph_run_merge(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.merge_paragraphs(ingest.to_lines(_plain(spark, d), ["conv_id"], "text"), ["conv_id"], LEVELS.levels)
    return out.withColumn("line_no", F.col("line_no").cast("long"))


@register(f"{_merged} SELECT conv_id, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS markdown FROM merged GROUP BY conv_id")
def text_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return ingest.to_markdown(_plain(spark, d), ["conv_id"], LEVELS)


@register(f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '---' || chr(10) || text ELSE trim(text, {corpora.SPACES}) END AS body FROM documents")
def frontmatter_strip(spark: SparkSession, d: str) -> DataFrame:
    """Two of three documents have a block; that of every third has no end."""
    head = F.when(F.col("doc_id") % 3 == 2, "---\n").when(F.col("doc_id") % 3 == 1, "--- \nstate: CA\n---  \n\n").otherwise("---\na: b\n\nc: d\n---\n")
    return table(spark, d, "documents").select("doc_id", ingest.strip_front_matter(F.concat(head, "text")).alias("body"))


@register("SELECT page_id, replace(replace(replace(html, '&nbsp;', ' '), '&ndash;', '-'), '&sect;', '§') AS html FROM (SELECT page_id, replace(replace(html, '&amp;', '&nbsp;'), '&copy;', '&sect;') AS html FROM pages)")
def entity_cleanup(spark: SparkSession, d: str) -> DataFrame:
    marked = F.replace(F.replace("html", F.lit("&amp;"), F.lit("&nbsp;")), F.lit("&copy;"), F.lit("&sect;"))
    return table(spark, d, "pages").select("page_id", tx.clean_entities(marked).alias("html"))


@register(f"{_secs} SELECT conv_id, section_idx, concat_ws(chr(10) || chr(10), nullif(heading_text, ''), nullif(body_text, '')) AS input FROM secs")
def embedding_input_text(spark: SparkSession, d: str) -> DataFrame:
    return corpora.conversation_sections(spark, d).select("conv_id", "section_idx", reports.embedding_input(F.col("heading_text"), F.col("body_text")).alias("input"))


@register("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS head, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS preview FROM documents")
def head_and_preview(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import head

    docs = table(spark, d, "documents").select("doc_id", "text")
    return head(docs.withColumn("whole", F.col("text")), 3).select("doc_id", F.col("text").alias("head"), tx.preview(F.col("whole"), 40).alias("preview"))


# Search over the table of vectors.  The vector of row 0 is the question, or those of the first rows.

_q0 = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)"
_d0 = f"e AS (SELECT vec_id, label, {corpora.distance('embedding', 'v')} AS dist FROM embeddings, q)"


def _first(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("id", F.col("vec_id"))


@register(f"WITH {_q0}, {_d0} SELECT vec_id, label, round(dist, 6) AS distance, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM e QUALIFY rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    out = retrieve.nearest(_vectors(spark, d), _first(spark, d), 10)
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _search(spark: SparkSession, d: str, **options) -> DataFrame:
    queries = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    index = options.pop("index", None)
    out = retrieve.search(_vectors(spark, d) if index is None else index, queries, 10, text=options.pop("text", "label"), **options)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


def _search_sql(where: str = "true", source: str = "embeddings") -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
e AS (SELECT query_id, vec_id, {corpora.distance("embedding", "v")} AS dist FROM {source} src, q WHERE {where})
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank, vec_id, round(dist, 6) AS distance FROM e QUALIFY rank <= 10"""


@register(_search_sql())
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d)


@register(_search_sql("label = 3"))
def topk_with_equality_filter(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, where={"label": 3})


@register(_search_sql("label IN (1, 4)"))
def topk_with_in_filter(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, where={"label": {"$in": [1, 4]}})


@register(_search_sql("label NOT IN (1, 4) AND label <> 2"))
def topk_with_not_in_filter(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, where={"label": {"$nin": [1, 4], "$ne": 2}})


@register(_search_sql("(label = 3 OR label = 5) AND vec_id > 20"))
def topk_with_and_or_filter(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, where={"$and": [{"$or": [{"label": 3}, {"label": {"$eq": 5}}]}, {"vec_id": {"$gt": 20}}]})


@register(_search_sql("label >= 2 AND label < 7 AND vec_id <= 300"))
def topk_with_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, where={"label": {"$gte": 2, "$lt": 7}, "vec_id": {"$lte": 300}})


_texts = "(SELECT vec_id, embedding, text FROM embeddings JOIN documents ON vec_id = doc_id)"


@register(_search_sql("contains(text, 'the') AND NOT contains(text, 'idiot') AND regexp_matches(text, '[.!?]')", _texts))
def document_content_filter(spark: SparkSession, d: str) -> DataFrame:
    both = _vectors(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return _search(spark, d, index=both, text="text", where_document={"$and": [{"$contains": "the"}, {"$not_contains": "idiot"}, {"$regex": "[.!?]"}]})


@register(f"WITH {_q0}, {_d0} SELECT label::VARCHAR AS grp, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank, vec_id, round(dist, 6) AS distance FROM e WHERE label IN (1, 2, 7) QUALIFY rank <= 5 UNION ALL SELECT 'none', NULL, NULL, NULL")
def compare_groups_topn(spark: SparkSession, d: str) -> DataFrame:
    index = _vectors(spark, d).withColumn("grp", F.col("label").cast("string"))
    out = retrieve.compare(index, _first(spark, d), ["7", "1", "2", "1", "none"], 5, group="grp")
    return out.select("grp", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


@register("""SELECT 'total' AS dimension, '' AS key, count(*) AS n FROM documents UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source
UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.stats(table(spark, d, "documents"), ("source", "lang"))


@register("SELECT array_to_string(list_sort(list(DISTINCT source)), '|') AS source, array_to_string(list_sort(list(DISTINCT lang)), '|') AS lang FROM documents")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.distinct_values(table(spark, d, "documents"), ["source", "lang"]).select(_join("source").alias("source"), _join("lang").alias("lang"))


@register(f"""{W}{corpora.SQL_ROLLED} SELECT query_id, place, conv_id, section_idx, heading_text, coalesce(body_text, '') AS body_text, round(relevance_score, 6) AS relevance_score, segment_count,
  array_to_string(seg_texts, '|') AS segments FROM rolled""")
def section_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Markdown to sections, segments and vectors; the nearest segments of every question; their sections."""
    out = corpora.rolled(spark, d)
    return out.select(
        "query_id", F.col("place").cast("long").alias("place"), "conv_id", "section_idx", "heading_text", F.coalesce("body_text", F.lit("")).alias("body_text"), F.round("relevance_score", 6).alias("relevance_score"), "segment_count",
        _join(F.transform("matching_segments", lambda m: m["segment_text"])).alias("segments"),
    )


@register(f"{W}{corpora.SQL_ROLLED} SELECT b.item_id AS query_id, text AS original_query, (SELECT count(*) FROM hits h WHERE h.query_id = b.item_id) AS total_segments_found, (SELECT count(*) FROM rolled r WHERE r.query_id = b.item_id) AS unique_sections FROM benchmark b")
def retrieval_query_info(spark: SparkSession, d: str) -> DataFrame:
    asked, found = corpora.questions(spark, d), corpora.hits(spark, d)
    rolled = retrieve.roll_up(found, corpora.conversation_sections(spark, d), ["conv_id"])
    return retrieve.query_info(asked, found, rolled).drop("rewritten_query")


_assessed = f"""{W}{corpora.SQL_HITS}, tok AS (SELECT query_id, id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS qt, list_distinct(regexp_extract_all(lower(segment_text), '[a-z0-9]+')) AS dt FROM hits JOIN benchmark b ON item_id = query_id),
rel AS (SELECT query_id, id, len(list_intersect(qt, dt)) AS c, len(qt) AS n FROM tok)"""


def _assess(spark: SparkSession, d: str) -> DataFrame:
    found = corpora.hits(spark, d).join(F.broadcast(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))), "query_id")
    return models.assess_hits(found, models.OfflineClient())


@register(f"{_assessed} SELECT query_id, id, c > 0 AS is_relevant, round(c / n, 6) AS confidence, c || ' of ' || n || ' words' AS reasoning FROM rel")
def relevance_assessments(spark: SparkSession, d: str) -> DataFrame:
    return _assess(spark, d).select("query_id", "id", "assessment.is_relevant", F.round("assessment.confidence", 6).alias("confidence"), "assessment.reasoning")


@register(f"{_assessed} SELECT query_id, count(*) AS original_count, count(*) FILTER (WHERE c > 0 AND c / n >= 0.3) AS filtered_count FROM rel GROUP BY query_id")
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    return models.filter_counts(_assess(spark, d), ["query_id"], 0.3).drop("threshold")


_blocks = f"""{W}{corpora.SQL_ROLLED}, blk AS (SELECT query_id, place, chr(10) || 'Section ' || place || ': ' || heading_text || chr(10) || 'Relevance Score: ' || printf('%.3f', relevance_score) || chr(10) || 'Content: ' || coalesce(body_text, '')
  || chr(10) || chr(10) || 'Matching Segments:' || chr(10) || array_to_string(list_transform(list_slice(seg_texts, 1, 3), lambda x, i: '  - Segment ' || i || ': ' || x || chr(10)), '') AS b FROM rolled)"""


@register(f"{_blocks} SELECT query_id, string_agg(b, chr(10) ORDER BY place) AS context, count(*) AS sections_found FROM blk GROUP BY query_id")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    return batch.contexts(corpora.rolled(spark, d))


_best = f"""{W}{corpora.SQL_ROLLED}, ans AS (SELECT query_id, heading_text AS short_answer, 1 / (1 + round(relevance_score, 3)) AS confidence, seg_texts[1] AS passage FROM rolled WHERE place = 1)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rolled, asked = corpora.rolled(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return models.answer_queries(asked.join(batch.contexts(rolled), "query_id"), models.OfflineClient())


@register(
    f"""{_best} SELECT query_id, '## Legal Analysis' || chr(10) || chr(10) || '**Answer:** ' || short_answer || chr(10) || chr(10) || '**Confidence:** ' || printf('%.1f%%', confidence * 100) || chr(10) || chr(10) || '### Reasoning' || chr(10)
  || 'the nearest provision' || chr(10) || chr(10) || '### Citations' || chr(10) || '1. ' || short_answer || chr(10) || chr(10) || '### Supporting Passages' || chr(10) || '1. "' || passage || '"' || chr(10) || chr(10) || '### Limitations' || chr(10) || 'extractive' AS report FROM ans"""
)
def answer_report(spark: SparkSession, d: str) -> DataFrame:
    a = lambda c: F.col(f"answer.{c}")
    report = reports.answer_report(a("short_answer"), a("confidence"), a("reasoning"), a("citations"), a("supporting_passages"), a("limitations"))
    return _answers(spark, d).select("query_id", report.alias("report"))


@register(
    f"""{_best} SELECT query_id, '## Query Response' || chr(10) || chr(10) || '**Answer:** ' || short_answer || chr(10) || chr(10) || '**Confidence:** ' || printf('%.1f%%', confidence * 100) || chr(10) || chr(10)
  || '### Citations' || chr(10) || '1. ' || short_answer || chr(10) || chr(10) || '### Supporting Passages' || chr(10) || '1. ' || passage || chr(10) || chr(10) AS report FROM ans"""
)
def short_answer_report(spark: SparkSession, d: str) -> DataFrame:
    a = lambda c: F.col(f"answer.{c}")
    return _answers(spark, d).select("query_id", reports.short_report(a("short_answer"), a("confidence"), a("citations"), a("supporting_passages")).alias("report"))


@register(
    f"""{_best} SELECT b.text AS query, short_answer, 'the nearest provision' AS reasoning, short_answer AS citations, passage AS supporting_passages, round(confidence, 6) AS confidence, 'extractive' AS limitations,
  (SELECT count(*) FROM rolled r WHERE r.query_id = item_id) AS sections_found, (SELECT count(*) FROM hits h WHERE h.query_id = item_id) AS segments_found FROM benchmark b JOIN ans ON query_id = item_id"""
)
def batch_answers(spark: SparkSession, d: str) -> DataFrame:
    """The batch runner over the whole benchmark, with blank and null questions among them."""
    asked = [r["text"] for r in table(spark, d, "benchmark").orderBy("item_id").collect()]
    index = corpora.conversation_index(spark, d).withColumn("jurisdiction_id", F.lit("US-All"))
    out = batch.run(spark, models.OfflineClient(), [*asked, "", None, "  "], "US-All", corpora.conversation_sections(spark, d), index, vectors.HashingProvider(corpora.DIM), k=corpora.K, keys=["conv_id"])
    return out.drop("processing_time").withColumns({c: _join(c) for c in ("citations", "supporting_passages")}).withColumn("confidence", F.round("confidence", 6))


@register("SELECT source, lang, upper(lang) || '-' || replace(source, ' ', '') AS id, upper(lang) AS state, source AS municipality FROM (SELECT DISTINCT source, lang FROM documents)")
def jurisdiction_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "lang").distinct().withColumn("id", tx.jurisdiction_id(F.col("lang"), F.col("source")))
    state, municipality = tx.parse_jurisdiction(F.col("id"))
    return rows.select("*", state.alias("state"), municipality.alias("municipality"))


@register("SELECT * FROM (VALUES ('legal_code_all', 'mistral', 'legal_code_mistral'), ('codes', 'ollama', 'codes_ollama'), ('codes_ollama', 'ollama', 'codes_ollama'), ('codes', '', 'codes')) t(name, provider, collection)")
def collection_names(spark: SparkSession, d: str) -> DataFrame:
    given = [("legal_code_all", "mistral"), ("codes", "ollama"), ("codes_ollama", "ollama"), ("codes", "")]
    return spark.createDataFrame([(n, p, tx.collection_name(n, p)) for n, p in given], "name string, provider string, collection string")


@register("SELECT vec_id AS id, label FROM embeddings")
def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    """Two parts that overlap; what is known already is not added again."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    first, second = rows.where("label < 6"), rows.where("label > 3")
    return first.unionByName(vectors.new_rows(second, first))


@register("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O') GROUP BY ALL")
def metadata_filter_scan(spark: SparkSession, d: str) -> DataFrame:
    """The filter language on an ordinary table; both conditions reach the scan."""
    fits = filters.metadata_filter({"$and": [{"o_totalprice": {"$gt": 1000}}, {"o_orderstatus": {"$in": ["F", "O"]}}]})
    return table(spark, d, "orders").where(fits).groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@register("SELECT conv_id, string_agg(text || chr(10), '' ORDER BY lpad(turn::VARCHAR, 6, '0') || role, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def files_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Many files of a key to one text, in the order of their paths."""
    each = table(spark, d, "conversations").where("text is not null").select("conv_id", F.concat(F.lpad(F.col("turn").cast("string"), 6, "0"), "role").alias("path"), "text")
    return files.concatenate(each, ["conv_id"])


@register(
    """SELECT 'ca-SanJose:' || vec_id AS id, 'label ' || label AS document, label, 'ca-SanJose' AS jurisdiction_id, 'ca' AS state, 'SanJose' AS municipality,
  round(list_sum(list_transform(embedding, lambda x: x::FLOAT::DOUBLE)), 4) AS total FROM embeddings"""
)
def jurisdiction_index(spark: SparkSession, d: str) -> DataFrame:
    """Segments with vectors to rows of an index, with the parts of the jurisdiction's name."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("segment_idx"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("segment_text"), "embedding", "label")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return vectors.index_rows(rows, "ca-SanJose").withColumn("total", F.round(total, 4)).drop("embedding")


_words = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@register(
    f"""SELECT item_id AS query_id, text AS query, 'This section provides: ' || text AS rewritten_query, 0.5::DOUBLE AS confidence, 'template' AS reasoning,
  CASE WHEN list_has_any({_words}, ['definition', 'define']) THEN 'definition' WHEN list_has_any({_words}, ['may', 'permit']) THEN 'permission' ELSE 'general' END AS query_type FROM benchmark"""
)
def query_rewriting(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return models.rewrite_queries(asked, models.OfflineClient())


_rewritten = corpora.SQL_ROLLED.replace("FROM benchmark", "FROM (SELECT item_id, 'This section provides: ' || text AS text FROM benchmark)")


@register(f"{W}{_rewritten} SELECT query_id, place, conv_id, section_idx, heading_text, round(relevance_score, 6) AS relevance_score, segment_count FROM rolled")
def rewritten_section_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Rewriting, embedding, search and roll-up in one call."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rolled, _ = retrieve.retrieve_sections(corpora.conversation_index(spark, d), corpora.conversation_sections(spark, d), asked, vectors.HashingProvider(corpora.DIM), ["conv_id"], corpora.K, models.OfflineClient(), rewrite=True)
    return rolled.select("query_id", F.col("place").cast("long").alias("place"), "conv_id", "section_idx", "heading_text", F.round("relevance_score", 6).alias("relevance_score"), "segment_count")


class _HeadingClient:
    """Answers with three levels out of order and a wrong count, as models do."""

    def complete(self, kind: str, prompt: str, system: str | None, model: str | None, **params) -> dict:
        rows = [(2, r"Part \d+", "##"), (1, "Title [IVX]+", "#"), (3, r"\(\w\)", "###")]
        return {"total_levels": 7, "levels": [{"level": n, "regex_pattern": p, "markdown_prefix": m} for n, p, m in rows]}


@register(
    r"""SELECT region, total_levels, sample_lines, level, pattern, prefix FROM (SELECT r_regionkey AS region, 3::BIGINT AS total_levels, 2::BIGINT AS sample_lines FROM region),
  (VALUES (1::BIGINT, 'Title [IVX]+', '#'), (2, 'Part \d+', '##'), (3, '\(\w\)', '###')) t(level, pattern, prefix)""".replace("\\\\", "\\")
)
def heading_detection(spark: SparkSession, d: str) -> DataFrame:
    """A model's heading levels, counted anew, checked and put in order."""
    rows = []
    for r in table(spark, d, "region").collect():
        found = ingest.detect_headings(_HeadingClient(), f"Title I\x0cstill the first line\n{r['r_name']}")
        rows += [(r["r_regionkey"], found.total_levels, found.file_sample_size, x.level, x.regex_pattern, x.markdown_prefix) for x in ingest.check_patterns(spark, found)]
    return spark.createDataFrame(rows, "region long, total_levels long, sample_lines long, level long, pattern string, prefix string")


@register(
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, '---' || chr(10) || 'jurisdiction:' || chr(10) || '  state: "CA"' || chr(10) || '  municipality: "San Jose"' || chr(10) || '  full_name: "CA - San Jose"' || chr(10)
  || 'heading_patterns:' || chr(10) || '- level: 1' || chr(10) || '  regex_pattern: "Title"' || chr(10) || '  markdown_prefix: "#"' || chr(10) || '  example_heading: ""' || chr(10) || 'created_at: "2024-01-02T03:04:05+00:00"' || chr(10) || '---' || chr(10) || chr(10) AS head FROM documents)
SELECT doc_id, length(head || text)::BIGINT AS n_whole, md5(head || text) AS whole, md5(trim(text, {corpora.SPACES})) AS stripped FROM t"""
)
def front_matter_round_trip(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime, timezone

    head = ingest.front_matter(ingest.HeadingStructure([ingest.HeadingLevel(1, "Title", "#")], 1), "ca", " San Jose ", datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc))
    whole = table(spark, d, "documents").select("doc_id", F.concat(F.lit(head), F.coalesce("text", F.lit(""))).alias("t"))
    return whole.select("doc_id", F.length("t").cast("long").alias("n_whole"), F.md5("t").alias("whole"), F.md5(ingest.strip_front_matter(F.col("t"))).alias("stripped"))


@register("SELECT conv_id, array_to_string(list_transform(list(role ORDER BY turn), lambda x: '- ' || x), chr(10)) AS citations, array_to_string(list_transform(list(text ORDER BY turn), lambda x: '- ' || x), chr(10)) AS supporting_passages FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id")
def answers_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Lists of citations and passages as texts."""
    of = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("turn", c))), lambda x: x[c])
    rows = table(spark, d, "conversations").where("text is not null and role is not null").groupBy("conv_id").agg(of("role").alias("citations"), of("text").alias("supporting_passages"))
    return batch.text_view(rows)
