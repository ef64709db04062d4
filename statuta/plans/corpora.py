"""Corpora built from the test tables, as plans and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve, sections, segments
from ..operators.vectors import HashingProvider, index_rows, with_embeddings

#: Vectors of the worked corpus, tokens of its segments, and hits per question.
DIM, TOKENS, K = 32, 60, 10
LIMIT = int(TOKENS * 0.78)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, markdown): a heading per conversation and one per turn."""
    turn = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), "text", F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", turn.alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["t"]), "")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), joined).alias("markdown"))


def conversation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.divide(conversation_markdown(spark, sf_dir), ["conv_id"])


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.flatten(conversation_sections(spark, sf_dir), ["conv_id"], token_limit=TOKENS)


def conversation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = with_embeddings(conversation_segments(spark, sf_dir), HashingProvider(DIM))
    return index_rows(embedded, keys=["conv_id"])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, vector) from the benchmark."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    from ..operators.vectors import embed_column

    return asked.withColumn("vector", embed_column(HashingProvider(DIM), F.col("query")).cast("array<double>"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search(conversation_index(spark, sf_dir), questions(spark, sf_dir), K)


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.roll_up(hits(spark, sf_dir), conversation_sections(spark, sf_dir), ["conv_id"])


def region_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, markdown): regions, their nations, and the nations' suppliers, three levels deep."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    heads = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("k"), F.concat(F.lit("### "), "s_name", F.lit("\n")).alias("t"))
    under = heads.groupBy("n_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("suppliers"))
    parts = nation.join(under, "n_nationkey", "left").withColumn("t", F.concat(F.lit("## "), "n_name", F.lit("\n"), F.coalesce("suppliers", F.lit(""))))
    ordered = F.sort_array(F.collect_list(F.struct("n_nationkey", "t")))
    return parts.groupBy("r_regionkey", "r_name").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("t")).select(
        F.col("r_regionkey").alias("region"), F.concat(F.lit("# "), "r_name", F.lit("\n"), "t").alias("markdown")
    )


def region_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.with_parents(sections.divide(region_markdown(spark, sf_dir), ["region"]), ["region"])


# The same in SQL.  Each returns common table expressions; the last one named is the result.

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
wc = lambda x: f"len(regexp_extract_all({x}, '\\S+'))"

SQL_CONVERSATIONS = """
md AS (SELECT conv_id, '# Conversation ' || conv_id || chr(10) || string_agg('## Turn ' || turn || ' ' || role || chr(10) || text || chr(10), '' ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id)"""

SQL_REGIONS = """
sup AS (SELECT s_nationkey, string_agg('### ' || s_name || chr(10), '' ORDER BY s_suppkey) AS t FROM supplier GROUP BY s_nationkey),
nat AS (SELECT n_regionkey, n_nationkey, '## ' || n_name || chr(10) || coalesce(t, '') AS t FROM nation LEFT JOIN sup ON s_nationkey = n_nationkey),
md AS (SELECT r_regionkey AS region, '# ' || r_name || chr(10) || string_agg(t, '' ORDER BY n_nationkey) AS markdown FROM region JOIN nat ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name)"""


def sql_sections(key: str) -> str:
    """From md (key, markdown) to secs (key, section_idx, heading_level, heading_text, body_text)."""
    return f"""
ln AS (SELECT {key}, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM md),
hd AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+') AS h FROM ln),
nm AS (SELECT *, sum(h::INT) OVER (PARTITION BY {key} ORDER BY n) - 1 AS s FROM hd),
secs AS (SELECT {key}, s::BIGINT AS section_idx, length(regexp_extract(max(line) FILTER (WHERE h), '^(#{{1,6}})\\s+(.+)', 1))::BIGINT AS heading_level,
  regexp_extract(max(line) FILTER (WHERE h), '^(#{{1,6}})\\s+(.+)', 1) || ' ' || regexp_extract(max(line) FILTER (WHERE h), '^(#{{1,6}})\\s+(.+)', 2) AS heading_text,
  nullif(trim(coalesce(string_agg(trim(line, {SPACES}), chr(10) ORDER BY n) FILTER (WHERE NOT h), ''), {SPACES}), '') AS body_text
  FROM nm WHERE s >= 0 GROUP BY {key}, s)"""


def sql_parents(key: str) -> str:
    """From secs to tree, with parent: by definition, the latest section before with a lower level."""
    return f"""
tree AS (SELECT a.*, (SELECT max(b.section_idx) FROM secs b WHERE b.{key} = a.{key} AND b.section_idx < a.section_idx AND b.heading_level < a.heading_level) AS parent FROM secs a)"""


def sql_chunks(source: str, keys: str, text: str, limit: int) -> str:
    """chunks (keys, pos, seg) of the texts of a relation, pos from 0."""
    return f"""
par AS (SELECT {keys}, generate_subscripts(ps, 1) AS p, unnest(ps) AS par FROM (
  SELECT {keys}, list_filter(list_transform(string_split_regex(trim({text}, {SPACES}), '\\n\\s*\\n'), lambda x: trim(x, {SPACES})), lambda x: x <> '') AS ps FROM {source} WHERE {text} IS NOT NULL)),
packed AS (SELECT {keys}, p, CASE WHEN {wc("par")} <= {limit} THEN [par] ELSE (
  SELECT list_append(r.done, r.held) FROM (SELECT list_reduce(list_transform(list_filter(list_transform(
    string_split(regexp_replace(par, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {SPACES})), lambda x: x <> ''),
    lambda x: {{'done': []::VARCHAR[], 'held': x, 'n': {wc("x")}}}),
    lambda a, b: CASE WHEN a.n + b.n > {limit} THEN {{'done': list_append(a.done, a.held), 'held': b.held, 'n': b.n}} ELSE {{'done': a.done, 'held': a.held || ' ' || b.held, 'n': a.n + b.n}} END) AS r)) END AS ss FROM par),
cut AS (SELECT {keys}, p, generate_subscripts(ss, 1) AS q, unnest(ss) AS s FROM packed),
bits AS (SELECT {keys}, p, q, generate_subscripts(cs, 1) AS r, unnest(cs) AS seg FROM (SELECT {keys}, p, q, CASE WHEN {wc("s")} <= {limit} THEN [s] ELSE
  list_transform(range(0, (({wc("s")} + {limit} - 1) // {limit})), lambda k: array_to_string(list_slice(regexp_extract_all(s, '\\S+'), k * {limit} + 1, (k + 1) * {limit}), ' ')) END AS cs FROM cut)),
chunks AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY p, q, r) - 1 AS pos, seg FROM bits)"""


def sql_vectors(name: str, source: str, keys: str, text: str, dim: int = DIM) -> str:
    """``name`` (keys, vec FLOAT[]) of the texts of a relation, as the hashing provider makes them."""
    return f"""
{name}_tok AS (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {source}),
{name}_sum AS (SELECT {keys}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS b, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_tok GROUP BY ALL),
{name}_all AS (SELECT s.*, k.b AS b FROM (SELECT DISTINCT {keys} FROM {source}) s, (SELECT unnest(range({dim})) AS b) k),
{name}_raw AS (SELECT {keys}, list(coalesce(v, 0) ORDER BY b) AS raw, sqrt(sum(coalesce(v, 0) * coalesce(v, 0))) AS norm FROM {name}_all LEFT JOIN {name}_sum USING ({keys}, b) GROUP BY {keys}),
{name} AS (SELECT {keys}, list_transform(raw, lambda x: (x / CASE WHEN norm > 0 THEN norm ELSE 1 END)::FLOAT) AS vec FROM {name}_raw)"""


distance = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"

SQL_SEGMENTS = f"""{SQL_CONVERSATIONS}, {sql_sections("conv_id")}, {sql_chunks("secs", "conv_id, section_idx", "body_text", LIMIT)},
segs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY section_idx, pos) - 1 AS segment_idx, section_idx AS section_ref, heading_text AS section_heading,
  heading_level AS section_level, pos AS segment_position, seg AS segment_text, {wc("seg")}::BIGINT AS word_count FROM chunks JOIN secs USING (conv_id, section_idx))"""

SQL_HITS = f"""{SQL_SEGMENTS},
docs_in AS (SELECT conv_id || ':' || segment_idx AS id, section_heading || chr(10) || chr(10) || segment_text AS t FROM segs), {sql_vectors("dv", "docs_in", "id", "t")}, {sql_vectors("qv", "benchmark", "item_id", "text")},
pairs AS (SELECT item_id AS query_id, id, {distance("dv.vec", "qv.vec")} AS distance FROM dv, qv),
hits AS (SELECT query_id, rank, distance, id, segs.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
  JOIN segs ON id = conv_id || ':' || segment_idx WHERE rank <= {K})"""

SQL_ROLLED = f"""{SQL_HITS},
grp AS (SELECT query_id, conv_id, section_ref AS section_idx, min(distance) AS relevance_score, count(*) AS segment_count, min(rank) AS first_rank,
  list(segment_text ORDER BY distance, rank) AS seg_texts, list(round(distance, 6) ORDER BY distance, rank) AS seg_dist FROM hits GROUP BY ALL),
rolled AS (SELECT grp.*, heading_text, heading_level, body_text, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score, first_rank, conv_id, section_idx) AS place FROM grp JOIN secs USING (conv_id, section_idx))"""
