"""Registered queries over the tables of a folder, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions import evaluation, stdlib
from terrace.operators import chunking, jsonops, memory, relational, retrieval, state, usage, validation
from terrace.operators.dataset import Dataset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _set(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    return Dataset(name, _table(spark, sf_dir, name))


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# --- filter, project, take, reshape


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20")
def filter_and_select_take(spark, sf_dir):
    return _set(spark, sf_dir, "orders").filter("o_totalprice > 200000 AND o_orderstatus = F").select("o_orderkey", "o_orderstatus", "o_totalprice").take(20, ["o_orderkey"]).df


@query("SELECT o_orderkey FROM orders WHERE ((o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 200000)")
def filter_left_assoc(spark, sf_dir):
    return _set(spark, sf_dir, "orders").filter("o_orderstatus = F OR o_orderstatus = O and o_totalprice > 200000").select("o_orderkey").df


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment != 'BUILDING' AND c_acctbal <= 1000.5")
def filter_string_and_number(spark, sf_dir):
    return _set(spark, sf_dir, "customer").filter("c_mktsegment != BUILDING AND c_acctbal <= 1000.5").select("c_custkey", "c_mktsegment").df


@query("SELECT p_partkey FROM part WHERE p_size = 7 AND p_name = (SELECT min(p_name) FROM part WHERE p_size = 7)")
def filter_quoted_value(spark, sf_dir):
    parts = _set(spark, sf_dir, "part").filter("p_size = 7")
    first = parts.df.agg(F.min("p_name")).first()[0] or ""
    return parts.filter(f'p_name == "{first}"').select("p_partkey").df


@query("SELECT n_nationkey FROM nation WHERE FALSE")
def filter_uncastable(spark, sf_dir):
    return _set(spark, sf_dir, "nation").filter("n_nationkey = abc").select("n_nationkey").df


def _props(spark, sf_dir) -> Dataset:
    events = _table(spark, sf_dir, "events")
    return Dataset("events", events.withColumn("props", F.from_json("props", "k int")))


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 50")
def filter_nested(spark, sf_dir):
    return _props(spark, sf_dir).filter("props.k > 50").select("event_id").df


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS "props.k" FROM events""")
def select_nested(spark, sf_dir):
    return _props(spark, sf_dir).select("event_id", "props.k").df


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 11")
def slice_rows(spark, sf_dir):
    return _set(spark, sf_dir, "orders").slice(11, 7, ["o_orderkey"]).select("o_orderkey", "o_custkey").df


@query("""SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS "props.k" FROM events ORDER BY event_id LIMIT 15""")
def transform_options(spark, sf_dir):
    return _props(spark, sf_dir).transform({"select": ["event_id", "event_type", "props"], "take": 15, "order_by": ["event_id"], "flatten_json": "."}).df


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS "props/k" FROM events""")
def flatten_deep(spark, sf_dir):
    return _props(spark, sf_dir).flatten_json("/").df.select("event_id", "`props/k`")


# --- JSON


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def filter_jsonpath(spark, sf_dir):
    return _props(spark, sf_dir).filter_jsonpath("$.props.k").select("event_id").df


_QUANTITIES = "SELECT CAST(l_quantity AS VARCHAR) AS result FROM lineitem"


@query(_QUANTITIES)
def select_jsonpath(spark, sf_dir):
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("quantity"))).alias("items"))
    return jsonops.select_jsonpath(orders, "$[*].items[*].quantity")


@query(_QUANTITIES)
def select_jsonpath_all(spark, sf_dir):
    return select_jsonpath(spark, sf_dir)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant_members(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", stdlib.json_get(stdlib.json_parse(F.col("props")), "k", "bigint").alias("k"))


@query(
    """SELECT 'o_orderkey' AS path, 'integer' AS type, count(*) AS "rows", count(*) - count(o_orderkey) AS nulls FROM orders
UNION ALL SELECT 'o_custkey', 'integer', count(*), count(*) - count(o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', count(*), count(*) - count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'number', count(*), count(*) - count(o_totalprice) FROM orders
UNION ALL SELECT 'o_orderdate', 'string', count(*), count(*) - count(o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(*), count(*) - count(o_orderpriority) FROM orders"""
)
def infer_schema(spark, sf_dir):
    return jsonops.null_counts(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


_ORDER_SCHEMA = {"type": "object", "required": ["o_orderkey", "o_comment"], "properties": {"o_totalprice": {"type": "number", "maximum": 400000}, "o_orderstatus": {"enum": ["O", "F"]}, "o_orderpriority": {"pattern": "^[1-3]"}}}


@query(
    """SELECT o_orderkey AS "row", 'o_comment' AS path, 'is required' AS message FROM orders
UNION ALL SELECT o_orderkey, 'o_totalprice', 'is greater than 400000' FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'is not one of the listed values' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'o_orderpriority', 'does not match ^[1-3]' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]')"""
)
def validate_incremental(spark, sf_dir):
    return jsonops.validate_incremental(_table(spark, sf_dir, "orders"), _ORDER_SCHEMA, "o_orderkey")


# --- chunking and ingest


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(0, greatest(len(ws), 1), 40)) AS s FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(s // 40 AS INT) AS chunk_index, array_to_string(list_slice(ws, s + 1, s + 50), ' ') AS chunk FROM s WHERE s = 0 OR s - 40 + 50 < n"""
)
def chunk_tokens(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.chunk_tokens(F.col("text"), 50, 10)).alias("chunk_index", "chunk"))


@query(
    """WITH s AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(length(text), 1), 400)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(s // 400 AS INT) AS chunk_index, substr(text, s + 1, 500) AS chunk FROM s WHERE s = 0 OR s - 400 + 500 < n"""
)
def chunk_chars(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.chunk_chars(F.col("text"), 500, 100)).alias("chunk_index", "chunk"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text")
def ingest_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return chunking.new_by_content(docs, key="doc_id").select("doc_id", "content_hash")


@query("SELECT min(doc_id) AS doc_id, text AS content FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text")
def ingest_known(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    known = docs.filter("lang = 'en'").select(chunking.content_hash(F.col("content")).alias("content_hash"))
    return chunking.new_by_content(docs, known, key="doc_id").select("doc_id", "content")


# --- retrieval


@query(
    r"""WITH w AS (SELECT doc_id, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN round(((length(lower(text)) - length(replace(lower(text), 'ai', ''))) / 2.0) / n, 6) ELSE 0 END AS ai,
CASE WHEN n > 0 THEN round(ln(strlen(text)) / 10, 6) ELSE 0 END AS bytes, CASE WHEN n > 0 THEN round(ln(n) / 5, 6) ELSE 0 END AS words,
CASE WHEN n > 0 THEN round(length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g')) / strlen(text), 6) ELSE 0 END AS punctuation FROM w"""
)
def keyword_features(spark, sf_dir):
    f = _table(spark, sf_dir, "documents").select("doc_id", retrieval.keyword_features(F.col("text")).alias("f"))
    return f.select("doc_id", *[_r(F.col("f")[i]).alias(n) for i, n in ((2, "ai"), (32, "bytes"), (33, "words"), (34, "punctuation"))])


def _query_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    found = _table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()
    return found["embedding"] if found else []


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q WHERE list_cosine_similarity(embedding::DOUBLE[], v) > 0 ORDER BY score DESC, vec_id LIMIT 10"""
)
def vector_search(spark, sf_dir):
    hits = retrieval.vector_search(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, key="vec_id")
    return hits.select("vec_id", _r(F.col("score")).alias("score"))


_WORDS = ("the", "licensed", "and")
_TEXT_SCORE = "(" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1.0 ELSE 0.0 END" for w in _WORDS) + ") / 3.0"
_HYBRID = f"""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT doc_id, lang, 0.7 * list_cosine_similarity(embedding::DOUBLE[], v) + (1 - 0.7) * ({_TEXT_SCORE}) AS raw FROM documents JOIN embeddings ON doc_id = vec_id, q)
SELECT doc_id, round(raw, 6) AS score FROM s WHERE raw > 0"""


def _indexed(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    return docs.join(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


@query(_HYBRID + " ORDER BY raw DESC, doc_id LIMIT 10")
def hybrid_search(spark, sf_dir):
    hits = retrieval.hybrid_search(_indexed(spark, sf_dir), " ".join(_WORDS), _query_vector(spark, sf_dir), 10)
    return hits.select("doc_id", _r(F.col("score")).alias("score"))


@query(_HYBRID + " ORDER BY raw DESC, doc_id LIMIT 5 OFFSET 5")
def hybrid_page(spark, sf_dir):
    hits = retrieval.hybrid_search(_indexed(spark, sf_dir), " ".join(_WORDS), _query_vector(spark, sf_dir), 5, offset=5)
    return hits.select("doc_id", _r(F.col("score")).alias("score"))


@query(_HYBRID + " ORDER BY raw DESC, doc_id LIMIT 15")
def hybrid_all_pages(spark, sf_dir):
    hits = retrieval.all_pages(_indexed(spark, sf_dir), " ".join(_WORDS), _query_vector(spark, sf_dir), 5, 3)
    return hits.select("doc_id", _r(F.col("score")).alias("score"))


@query(_HYBRID + " AND lang = 'de' ORDER BY raw DESC, doc_id LIMIT 10")
def hybrid_filtered(spark, sf_dir):
    hits = retrieval.hybrid_search(_indexed(spark, sf_dir), " ".join(_WORDS), _query_vector(spark, sf_dir), 10, filters={"lang": "de"})
    return hits.select("doc_id", _r(F.col("score")).alias("score"))


def _queries(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_MANY = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), "
_BEST = " QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, {0}) BETWEEN {1} AND {2}"
_HYBRID_MANY = f"""{_MANY}s AS (SELECT query_id, doc_id, lang, 0.7 * list_cosine_similarity(embedding::DOUBLE[], v) + (1 - 0.7) * ({_TEXT_SCORE}) AS raw FROM documents JOIN embeddings ON doc_id = vec_id, q)
SELECT query_id, doc_id, round(raw, 6) AS score FROM s WHERE raw > 0"""


@query(_MANY + "s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS raw FROM embeddings, q) SELECT query_id, vec_id, round(raw, 6) AS score FROM s WHERE raw > 0" + _BEST.format("vec_id", 1, 10))
def vector_search_many(spark, sf_dir):
    hits = retrieval.search_many(_table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10, key="vec_id")
    return hits.select("query_id", "vec_id", _r(F.col("score")).alias("score"))


def _hybrid_many(spark, sf_dir, k: int, offset: int = 0, filters: dict[str, str] | None = None) -> DataFrame:
    rows = _indexed(spark, sf_dir)
    if filters:
        rows = rows.filter(retrieval.metadata_filter(filters))
    hits = retrieval.search_many(rows, _queries(spark, sf_dir), k, alpha=0.7, text=retrieval.text_score(F.col("content"), " ".join(_WORDS)), offset=offset)
    return hits.select("query_id", "doc_id", _r(F.col("score")).alias("score"))


@query(_HYBRID_MANY + _BEST.format("doc_id", 1, 10))
def hybrid_search_many(spark, sf_dir):
    return _hybrid_many(spark, sf_dir, 10)


@query(_HYBRID_MANY + _BEST.format("doc_id", 6, 10))
def hybrid_page_many(spark, sf_dir):
    return _hybrid_many(spark, sf_dir, 5, offset=5)


@query(_HYBRID_MANY + _BEST.format("doc_id", 1, 15))
def hybrid_all_pages_many(spark, sf_dir):
    return _hybrid_many(spark, sf_dir, 15)


@query(_HYBRID_MANY + " AND lang = 'de'" + _BEST.format("doc_id", 1, 10))
def hybrid_filtered_many(spark, sf_dir):
    return _hybrid_many(spark, sf_dir, 10, filters={"lang": "de"})


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND source = 'src1' AND n_chars >= 500 AND n_chars < 3000")
def rich_filter(spark, sf_dir):
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", meta.alias("metadata"))
    return docs.filter(retrieval.rich_filter({"lang": ["de", "fr"], "source": "src1", "n_chars": {"gte": 500, "lt": 3000}})).select("doc_id")


@query("SELECT e.vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.lang = 'en' AND d.source = 'src0')")
def prune_by_metadata(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return retrieval.prune_by_metadata(docs, vectors, {"lang": "en", "source": "src0"})[1].select(F.col("doc_id").alias("vec_id"))


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 'yes' ELSE '' END AS reviewed FROM documents")
def set_metadata(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    out = retrieval.set_metadata(docs, "src3", {"reviewed": "yes"})
    return out.select("doc_id", F.coalesce(F.col("metadata")["reviewed"], F.lit("")).alias("reviewed"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS embeddings, CAST(max(len(embedding)) AS INT) AS dimensions FROM embeddings")
def index_stats(spark, sf_dir):
    return retrieval.index_stats(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "embeddings"))


@query(
    """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS i, substr(text, 1, 200) || CASE WHEN strlen(text) > 200 THEN '...' ELSE '' END AS p, source FROM documents QUALIFY i <= 3)
SELECT 'RAG Context from indexed documents:' || chr(10) || string_agg('Document ' || i || ': ' || p || ' (from: ' || source || ')', chr(10) || chr(10) ORDER BY i) AS context FROM d"""
)
def rag_context(spark, sf_dir):
    return retrieval.rag_context(_table(spark, sf_dir, "documents"), [F.desc("doc_id")], path="source", content="text")


@query(
    """WITH d AS (SELECT item_id, text FROM benchmark ORDER BY length(text) DESC, item_id LIMIT 4)
SELECT string_agg(text, chr(10) || chr(10) ORDER BY length(text) DESC, item_id) AS fused FROM d"""
)
def fuse_passages(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").withColumn("score", F.char_length("text"))
    return retrieval.fuse_passages(items, "item_id", 4, content="text")


@query(
    r"""WITH t AS (SELECT item_id, length(text) AS score, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS tokens FROM benchmark),
r AS (SELECT item_id, tokens, sum(tokens) OVER (ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING) AS total FROM t)
SELECT item_id, CAST(tokens AS INT) AS tokens, CAST(total AS BIGINT) AS total FROM r WHERE total <= 280"""
)
def optimize_window(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").withColumn("score", F.char_length("text"))
    return retrieval.optimize_window(items, "item_id", 300, 20, content="text").select("item_id", "tokens", "total")


# --- structured memory


_MEMORY = """m AS (SELECT d.doc_id AS id, d.source AS space, 'notes/' || d.lang || '/' || d.doc_id AS path, CASE WHEN d.lang = 'en' THEN 'guide' ELSE 'note' END AS kind, d.text AS raw,
substr(d.text, 1, 80) AS summary_short, substr(d.text, 1, 300) AS summary_long, d.lang AS tag, CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' ELSE 'medium' END AS relevance,
coalesce(l.toxic, 0) = 1 AS pinned, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INT)) AS updated_at FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _objects(spark, sf_dir) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    at = F.timestamp_add("HOUR", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    text = F.col("text")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("space"),
        F.concat(F.lit("notes/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("lang") == "en", "guide").otherwise("note").alias("kind"),
        text.alias("raw"),
        F.substring(text, 1, 40).alias("summary_micro"),
        F.substring(text, 1, 80).alias("summary_short"),
        F.substring(text, 1, 300).alias("summary_long"),
        F.array("lang").alias("tags"),
        F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium").alias("relevance"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("pinned"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


_BASE = """(CASE relevance WHEN 'high' THEN 5 WHEN 'medium' THEN 2.5 ELSE 1 END + CASE WHEN pinned THEN 4 ELSE 0 END + CASE WHEN contains(lower(path), '{t}') THEN 3 ELSE 0 END
+ CASE WHEN contains(lower(summary_short), '{t}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(raw), '{t}') THEN 1.5 ELSE 0 END + CASE WHEN kind = 'guide' THEN 1 ELSE 0 END + CASE WHEN tag = 'de' THEN 0.8 ELSE 0 END)"""


def _ranked(score: str) -> str:
    return f"""WITH {_MEMORY}, s AS (SELECT *, {score} AS score FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY score DESC, updated_at DESC, id) AS place FROM s) SELECT space, id, CAST(place AS INT) AS place, round(CAST(score AS DOUBLE), 6) AS score FROM p WHERE place <= 5"""


_OPTIONS = memory.Recall(prefer_kinds=("guide",), prefer_tags=("de",))


def _top(ranked: DataFrame) -> DataFrame:
    return ranked.filter("place <= 5").select("space", "id", "place", _r(F.col("score")).alias("score"))


@query(_ranked(_BASE.replace("{t}", "the")))
def recall_basic(spark, sf_dir):
    return _top(memory.rank_topic(_objects(spark, sf_dir), "the", "basic", _OPTIONS))


@query(_ranked(_BASE.replace("{t}", "notes/de") + " + CASE WHEN starts_with(path, 'notes/de/') THEN 4 ELSE 2 END"))
def recall_patricia(spark, sf_dir):
    return _top(memory.rank_topic(_objects(spark, sf_dir), "notes/de", "patricia", _OPTIONS))


@query(_ranked(_BASE.replace("{t}", "fr the") + " + greatest(CASE WHEN tag = 'fr' OR contains(lower(summary_long), 'fr') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(summary_long), 'the') THEN 1.5 ELSE 0 END, CASE WHEN tag = 'de' OR contains(lower(summary_long), 'de') THEN 1.5 ELSE 0 END)"))
def recall_raptor(spark, sf_dir):
    return _top(memory.rank_topic(_objects(spark, sf_dir), "fr the", "raptor", _OPTIONS))


@query(
    f"""WITH {_MEMORY}, t AS (SELECT space, id, pinned, unnest(['notes', tag, CAST(id AS VARCHAR), tag, space]) AS token FROM m),
f AS (SELECT space, token, count(*) AS freq, bool_or(pinned) AS by_pinned FROM t GROUP BY space, token),
g AS (SELECT u.space, u.id, sum(CASE WHEN u.token = 'es' THEN 2.5 / freq ELSE 0 END + CASE WHEN by_pinned THEN 1.5 ELSE 0 END) AS bonus FROM (SELECT DISTINCT space, id, token FROM t) u JOIN f USING (space, token) GROUP BY u.space, u.id),
s AS (SELECT m.*, {_BASE.replace("{t}", "es")} + bonus AS score FROM m JOIN g USING (space, id)),
p AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY round(score, 9) DESC, updated_at DESC, id) AS place FROM s) SELECT space, id, CAST(place AS INT) AS place, round(CAST(score AS DOUBLE), 6) AS score FROM p WHERE place <= 5"""
)
def recall_hybrid(spark, sf_dir):
    return _top(memory.rank_topic(_objects(spark, sf_dir), "es", "graphrag", _OPTIONS))


@query(f"WITH {_MEMORY}, h AS (SELECT *, max(CASE WHEN relevance = 'high' THEN 1 ELSE 0 END) OVER (PARTITION BY space) AS gate FROM m), s AS (SELECT *, {_BASE.replace('{t}', 'the')} AS score FROM h WHERE gate = 0 OR relevance = 'high'), p AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY score DESC, updated_at DESC, id) AS place FROM s) SELECT space, id, CAST(place AS INT) AS place, round(CAST(score AS DOUBLE), 6) AS score FROM p WHERE place <= 5")
def recall_gated(spark, sf_dir):
    return _top(memory.rank_topic(_objects(spark, sf_dir), "the", "basic", memory.Recall(prefer_kinds=("guide",), prefer_tags=("de",), require_high_relevance=True)))


@query(f"WITH {_MEMORY}, p AS (SELECT *, 1.0 / 3 + CASE WHEN pinned THEN 2 ELSE 0 END + CASE WHEN tag = 'de' THEN 1 ELSE 0 END AS score, row_number() OVER (PARTITION BY space ORDER BY CASE WHEN pinned THEN 2 ELSE 0 END + CASE WHEN tag = 'de' THEN 1 ELSE 0 END DESC, updated_at DESC, id) AS place FROM m WHERE kind = 'note') SELECT space, id, CAST(place AS INT) AS place, round(CAST(score AS DOUBLE), 6) AS score FROM p WHERE place <= 5")
def recall_by_kind(spark, sf_dir):
    return _top(memory.rank_kind(_objects(spark, sf_dir), "Note", "patricia", _OPTIONS))


@query(f"WITH {_MEMORY} SELECT space, count(*) AS objects, count(*) FILTER (pinned) AS pinned, max(updated_at) AS updated_at FROM m GROUP BY space")
def space_summaries(spark, sf_dir):
    return memory.space_summaries(_objects(spark, sf_dir)).select("space", "objects", "pinned", "updated_at")


# --- judging texts


_W = r"list_filter(string_split_regex(lower({c}), '\s+'), lambda x: x <> '')"
_PAIRS = f"""WITH c AS (SELECT conv_id, turn, text, {_W.format(c="text")} AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y, len(list_filter(a.w, lambda u: strlen(u) > 3 AND list_contains(b.w, u))) AS n FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _turn_pairs(spark, sf_dir) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(after, ["conv_id", "turn"])


@query(_PAIRS + " SELECT conv_id, turn, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(n / len(x), 6) ELSE 0 END AS relevance FROM p")
def relevance(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", _r(validation.relevance(F.col("text"), F.col("answer"))).alias("relevance"))


@query(_PAIRS + " SELECT conv_id, turn, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN len(x) + len(y) = n THEN 1 ELSE round(n / (len(x) + len(y) - n), 6) END AS similarity FROM p")
def text_similarity(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", _r(validation.similarity(F.col("text"), F.col("answer"))).alias("similarity"))


_RESPONSE_PAIRS = f"""WITH c AS (SELECT conv_id, turn, text, {_W.format(c="text")} AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.text, b.text AS other, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_filter(a.w, lambda u: strlen(u) > 3 AND list_contains(b.w, u))) / (len(a.w) + len(b.w) - len(list_filter(a.w, lambda u: strlen(u) > 3 AND list_contains(b.w, u)))) END AS s FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn <> b.turn)"""


@query(_RESPONSE_PAIRS + """, m AS (SELECT c.conv_id, c.turn, round(coalesce(sum(CASE WHEN p.text <> p.other THEN s ELSE 0 END) / count(p.s), 0), 9) AS score FROM c LEFT JOIN p USING (conv_id, turn) GROUP BY c.conv_id, c.turn)
SELECT conv_id, turn, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS r FROM m) WHERE r = 1""")
def consensus(spark, sf_dir):
    found = validation.consensus(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return found.select("conv_id", "turn", _r(F.col("score")).alias("score"))


@query(_RESPONSE_PAIRS + " SELECT c.conv_id, round(CAST(greatest(1 - 0.1 * count(*) FILTER (s < 0.6), 0) AS DOUBLE), 6) AS confidence FROM (SELECT DISTINCT conv_id FROM c) c LEFT JOIN p USING (conv_id) GROUP BY c.conv_id")
def ensemble_validation(spark, sf_dir):
    found = validation.ensemble_validation(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return found.select("conv_id", _r(F.col("confidence")).alias("confidence"))


def _contains(a: str, words: str) -> str:
    return f"contains({a}, '{words}')"


_CLASH = " OR ".join(
    [f"({_contains('a.s', u)} AND {_contains('b.s', v)}) OR ({_contains('a.s', v)} AND {_contains('b.s', u)})" for u, v in validation.OPPOSITES] + [f"({_contains('a.s', u)} AND {_contains('b.s', v)})" for u, v in validation.NEGATIONS]
)
_SENTENCES = "s AS (SELECT conv_id, turn, i, lower(s) AS s FROM (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS i FROM conversations))"


@query(f"WITH {_SENTENCES} SELECT a.conv_id, a.turn, count(*) AS contradictions FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.i <> b.i WHERE {_CLASH} GROUP BY a.conv_id, a.turn")
def contradictions(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return validation.contradictions(turns, "key", "text").filter("contradictions > 0").select("key.conv_id", "key.turn", "contradictions")


@query(
    f"""{_PAIRS}, {_SENTENCES}, k AS (SELECT a.conv_id, a.turn, count(*) AS n FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.i <> b.i WHERE {_CLASH} GROUP BY a.conv_id, a.turn),
v AS (SELECT p.conv_id, p.turn, CASE WHEN len(x) > 0 AND len(y) > 0 THEN n / len(x) ELSE 0 END AS rel FROM p),
z AS (SELECT v.conv_id, v.turn, {" + ".join(f"CASE WHEN contains(lower(t.text), '{p}') THEN 1 ELSE 0 END" for p in validation.SUSPICIOUS)} AS sus, coalesce(k.n, 0) AS con, rel FROM v JOIN conversations t ON t.conv_id = v.conv_id AND t.turn = v.turn + 1 LEFT JOIN k ON k.conv_id = v.conv_id AND k.turn = v.turn + 1)
SELECT conv_id, turn, round(CAST(greatest(least(1 - 0.1 * sus - 0.2 * con - CASE WHEN rel < 0.5 THEN 0.3 ELSE 0 END, 1), 0) AS DOUBLE), 6) AS confidence FROM z"""
)
def basic_validation(spark, sf_dir):
    rows = _turn_pairs(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    return validation.basic_validation(rows, "key", "text", "answer").select("key.conv_id", "key.turn", _r(F.col("confidence")).alias("confidence"))


@query(
    r"""WITH s AS (SELECT doc_id, i, trim(s, chr(32)) AS c, regexp_matches(lower(s), 'the \d+% of|according to.*,|in the year \d+|studies show|research indicates|data reveals|statistics confirm') AS p, regexp_matches(s, '[0-9]') AND strlen(s) > 20 AS d
FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents)),
e AS (SELECT doc_id, i, 0 AS k, c FROM s WHERE p UNION ALL SELECT doc_id, i, 1, c FROM s WHERE d),
r AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS n FROM e) SELECT doc_id, CAST(n - 1 AS INT) AS place, c AS claim FROM r WHERE n <= 5"""
)
def claims(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(validation.claims(F.col("text"))).alias("place", "claim"))


@query("SELECT conv_id, text AS combined FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY strlen(text) DESC, turn DESC) AS r FROM conversations) WHERE r = 1")
def combine_best(spark, sf_dir):
    return validation.combine(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "best_of_n")


@query("SELECT conv_id, combined FROM (SELECT conv_id, text AS combined, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn)) AS r FROM conversations GROUP BY conv_id, text) WHERE r = 1")
def combine_majority(spark, sf_dir):
    return validation.combine(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "majority")


# --- state


@query("SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def session_history(spark, sf_dir):
    return state.history(_table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", "text")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place FROM r WHERE n <= 3")
def last_n_turns(spark, sf_dir):
    return state.last_n(_table(spark, sf_dir, "conversations"), 3, "conv_id", "turn").select("conv_id", "turn", "place")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def kv_last_write(spark, sf_dir):
    return state.last_write(_table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")


def _log(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise((F.col("event_id") % 7 + 1) * 86_400_000).alias("ttl_ms"))


@query("WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, n WHERE event_id % 3 = 0 OR epoch_ms(now) - epoch_ms(ts) <= (event_id % 7 + 1) * 86400000")
def ttl_valid(spark, sf_dir):
    log = _log(spark, sf_dir)
    now = log.agg(F.max("created_at")).first()[0]
    return state.live(log, F.lit(now)).select("event_id")


@query("WITH t AS (SELECT event_type, user_id, max(event_id) AS last FROM events GROUP BY event_type, user_id), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY last DESC, user_id) AS n FROM t) SELECT event_type, user_id, last FROM r WHERE n > 10")
def lru_evicted(spark, sf_dir):
    return state.least_recent(_table(spark, sf_dir, "events"), 10, "event_type", "user_id", "event_id")


@query(
    """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT event_id, user_id, s AS opened, r, 1 AS used FROM o WHERE r = 1
UNION ALL SELECT o.event_id, o.user_id, CASE WHEN o.s - w.opened >= 86400 THEN o.s ELSE w.opened END, o.r, CASE WHEN o.s - w.opened >= 86400 THEN 1 ELSE w.used + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
SELECT event_id, used <= 2 AS accepted FROM w"""
)
def rate_limit_fixed_window(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return state.fixed_window_limit(events, "user_id", "ts", "event_id", 2, 86_400).select("event_id", "accepted")


@query("WITH c AS (SELECT conv_id, turn, text, unnest(range(0, greatest(length(text), 1), 300)) AS o FROM conversations WHERE length(text) > 0) SELECT conv_id, turn, CAST(o // 300 AS INT) AS \"index\", CAST(length(substr(text, o + 1, 300)) AS INT) AS length FROM c")
def output_events(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return state.output_events(turns, "key", "text", 300).select("key.conv_id", "key.turn", "index", "length")


# --- usage


@query("SELECT role, count(*) AS calls, CAST(sum(strlen(text) // 4 + 1) AS BIGINT) AS prompt_tokens, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS completion_tokens, round(CAST(sum((strlen(text) // 4 + 1) * 0.00003 + ((length(text) + 3) // 4) * 0.00006) AS DOUBLE), 6) AS cost FROM conversations WHERE text IS NOT NULL GROUP BY role")
def token_cost_rollup(spark, sf_dir):
    calls = _table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("role", F.lit("gpt-4").alias("model"), usage.tokens_by_bytes(F.col("text")).alias("prompt_tokens"), usage.tokens_by_chars(F.col("text")).alias("completion_tokens"))
    return usage.totals(usage.with_cost(calls), ["role"], ["prompt_tokens", "completion_tokens", "cost"]).withColumn("cost", _r(F.col("cost")))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value < 10) AS failures, round(count(*) FILTER (value < 10) / count(*), 6) AS rate FROM events GROUP BY event_type")
def provider_failure_rate(spark, sf_dir):
    return usage.failure_rates(_table(spark, sf_dir, "events"), "event_type", F.col("value") < 10).withColumn("rate", _r(F.col("rate")))


@query("WITH s AS (SELECT event_id, event_type, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) SELECT event_id, CAST(spent AS BIGINT) AS spent, CASE WHEN event_type = 'click' THEN spent <= 50000 ELSE true END AS allowed FROM s")
def budget_running(spark, sf_dir):
    calls = _table(spark, sf_dir, "events").select("event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    budgets = spark.createDataFrame([("click", 50_000)], "event_type string, budget long")
    return usage.within_budget(calls, budgets, "event_type", ["event_id"], "cents").select("event_id", "spent", "allowed")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type")
def timing_stats(spark, sf_dir):
    found = usage.timing_stats(_table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", _r(F.col("mean")).alias("mean"), _r(F.col("median")).alias("median"), "min", "max", _r(F.col("std")).alias("std"))


@query("WITH c AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 10000, 6) * 0.9 END AS score FROM supplier) SELECT s_nationkey AS prompt_id, s_suppkey AS provider, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC NULLS LAST, s_suppkey) AS INT) AS place FROM c")
def ranked_providers(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    candidates = s.select(F.col("s_nationkey").alias("prompt_id"), F.col("s_suppkey").alias("provider"), F.col("s_suppkey").alias("order"), F.round(F.col("s_acctbal") / 10000, 6).alias("weight"), F.lit(0.1).alias("failure_rate"), F.when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("capacity"), F.lit(0.0).alias("spent"), F.lit(1.0).alias("cost"), F.lit(None).cast("double").alias("budget"))
    return validation.ranked_providers(candidates).select("prompt_id", "provider", "place")


# --- functions


@query("SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, CAST(length(p_name) AS INT) AS n, replace(p_name, 'a', 'A') AS swapped, array_to_string(string_split(p_name, ' '), '|') AS parts, starts_with(p_type, 'S') AS s, substr(p_name, 3, 4) AS part FROM part")
def stdlib_strings(spark, sf_dir):
    name = F.col("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", stdlib.lower(name).alias("low"), stdlib.upper(F.col("p_brand")).alias("up"), stdlib.length(name).alias("n"), stdlib.replace(name, "a", "A").alias("swapped"), stdlib.join(stdlib.split(name, " "), "|").alias("parts"), stdlib.starts_with(F.col("p_type"), "S").alias("s"), stdlib.substring(name, 2, 4).alias("part"))


@query("SELECT p_partkey, round(sqrt(p_size), 6) AS root, CAST(p_size AS DOUBLE) * p_size AS square, least(p_size, 20) AS low, greatest(p_size, 20) AS high, least(greatest(p_size, 10), 30) AS clamped, printf('%.2f', p_retailprice) AS price FROM part")
def stdlib_math(spark, sf_dir):
    n = F.col("p_size")
    return _table(spark, sf_dir, "part").select("p_partkey", _r(stdlib.sqrt(n)).alias("root"), stdlib.power(n, F.lit(2)).alias("square"), stdlib.minimum(n, F.lit(20)).alias("low"), stdlib.maximum(n, F.lit(20)).alias("high"), stdlib.clamp(n, F.lit(10), F.lit(30)).alias("clamped"), stdlib.format_number(F.col("p_retailprice")).alias("price"))


@query("SELECT n_nationkey, to_base64(encode(n_name)) AS b, lower(hex(n_name)) AS h, n_name AS back, sha256(n_name) AS digest, regexp_matches(n_name, 'IA$') AS m, regexp_replace(n_name, '[AEIOU]', '#', 'g') AS r FROM nation")
def stdlib_encoding(spark, sf_dir):
    name = F.col("n_name")
    both = stdlib.base64_decode(stdlib.base64_encode(stdlib.hex_decode(stdlib.hex_encode(stdlib.url_decode(stdlib.url_encode(name))))))
    return _table(spark, sf_dir, "nation").select("n_nationkey", stdlib.base64_encode(name).alias("b"), stdlib.hex_encode(name).alias("h"), both.alias("back"), stdlib.sha256(name).alias("digest"), stdlib.regex_match(name, "IA$").alias("m"), stdlib.regex_replace(name, "[AEIOU]", "#").alias("r"))


@query("WITH a AS (SELECT p_partkey, range(1, p_size + 1) AS r FROM part) SELECT p_partkey, CAST(list_sum(list_filter(list_transform(r, lambda x: x * 2), lambda x: x % 3 = 0)) AS BIGINT) AS total, CAST(len(list_filter(r, lambda x: x > 5)) AS INT) AS n, list_filter(r, lambda x: x > 5)[1] AS first FROM a")
def array_fp(spark, sf_dir):
    r = stdlib.number_range(F.lit(1).cast("long"), F.col("p_size").cast("long") + 1)
    kept = stdlib.array_filter(stdlib.array_map(r, "x * 2", whole=True), "x % 3 == 0")
    total = F.when(F.size(kept) > 0, stdlib.array_reduce(kept, F.lit(0).cast("long"), "acc + x"))
    return _table(spark, sf_dir, "part").select("p_partkey", total.alias("total"), stdlib.array_count(r, "x > 5").alias("n"), stdlib.array_find(r, "x > 5").alias("first"))


@query(
    r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS c FROM documents), b AS (SELECT list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS r FROM benchmark WHERE item_id = 0)
SELECT doc_id, CASE WHEN len(c) > 0 THEN round(coalesce(list_sum(list_transform(list_distinct(c), lambda w: least(len(list_filter(c, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))), 0) / len(c), 6) ELSE 0 END AS bleu FROM d, b"""
)
def bleu_one(spark, sf_dir):
    reference = _table(spark, sf_dir, "benchmark").filter("item_id = 0").first()
    docs = _table(spark, sf_dir, "documents") if reference else _table(spark, sf_dir, "documents").limit(0)
    return docs.select("doc_id", _r(evaluation.bleu(F.col("text"), F.lit(reference["text"] if reference else ""))).alias("bleu"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '(?:\+?\d{1,3}[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]?\d{4}', '[PHONE]', 'g') AS text FROM documents")
def pii_redact(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", stdlib.pii_redact(F.col("text")).alias("text"))


@query("SELECT c_custkey, 'Hello ' || c_name || ' of ' || n_name AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def render_template(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", stdlib.render_template(F.lit("Hello {{name}} of {{nation}}"), {"name": F.col("c_name"), "nation": F.col("n_name")}).alias("line"))


# --- extensions


@query("SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_join(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return relational.asof_join(events, orders, ["user_id"], "ts", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON p.p_retailprice >= s.s_acctbal AND p.p_retailprice < s.s_acctbal + 50")
def range_join(spark, sf_dir):
    bands = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return relational.range_join(_table(spark, sf_dir, "part"), bands, "p_retailprice", "low", "high", 50.0).select("p_partkey", "s_suppkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return relational.cube(lines, ["l_returnflag", "l_linestatus"], "q")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER w AS INT) AS place, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS running, lag(CAST(l_quantity AS BIGINT)) OVER w AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return relational.running(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "q").select("l_orderkey", "l_linenumber", "place", "running", "before")


@query("SELECT event_type, count(*) AS n, time_bucket(INTERVAL 1 DAY, ts) AS start FROM events GROUP BY event_type, time_bucket(INTERVAL 1 DAY, ts)")
def tumbling_windows(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select("event_type", "n", F.col("window.start").alias("start"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 DAY THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.groupBy(F.session_window("ts", "2 days"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return relational.intersect(_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_subtract(spark, sf_dir):
    return relational.subtract(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


from terrace.plans import more  # noqa: E402, F401  registers its queries here
