"""More registered queries: sources and sinks, reshaping, measures, arrays and JSON values, memory, state and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import evaluation, expressions, stdlib
from terrace.operators import chunking, jsonops, memory, relational, retrieval, state, validation
from terrace.operators.dataset import Dataset
from terrace.plans.catalog import _BASE, _MEMORY, _OPTIONS, _W, _WORDS, _TEXT_SCORE, _HYBRID, _indexed, _objects, _query_vector, _r, _ranked, _set, _table, _top, _turn_pairs, query
from terrace.sources import readers, sinks
from terrace.sources.folders import shared_folder
from terrace.streaming import events as streams

# --- written and read back


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_round_trip(spark, sf_dir):
    path = shared_folder(spark, "orders") + ".csv"
    sinks.save_csv(_set(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    read = readers.load_csv(spark, path).df
    return read.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", "o_totalprice")


@query("SELECT s_suppkey, s_name FROM supplier")
def csv_with_schema(spark, sf_dir):
    path = shared_folder(spark, "suppliers") + ".csv"
    _set(spark, sf_dir, "supplier").select("s_suppkey", "s_name").df.write.csv(path, header=True, sep="|")
    return readers.load(spark, path, schema="s_suppkey long, s_name string", delimiter="|").df


@query("SELECT n_nationkey, n_name FROM nation")
def json_array_round_trip(spark, sf_dir):
    path = shared_folder(spark, "nation") + ".json"
    sinks.save_json(_set(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return readers.load(spark, path).df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def ndjson_round_trip(spark, sf_dir):
    path = shared_folder(spark, "customer") + ".ndjson"
    sinks.export(_set(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "json")
    return readers.load(spark, path).df.select("c_custkey", "c_name", "c_acctbal")


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def parquet_round_trip(spark, sf_dir):
    path = shared_folder(spark, "part") + ".parquet"
    sinks.save_parquet(_set(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return readers.load_parquet(spark, "part", path).df


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def load_by_suffix(spark, sf_dir):
    return readers.load(spark, f"{sf_dir}/orders.parquet").df.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS content FROM nation")
def whole_text_file(spark, sf_dir):
    path = shared_folder(spark, "names")
    _table(spark, sf_dir, "nation").repartition(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return readers.read_files(spark, path).select("content")


@query("SELECT 'application/octet-stream' AS mime_type, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS size, '' AS primary_text FROM nation")
def binary_file(spark, sf_dir):
    path = shared_folder(spark, "names")
    _table(spark, sf_dir, "nation").repartition(1).select("n_name").write.text(path)
    one = F.col("output.files")[0]
    return readers.load_binary_files(spark, path).select(one["mime_type"].alias("mime_type"), one["size"].alias("size"), F.col("output.primary_text").alias("primary_text"))


@query("SELECT r_regionkey, r_name FROM region")
def json_value_file(spark, sf_dir):
    path = shared_folder(spark, "regions")
    rows = _table(spark, sf_dir, "region").agg(F.to_json(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))).alias("value"))
    rows.repartition(1).write.text(path)
    value = readers.load_json_value(spark, path)
    each = value.select(F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("v"))
    return each.select(stdlib.json_get(F.col("v"), "r_regionkey", "int").alias("r_regionkey"), stdlib.json_get(F.col("v"), "r_name", "string").alias("r_name"))


@query("SELECT s_suppkey, s_name AS name FROM supplier")
def rows_as_json(spark, sf_dir):
    text = _set(spark, sf_dir, "supplier").rows_json()
    return text.select(stdlib.json_get(stdlib.json_parse(F.col("value")), "s_suppkey", "bigint").alias("s_suppkey"), stdlib.json_get(stdlib.json_parse(F.col("value")), "s_name", "string").alias("name"))


@query("""SELECT 'calls{event_type="' || event_type || '"} ' || count(*) AS value FROM events GROUP BY event_type""")
def metrics_lines(spark, sf_dir):
    counts = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.prometheus_lines(counts, "calls", ["event_type"], "n")


@query("SELECT conv_id, turn, role FROM conversations")
def call_log(spark, sf_dir):
    path = shared_folder(spark, "calls") + ".ndjson"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    for part in (turns.filter("role = 'user'"), turns.filter("role <> 'user' OR role IS NULL")):
        sinks.write_call_log(part, path)
    return readers.load(spark, path, schema="conv_id long, turn long, role string").df


@query("SELECT p_partkey, p_brand FROM part")
def fixture_file(spark, sf_dir):
    folder = shared_folder(spark, "fixtures")
    sinks.export(_set(spark, sf_dir, "part").select("p_partkey", "p_brand"), f"{folder}/parts.ndjson", "json")
    return readers.load_fixture(spark, folder, "parts.ndjson").df.select("p_partkey", "p_brand")


@query("SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def rows_from_json(spark, sf_dir):
    texts = _set(spark, sf_dir, "customer").rows_json()
    return Dataset.from_json("customers", texts, "c_custkey long, c_name string, c_acctbal double, c_nationkey int").df


# --- filters, schemas, relational


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    return relational.join(_table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), _table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), ["k"]).select("o_orderkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark, sf_dir):
    joined = relational.join(_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), _table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), ["k"], "left", "merge")
    return joined.groupBy(F.col("k").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark, sf_dir):
    return relational.join(_table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "left_semi", "shuffle_hash").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def join_anti(spark, sf_dir):
    sold = _table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return relational.join(_table(spark, sf_dir, "part"), sold, ["p_partkey"], "left_anti").select("p_partkey")


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(DISTINCT l_suppkey) AS kinds FROM lineitem GROUP BY l_returnflag")
def grouped_lines(spark, sf_dir):
    return relational.grouped(_table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), ["l_returnflag"], "q", "l_suppkey")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') <> 'O'")
def filter_null_rule(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F")))
    return Dataset("orders", orders).filter("status != O").select("o_orderkey").df


@query("SELECT n_nationkey FROM nation WHERE n_nationkey = 3")
def filter_uncastable_or(spark, sf_dir):
    return _set(spark, sf_dir, "nation").filter("n_nationkey = abc OR n_nationkey = 3").select("n_nationkey").df


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) ELSE 'null' END AS result FROM events")
def select_jsonpath_nulls(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.struct(F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").cast("int")).alias("k")).alias("props"))
    found = jsonops.select_jsonpath(rows.select(F.struct("event_id", "props.k").alias("both")), "$[*].both")
    both = F.from_json("result", "event_id long, k int")
    return found.select(both["event_id"].alias("event_id"), F.coalesce(both["k"].cast("string"), F.lit("null")).alias("result"))


@query("SELECT o_orderkey, o_totalprice <= 300000 AND o_orderstatus IN ('O', 'F') AS valid FROM orders")
def validate_values(spark, sf_dir):
    schema = {"type": "object", "required": ["o_orderkey"], "properties": {"o_totalprice": {"type": "number", "maximum": 300000}, "o_orderstatus": {"enum": ["O", "F"]}}}
    orders = _table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", jsonops.is_valid(orders.schema, schema).alias("valid"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return relational.rollup(lines, ["l_returnflag", "l_linestatus"], "q")


@query("SELECT s_nationkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, NULL FROM customer")
def set_union(spark, sf_dir):
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    return relational.union(suppliers, _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))


# --- measures of answers and hits


_HITS = "h AS (SELECT conv_id, list(lower(text) ORDER BY turn)[1:3] AS hits FROM conversations GROUP BY conv_id)"
_FOUND = "len(list_filter(['the', 'entre', 'zzz'], lambda w: len(list_filter(hits, lambda h: contains(h, w))) > 0)) / 3"
_GOOD = "len(list_filter(hits, lambda h: contains(h, 'the') OR contains(h, 'entre') OR contains(h, 'zzz'))) / len(hits)"


@query(f"WITH {_HITS}, s AS (SELECT conv_id, {_GOOD} AS p, {_FOUND} AS r FROM h) SELECT conv_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s")
def search_quality(spark, sf_dir):
    hits = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("hits"))
    words = F.array(*map(F.lit, ("the", "entre", "zzz")))
    at = lambda f: _r(f(F.col("hits"), words, 3))
    return hits.select("conv_id", at(evaluation.precision_at_k).alias("precision"), at(evaluation.recall_at_k).alias("recall"), at(evaluation.f1_at_k).alias("f1"))


@query(
    r"""WITH RECURSIVE d AS (SELECT a.item_id, list_filter(string_split_regex(a.text, '\s+'), lambda x: x <> '') AS x, list_filter(string_split_regex(b.text, '\s+'), lambda x: x <> '') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
t AS (SELECT item_id, x, y, 0 AS i, list_transform(y, lambda w: 0) AS row FROM d
UNION ALL SELECT item_id, x, y, i + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN y[k] = x[i + 1] THEN CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END + 1 ELSE row[k] END))) FROM t WHERE i < len(x))
SELECT item_id, round(2.0 * row[len(y)] / (len(x) + len(y)), 6) AS rouge_l FROM t WHERE i = len(x)"""
)
def rouge_l(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark")
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(other, "item_id").select("item_id", _r(evaluation.rouge_l(F.col("text"), F.col("other"))).alias("rouge_l"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS c, b.w AS r FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(c) > 0 THEN round(coalesce(list_sum(list_transform(list_distinct(c), lambda w: least(len(list_filter(c, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))), 0) / len(c), 6) ELSE 0 END AS bleu FROM p"""
)
def bleu_turns(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", _r(evaluation.bleu(F.col("text"), F.col("answer"))).alias("bleu"))


@query("WITH v AS (SELECT doc_id, CASE WHEN quality = 0 THEN 0.2 WHEN toxic = 1 THEN 0.1 WHEN doc_id % 5 = 0 THEN 0.05 ELSE 0 END AS loss FROM documents JOIN labels USING (doc_id)) SELECT doc_id // 4 AS batch, round(CAST(greatest(least(1 - sum(loss), 1), 0) AS DOUBLE), 6) AS confidence, round(CAST(greatest(least(1 - sum(loss), 1), 0) AS DOUBLE), 9) >= 0.8 AS is_valid FROM v GROUP BY doc_id // 4")
def fact_validation(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").withColumn("batch", F.expr("doc_id div 4"))
    verdict = F.when(F.col("quality") == 0, "false: no").when(F.col("toxic") == 1, "Uncertain").when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise("TRUE")
    return validation.fact_validation(rows.select("batch", verdict.alias("verdict")), "batch", "verdict").withColumn("confidence", _r(F.col("confidence")))


@query("SELECT p_partkey, round(p_size / 50.0 * 0.3 + 0.5 * 0.4 + p_size / 100.0 * 0.3, 6) AS score FROM part")
def comprehensive(spark, sf_dir):
    n = F.col("p_size")
    return _table(spark, sf_dir, "part").select("p_partkey", _r(validation.comprehensive_score(n / 50.0, F.lit(0.5), n / 100.0)).alias("score"))


@query(
    """WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, round(value / 50, 6) AS confidence FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence < 0.8, CASE WHEN confidence >= 0.8 THEN number ELSE 0 END, -confidence, number) AS k FROM a WHERE number <= 3)
SELECT user_id, CAST(number AS INT) AS number, confidence, confidence >= 0.8 AS is_valid FROM r WHERE k = 1"""
)
def best_attempt(spark, sf_dir):
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    attempts = _table(spark, sf_dir, "events").select("user_id", number.alias("number"), F.round(F.col("value") / 50, 6).alias("confidence"))
    return validation.best_attempt(attempts, "user_id", "number", "confidence")


@query("SELECT conv_id, text AS combined FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def combine_first(spark, sf_dir):
    return validation.combine(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "first")


_RESPONSES = "SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


@query(f"SELECT conv_id, string_agg('Response ' || i || ' (weight: ' || printf('%.2f', 1.0 / n + 0.000001) || '): ' || text, chr(10) || chr(10) ORDER BY i) AS combined FROM ({_RESPONSES}) GROUP BY conv_id")
def combine_weighted(spark, sf_dir):
    return validation.combine(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "weighted")


@query(f"SELECT conv_id, string_agg('From response ' || i || ': ' || string_split(text, '.')[1], '. ' ORDER BY i) AS combined FROM ({_RESPONSES}) GROUP BY conv_id")
def combine_synthesize(spark, sf_dir):
    return validation.combine(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "synthesize")


# --- retrieval


def _keyword_numbers() -> str:
    counts = [f"(length(low) - length(replace(low, '{k}', ''))) / {len(k)}.0 / n" for k in retrieval.KEYWORDS]
    return ", ".join(f"CASE WHEN n > 0 THEN {x} ELSE 0 END" for x in ["0", *counts, "ln(size) / 10", "ln(n) / 5", r"length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g')) / size", r"length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / size"])


_FEATURES = rf"w AS (SELECT doc_id, text, lower(text) AS low, strlen(text) AS size, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents), f AS (SELECT doc_id, text, n, CAST([{_keyword_numbers()}] AS DOUBLE[]) AS f FROM w)"


@query(f"WITH {_FEATURES} SELECT doc_id, CAST(i AS INT) AS place, round(f[i + 1], 6) AS number FROM f, range(36) r(i)")
def keyword_features_all(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(retrieval.keyword_features(F.col("text"))).alias("place", "number"))
    return rows.withColumn("number", _r(F.col("number")))


@query(
    f"""WITH {_FEATURES}, s AS (SELECT doc_id, list_concat(f, list_transform(range({retrieval.DIMENSIONS} - 36), lambda i: CASE WHEN n > 0 THEN CAST(('0x' || substr(sha256(text), 1, 12)) AS BIGINT) / 281474976710656.0 * 0.01 ELSE 0 END)) AS v FROM f)
SELECT doc_id, CAST(i AS INT) AS place, round(CASE WHEN z > 0 THEN v[i + 1] / sqrt(z) ELSE 0 END, 6) AS number FROM (SELECT *, list_sum(list_transform(v, lambda y: y * y)) AS z FROM s), range({retrieval.DIMENSIONS}) r(i)"""
)
def keyword_vectors(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(retrieval.keyword_vector(F.col("text"))).alias("place", "number"))
    return rows.withColumn("number", _r(F.col("number")))


@query("SELECT item_id, CAST(length(text) AS DOUBLE) AS score FROM benchmark ORDER BY score DESC, item_id LIMIT 5")
def rerank_by_scorer(spark, sf_dir):
    hits = _table(spark, sf_dir, "benchmark")
    return retrieval.rerank_with(hits, _text_lengths, "item_id", 5, content="text").select("item_id", "score")


def _text_lengths(texts):
    return texts.str.len().astype(float)


@query(f"WITH s AS (SELECT doc_id, round({_TEXT_SCORE}, 6) AS score FROM documents) SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 7")
def rerank_by_query(spark, sf_dir):
    hits = _table(spark, sf_dir, "documents")
    return retrieval.rerank(hits, "doc_id", 7, " ".join(_WORDS), content="text").select("doc_id", _r(F.col("score")).alias("score"))


@query(f"WITH h AS ({_HYBRID} ORDER BY raw DESC, doc_id LIMIT 20) SELECT h.doc_id, CAST(n_chars AS DOUBLE) AS score FROM h JOIN documents USING (doc_id) ORDER BY n_chars DESC, h.doc_id LIMIT 5")
def hybrid_then_rerank(spark, sf_dir):
    hits = retrieval.hybrid_search(_indexed(spark, sf_dir), " ".join(_WORDS), _query_vector(spark, sf_dir), 20)
    return retrieval.rerank_with(hits, _text_lengths, "doc_id", 5).select("doc_id", "score")


@query("""WITH d AS (SELECT item_id, text, row_number() OVER (ORDER BY length(text) DESC, item_id) AS i FROM benchmark QUALIFY i <= 3)
SELECT string_agg('[' || i || '] ' || text, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || 'Citations:' || chr(10) || string_agg('[' || i || '] ' || item_id, chr(10) ORDER BY i) AS fused FROM d""")
def fuse_with_citations(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").withColumn("score", F.char_length("text"))
    return retrieval.fuse_passages(items, "item_id", 3, content="text", cite=True)


@query()
def fuse_distinct(spark, sf_dir):
    """Distinct passages of the best hits with citations: the choice goes by what was chosen before, so no SQL; tests hold it against a plain version."""
    items = _table(spark, sf_dir, "benchmark").withColumn("score", F.char_length("text"))
    return retrieval.fuse_distinct(items, "item_id", 5, 0.5, content="text")


# --- chunking


@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, p, 0 AS i, '' AS held, NULL::VARCHAR AS chunk, -1 AS k FROM d
UNION ALL SELECT doc_id, p, i + 1, CASE WHEN i = len(p) THEN '' WHEN held = '' OR length(held) + length(p[i + 1]) + 2 > 600 THEN p[i + 1] ELSE held || chr(10) || chr(10) || p[i + 1] END,
CASE WHEN held <> '' AND (i = len(p) OR length(held) + length(p[i + 1]) + 2 > 600) THEN held END, CASE WHEN held <> '' AND (i = len(p) OR length(held) + length(p[i + 1]) + 2 > 600) THEN k + 1 ELSE k END FROM t WHERE i <= len(p))
SELECT doc_id, CAST(k AS INT) AS chunk_index, chunk FROM t WHERE chunk IS NOT NULL"""
)
def chunk_paragraphs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.chunk_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 600)).alias("chunk_index", "chunk"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(0, greatest(len(ws), 1), 160)) AS s FROM w WHERE len(ws) > 0),
c AS (SELECT doc_id, s, array_to_string(list_slice(ws, s + 1, s + 200), ' ') AS chunk, count(*) OVER (PARTITION BY doc_id) AS m FROM s WHERE s = 0 OR s - 160 + 200 < n)
SELECT doc_id || '#chunk_' || (s // 160) AS path, sha256(chunk) AS content_hash, CAST(m AS VARCHAR) AS chunk_count FROM c QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id || '#chunk_' || (s // 160)) = 1"""
)
def ingest_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    found = chunking.ingest_chunks(docs, by="tokens", size=200, overlap=40)
    return found.select("path", "content_hash", F.col("metadata")["chunk_count"].alias("chunk_count"))


# --- structured memory


@query(
    _ranked(_BASE.replace("{t}", "the")).replace("SELECT space, id, CAST(place AS INT) AS place, round(CAST(score AS DOUBLE), 6) AS score FROM p WHERE place <= 5", "")
    + """SELECT space, 'the' AS topic, '2025-01-01T00:00:00Z' AS generated_at, 'Context bundle for ''the'' (' || count(*) || ' items):' || string_agg(chr(10) || '• ' || path || ' — ' || substr(raw, 1, 40), '' ORDER BY place) AS global_summary, CAST(count(*) AS INT) AS sections, CAST(least(count(*), 2) AS INT) AS raw FROM p WHERE place <= 5 GROUP BY space"""
)
def recall_context(spark, sf_dir):
    found = memory.recall_context(_objects(spark, sf_dir), "the", "basic", memory.Recall(limit=5, include_raw=True, freeze_clock="2025-01-01T00:00:00Z", prefer_kinds=("guide",), prefer_tags=("de",)))
    return found.select("space", "topic", "generated_at", "global_summary", F.size("sections").alias("sections"), F.size("raw").alias("raw"))


def _by_kind(score: str) -> str:
    return f"WITH {_MEMORY}, s AS (SELECT *, {score} AS score FROM m WHERE kind = 'note'), p AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY score DESC, updated_at DESC, id) AS place FROM s) SELECT space, id, CAST(place AS INT) AS place, round(CAST(score AS DOUBLE), 6) AS score FROM p WHERE place <= 5"


@query(_by_kind("CAST(epoch_ms(updated_at) AS DOUBLE)"))
def recall_kind_recency(spark, sf_dir):
    return _top(memory.recall_kind(_objects(spark, sf_dir), "Note", "basic", _OPTIONS))


@query(_by_kind("epoch_ms(updated_at) / 1e9 + CASE WHEN tag = 'de' OR contains(lower(summary_long), 'de') THEN 1.5 ELSE 0 END + CASE WHEN pinned THEN 5 ELSE 0 END"))
def recall_kind_raptor(spark, sf_dir):
    return _top(memory.recall_kind(_objects(spark, sf_dir), "Note", "raptor", _OPTIONS))


@query(
    f"""WITH {_MEMORY}, o AS (SELECT * FROM m WHERE kind = 'note'), t AS (SELECT space, id, unnest(['notes', tag, CAST(id AS VARCHAR), tag, space]) AS token FROM m),
f AS (SELECT space, token, count(*) AS freq FROM t GROUP BY space, token), c AS (SELECT t.space, t.id, sum(1.0::DOUBLE / freq) AS centrality FROM t JOIN f USING (space, token) GROUP BY t.space, t.id),
s AS (SELECT o.*, round(centrality + epoch_ms(updated_at) / 1e9 + CASE WHEN pinned THEN 5 ELSE 0 END, 6) AS score FROM o JOIN c USING (space, id)),
p AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY score DESC, updated_at DESC, id) AS place FROM s) SELECT space, id, CAST(place AS INT) AS place, score FROM p WHERE place <= 5"""
)
def recall_kind_hybrid(spark, sf_dir):
    return _top(memory.recall_kind(_objects(spark, sf_dir), "Note", "hybrid", _OPTIONS))


@query(f"WITH {_MEMORY} SELECT id, CASE WHEN space = 'src1' AND path = 'notes/en/1' OR space = 'src1' AND CAST(id AS VARCHAR) = '7' THEN true ELSE pinned END AS pinned FROM m WHERE space <> 'src2'")
def memory_maintenance(spark, sf_dir):
    objects = memory.reset_space(_objects(spark, sf_dir), "src2")
    for which in ("notes/en/1", "7"):
        objects = memory.set_pinned(objects, "src1", which)
    return objects.select("id", "pinned")


@query(f"WITH {_MEMORY} SELECT id FROM m WHERE pinned OR updated_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 10 DAY")
def memory_expire(spark, sf_dir):
    return memory.expire(_objects(spark, sf_dir), 10, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("id")


@query("SELECT c_custkey, CASE WHEN s = '' THEN 'default' ELSE s END AS space FROM (SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name || ' ' || c_mktsegment, ' ')), '\\s', '_', 'g'), '[^a-z0-9/_-]', '', 'g') AS s FROM customer)".replace("\\\\", "\\"))
def space_names(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", memory.space_name(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("space"))


@query(
    f"""WITH {_MEMORY}, n AS (SELECT id, space, text FROM (SELECT id, space FROM m WHERE tag = 'de') x JOIN (SELECT doc_id, 'new ' || text AS text FROM documents) y ON x.id = y.doc_id)
SELECT m.id, m.space, coalesce(substr(n.text, 1, 200), m.summary_short) AS summary_short, CASE WHEN n.id IS NULL THEN m.relevance ELSE 'medium' END AS relevance FROM m LEFT JOIN n USING (id, space)"""
)
def memory_remember(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    none = F.lit(None).cast("string")
    new = objects.filter(F.array_contains("tags", "de")).withColumns({"raw": F.concat(F.lit("new "), "raw"), "relevance": none, **{c: none for c in ("summary_micro", "summary_short", "summary_long")}})
    return memory.remember(objects, new).select("id", "space", "summary_short", "relevance")


@query("SELECT doc_id, lang AS a, CASE WHEN lang = 'en' THEN 'over' ELSE source END AS b FROM documents")
def metadata_merged(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    merged = memory.merged_metadata(F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.col("source")), F.when(F.col("lang") == "en", F.create_map(F.lit("b"), F.lit("over"))).otherwise(F.create_map().cast("map<string,string>")))
    return docs.select("doc_id", merged.alias("m")).select("doc_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


# --- state and streams


@query("""WITH l AS (SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS e, arg_max(ts, event_id) AS ts FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events), k AS (SELECT CAST(range AS BIGINT) AS user_id FROM range(0, 400))
SELECT k.user_id, l.user_id IS NOT NULL AS known, CASE WHEN e % 3 = 0 OR epoch_ms(now) - epoch_ms(ts) <= (e % 7 + 1) * 3600000 THEN value END AS value FROM k CROSS JOIN n LEFT JOIN l USING (user_id)""")
def kv_lookup(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    log = events.select("event_id", "user_id", "value", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 7 + 1) * 3_600_000).alias("ttl_ms"))
    now = F.lit(log.agg(F.max("created_at")).first()[0])
    keys = spark.range(400).withColumnRenamed("id", "user_id")
    return state.lookup(log, keys, ["user_id"], "value", now, "event_id")


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), f AS (SELECT conv_id, text AS summary FROM conversations WHERE turn = 0 AND length(text) > 150),
k AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place, text FROM r WHERE n <= 4)
SELECT * FROM k WHERE conv_id NOT IN (SELECT conv_id FROM f) UNION ALL SELECT conv_id, 1, summary FROM f""")
def memory_by_summary(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    summaries = turns.filter("turn = 0 AND length(text) > 150").select("conv_id", F.col("text").alias("summary"))
    return state.recalled(turns, "summary", summaries, 4, "conv_id", "turn", "text")


@query("SELECT c_custkey FROM customer WHERE NOT starts_with(c_mktsegment, 'B')")
def cache_invalidation(spark, sf_dir):
    return state.invalidate(_table(spark, sf_dir, "customer"), "B", "c_mktsegment").select("c_custkey")


@query("WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, count(*) AS turns, min(ts) AS first_at, max(ts) AS last_at, epoch_ms(any_value(now)) - epoch_ms(max(ts)) > 21600000 AS expired FROM events, n GROUP BY user_id")
def session_list(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return state.sessions(events, "user_id", "ts", F.lit(events.agg(F.max("ts")).first()[0]), 21_600)


@query("WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id FROM events, n GROUP BY user_id HAVING epoch_ms(any_value(now)) - epoch_ms(max(ts)) > 21600000) SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM s)")
def session_garbage(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return state.collect_garbage(events, "user_id", "ts", F.lit(events.agg(F.max("ts")).first()[0]), 21_600).select("event_id")


def _streamed(spark, sf_dir, name: str, shape) -> DataFrame:
    """The last state of a stream over the events' files, each batch of which replaces the one before."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _table(spark, sf_dir, "events").schema.fields)
    source = streams.file_stream(spark, f"{sf_dir}/events*.parquet", schema)
    shaped = shape(source.withColumn("ts", F.col("ts").cast("timestamp")))  # watermarks take times with a zone
    path = shared_folder(spark, name)
    streams.run_to_end(shaped, lambda batch, _: batch.write.mode("overwrite").parquet(path), shared_folder(spark, "stream"), "complete")
    rows = spark.read.schema(shaped.schema).parquet(path)
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in rows.dtypes])


@query("SELECT event_type, s AS start, s + INTERVAL 2 DAY AS \"end\", count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY event_type, s")
def stream_sliding_windows(spark, sf_dir):
    return _streamed(spark, sf_dir, "sliding", lambda e: streams.sliding(e, "ts", "2 days", "1 day", "1 hour", ["event_type"], {"n": F.count("*")}))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n, round(max(value), 6) AS most FROM events GROUP BY ALL")
def stream_tumbling_windows(spark, sf_dir):
    return _streamed(spark, sf_dir, "tumbling", lambda e: streams.tumbling(e, "ts", "1 day", "1 hour", ["event_type"], {"n": F.count("*"), "most": _r(F.max("value"))}))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark, sf_dir):
    return _streamed(spark, sf_dir, "sessions", lambda e: streams.user_sessions(e, "ts", "1 day", "1 hour", ["user_id"], {"n": F.count("*")}))


@query("SELECT user_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def stream_last_values(spark, sf_dir):
    return _streamed(spark, sf_dir, "last", lambda e: streams.last_values(e, "user_id", "ts", "value"))


# --- functions


@query("SELECT p_partkey, p_name || ':' || p_size AS joined, -p_size AS less, p_size <= 20 AS small, CAST(trunc(p_size / 7) AS BIGINT) AS whole, 20 AS stamp FROM part")
def stdlib_scalars(spark, sf_dir):
    n = F.col("p_size")
    less = expressions.compile_expression("-x", {"x": n})
    small = expressions.compile_expression("!(x > 20)", {"x": n})
    return _table(spark, sf_dir, "part").select("p_partkey", stdlib.concat(F.col("p_name"), F.lit(":"), n).alias("joined"), less.alias("less"), small.alias("small"), stdlib.whole_quotient(n, F.lit(7)).alias("whole"), F.char_length(stdlib.now_iso8601()).alias("stamp"))


@query(
    """SELECT p_partkey, CASE WHEN p_size = 3 THEN '3' ELSE p_size || ',3' END AS uniq, p_size || ',1,' || p_size || ',' || (p_size + 1) AS flat, array_to_string(list_reverse_sort([p_size, 3, 7]), ',') AS down,
array_to_string(list_sort([p_size, 3, 7]), ',') AS up, '7,3,' || p_size AS back, CAST(17 AS BIGINT) AS weighted, p_size || ',3|7' AS parts, 2 AS pairs FROM part"""
)
def stdlib_arrays(spark, sf_dir):
    n = F.col("p_size")
    a = F.array(n, F.lit(3), F.lit(7))
    weighted = F.aggregate(stdlib.enumerate_array(F.array(n, F.lit(3), F.lit(7))), F.lit(0).cast("long"), lambda acc, e: acc + e["index"] * e["value"])
    pairs = F.size(stdlib.zip_arrays(a, F.array(F.lit("x"), F.lit("y"))))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        text(stdlib.unique(F.array(n, F.lit(3), n))).alias("uniq"),
        text(stdlib.flatten(F.array(F.array(n, F.lit(1)), F.array(n, n + 1)))).alias("flat"),
        text(stdlib.array_sort(a, "desc")).alias("down"),
        text(stdlib.array_sort(a)).alias("up"),
        text(stdlib.reverse(a)).alias("back"),
        weighted.alias("weighted"),
        F.array_join(F.transform(stdlib.chunk_array(a, 2), text), "|").alias("parts"),
        pairs.alias("pairs"),
    )


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS second, 'int' AS kind, 'array' AS list_kind, 'object' AS props_kind, 'k' AS keys, 1 AS members, 3 AS elements, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS text FROM events"""
)
def stdlib_json(spark, sf_dir):
    props = stdlib.json_parse(F.col("props"))
    k = F.get_json_object("props", "$.k")
    many = F.concat(F.lit("[1,"), k, F.lit(",3]"))
    values = stdlib.json_parse(many)
    return _table(spark, sf_dir, "events").select(
        "event_id",
        stdlib.json_path(props, "/k", "bigint").alias("k"),
        stdlib.json_index(values, 1, "bigint").alias("second"),
        stdlib.type_name(stdlib.json_get(props, "k")).alias("kind"),
        stdlib.type_name(values).alias("list_kind"),
        stdlib.type_name(props).alias("props_kind"),
        F.array_join(stdlib.json_keys(F.col("props")), ",").alias("keys"),
        stdlib.json_length(F.col("props")).alias("members"),
        stdlib.json_length(many).alias("elements"),
        stdlib.json_text(props).alias("text"),
    )


@query("SELECT s_suppkey, s_acctbal > 0 AS ok, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS value, CASE WHEN s_acctbal > 0 THEN NULL ELSE 'no money' END AS error FROM supplier")
def stdlib_results(spark, sf_dir):
    held = F.when(F.col("s_acctbal") > 0, stdlib.ok(F.col("s_acctbal"))).otherwise(stdlib.error(F.lit("no money"), "double"))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", held.alias("r"))
    value = F.when(stdlib.is_ok(F.col("r")), stdlib.unwrap(F.col("r")))
    return rows.select("s_suppkey", stdlib.is_ok(F.col("r")).alias("ok"), value.alias("value"), F.when(stdlib.is_error(F.col("r")), F.col("r.error")).alias("error"))


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AND NOT regexp_matches(text, '(?:\+?\d{1,3}[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]?\d{4}')")
def pii_gate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter(stdlib.free_of_pii(F.col("text"))).select("doc_id")


@query(f"SELECT conv_id, turn, CAST(len({_W.format(c='text')}) AS INT) AS words, array_to_string({_W.format(c='text')}[1:3], ' ') AS first FROM conversations")
def token_counts(spark, sf_dir):
    words: Column = chunking.tokens(F.lower("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(words).alias("words"), F.array_join(F.slice(words, 1, 3), " ").alias("first"))
