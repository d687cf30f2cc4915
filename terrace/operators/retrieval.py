"""Retrieval over documents and embeddings: keyword vectors, exact vector and hybrid search, filters, pages and contexts.

Scoring is a row-wise expression with the query as literals, so a search is one scan and a top-k; nothing is joined or
shuffled but k rows a task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.errors import DataError
from terrace.functions.binding import bound
from terrace.operators.chunking import tokens

# The words whose counts are dimensions of a keyword vector, after the first, which counts a name of the caller's.
KEYWORDS = (
    "llm", "ai", "model", "programming", "language", "rag", "search", "vector", "embedding", "memory", "index",
    "document", "query", "context", "artificial", "intelligence", "machine", "learning", "generation", "retrieval", "sprint",
    "function", "implementation", "system", "data", "algorithm", "database", "file", "content", "analysis", "processing",
)
DIMENSIONS = 128
#: Rows and queries that meet in one task of a search for many queries.
ROW_BLOCK, QUERY_BLOCK = 4096, 256


def keyword_features(text: Column, name: str = "") -> Column:
    """36 numbers: counts of ``name`` (none if empty) and keywords a word, logarithms of bytes and words, shares of punctuation and upper-case letters.

    Blank text has zeros only.
    """
    size = F.octet_length(text)

    def numbers(low: Column, words: Column) -> Column:
        many = F.greatest(words, F.lit(1))
        own = F.regexp_count(low, F.lit(re.escape(name.lower()))) / many if name else F.lit(0.0)
        counts = [own, *[F.regexp_count(low, F.lit(k)) / many for k in KEYWORDS]]
        punctuation = F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")) / F.greatest(size, F.lit(1))
        upper = F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(size, F.lit(1))
        full = F.array(*counts, F.ln(size.cast("double")) / 10, F.ln(words.cast("double")) / 5, punctuation, upper)
        return F.when(words > 0, full).otherwise(F.array_repeat(F.lit(0.0), len(KEYWORDS) + 5))

    # the lowered text and its number of words are made once, not once for each keyword
    return bound(numbers, F.lower(text), F.size(tokens(text)))


def keyword_vector(text: Column, dimensions: int = DIMENSIONS, name: str = "") -> Column:
    """:func:`keyword_features`, filled up with one small number from the text's hash, at unit length."""
    small = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(1 << 48) * 0.01

    def whole(features: Column) -> Column:
        # a text with words has bytes, so the number of these is above zero
        fill = F.array_repeat(F.when(F.get(features, F.lit(len(KEYWORDS) + 1)) > 0, small).otherwise(0.0), max(dimensions - len(KEYWORDS) - 5, 0))
        return F.slice(F.concat(features, fill), 1, dimensions)

    return bound(unit, bound(whole, keyword_features(text, name)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    return bound(lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v), norm(v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where lengths differ or a norm is 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def top(scored: DataFrame, key: str, k: int, offset: int = 0, score: str = "score") -> DataFrame:
    """The k best after ``offset``; ties go to the smaller key."""
    ordered = scored.orderBy(F.desc(score), key)
    return (ordered.offset(offset) if offset else ordered).limit(k)


def vector_search(rows: DataFrame, query: Sequence[float], k: int, key: str = "doc_id", embedding: str = "embedding") -> DataFrame:
    """Rows of positive similarity with the query vector, the best k."""
    scored = rows.withColumn("score", cosine(F.col(embedding), vector(query))).filter("score > 0")
    return top(scored, key, k)


def text_score(content: Column, query: str) -> Column:
    """Share of the query's words that the content contains, in any case."""
    words = query.lower().split()
    if not words:
        return F.lit(0.0)
    low = F.lower(content)
    return sum((F.when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / float(len(words))


def hybrid_search(rows: DataFrame, query: str, query_vector: Sequence[float] | Column, k: int, alpha: float = 0.7, offset: int = 0, filters: dict[str, str] | None = None, key: str = "doc_id", content: str = "content", embedding: str | Column = "embedding") -> DataFrame:
    """Rows by alpha * cosine + (1 - alpha) * text score, positive ones only; a page of k after ``offset``."""
    alpha = min(max(alpha, 0.0), 1.0)
    if filters:
        rows = rows.filter(metadata_filter(filters))
    q = query_vector if isinstance(query_vector, Column) else vector(query_vector)
    own = F.col(embedding) if isinstance(embedding, str) else embedding
    score = cosine(own, q) * alpha + text_score(F.col(content), query) * (1 - alpha)
    return top(rows.withColumn("score", score).filter("score > 0"), key, k, offset)


def all_pages(rows: DataFrame, query: str, query_vector: Sequence[float] | Column, k: int, pages: int, **options: Any) -> DataFrame:
    """The first ``pages`` pages of k rows together."""
    return hybrid_search(rows, query, query_vector, k * pages, **options)


def search_many(rows: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", embedding: str = "embedding", query_key: str = "query_id", query_vector: str = "query_vector", alpha: float = 1.0, text: Column | float = 0.0, offset: int = 0) -> DataFrame:
    """For each query the rows of positive alpha * cosine + (1 - alpha) * text, k after ``offset``: query_key, key and score.

    Queries and rows are dealt to blocks. Every two blocks meet in one task, which keeps the best of each query; these are
    merged by query. Sums run in the order of :func:`dot`, so equal vectors have equal scores.
    """
    alpha = min(max(alpha, 0.0), 1.0)
    most = k + offset
    parts = [1 + (df.count() - 1) // size for df, size in ((rows, ROW_BLOCK), (queries, QUERY_BLOCK))]
    if min(parts) < 1:
        return queries.select(query_key).join(rows.select(key)).select(query_key, key, F.lit(0.0).alias("score")).limit(0)

    def dealt(df: DataFrame, own: str, other: str, n: int, others: int, name: str, values: str, more: Column | float) -> DataFrame:
        more = more if isinstance(more, Column) else F.lit(more)
        df = df.select(F.col(name).alias("id"), F.coalesce(F.col(values).cast("array<double>"), F.array().cast("array<double>")).alias("v"), more.cast("double").alias("t"))
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(queries, "j", "i", parts[1], parts[0], query_key, query_vector, 0.0)
    right = dealt(rows, "i", "j", parts[0], parts[1], key, embedding, text)
    kinds = {f.name: f.dataType for f in left.schema.fields}["id"].simpleString(), {f.name: f.dataType for f in right.schema.fields}["id"].simpleString()

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        q, r = q.combine_chunks(), r.sort_by("id").combine_chunks()
        vectors = [t.column("v").to_pylist() for t in (q, r)]
        sizes = [np.array([len(v) for v in found], np.int64) for found in vectors]
        cosines = np.zeros((len(q), len(r)))
        for size in np.intersect1d(*sizes):
            x, y = (np.flatnonzero(s == size) for s in sizes)
            a, b = (np.array([found[i] for i in at], np.float64).reshape(-1, size).T for found, at in zip(vectors, (x, y)))
            norms = [np.sqrt(sum((v * v for v in m), np.zeros(m.shape[1]))) for m in (a, b)]
            total = np.zeros((len(x), len(y)))
            for d in range(size):
                total += a[d][:, None] * b[d][None, :]
            scale = norms[0][:, None] * norms[1][None, :]
            cosines[np.ix_(x, y)] = np.divide(total, scale, out=np.zeros_like(total), where=~(scale <= 0))
        score = cosines * alpha + r.column("t").to_numpy() * (1 - alpha)
        score = np.where(score > 0, score, -1.0)
        # rows are in the order of their keys, which a stable sort keeps among ties
        at = np.argsort(-score, axis=1, kind="stable")[:, :most]
        of = np.repeat(np.arange(len(q)), at.shape[1])
        at = at.reshape(-1)
        held = score[of, at] > 0
        return pa.table({query_key: q.column("id").take(pa.array(of[held])), key: r.column("id").take(pa.array(at[held])), "score": score[of, at][held]})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, f"`{query_key}` {kinds[0]}, `{key}` {kinds[1]}, score double")
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return found.withColumn("__place", place).filter((F.col("__place") > offset) & (F.col("__place") <= most)).drop("__place")


def metadata_filter(filters: dict[str, str], metadata: str = "metadata") -> Column:
    """Every key has exactly this value; a missing key counts as the empty text."""
    out = F.lit(True)
    for name, value in filters.items():
        out = out & (F.coalesce(F.col(metadata)[name], F.lit("")) == F.lit(str(value)))
    return out


def rich_filter(filters: dict[str, Any], metadata: str = "metadata") -> Column:
    """A list asks for any of its values, an object with gte, gt, lte or lt for a range of numbers, else equality."""
    out = F.lit(True)
    for name, wanted in filters.items():
        value = F.col(metadata)[name]
        if isinstance(wanted, (list, tuple)):
            out = out & F.coalesce(value.isin(*[str(w) for w in wanted]), F.lit(False))
        elif isinstance(wanted, dict):
            number = value.try_cast("double")
            tests = {"gte": lambda b, n=number: n >= b, "gt": lambda b, n=number: n > b, "lte": lambda b, n=number: n <= b, "lt": lambda b, n=number: n < b}
            if not wanted or set(wanted) - set(tests):
                raise DataError(f"unknown range {wanted!r}")
            for word, bound in wanted.items():
                out = out & F.coalesce(tests[word](F.lit(float(bound))), F.lit(False))
        else:
            out = out & (F.coalesce(value, F.lit("")) == F.lit(str(wanted)))
    return out


def set_metadata(documents: DataFrame, path: str, metadata: dict[str, str]) -> DataFrame:
    """Documents of a path get this metadata."""
    new = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    return documents.withColumn("metadata", F.when(F.col("path") == path, new).otherwise(F.col("metadata")))


def prune_by_metadata(documents: DataFrame, embeddings: DataFrame, filters: dict[str, str], key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents and embeddings without those that meet all filters; no filters, nothing pruned."""
    if not filters:
        return documents, embeddings
    gone = metadata_filter(filters)
    keys = documents.filter(gone).select(key)
    return documents.filter(~gone), embeddings.join(keys, key, "left_anti")


def index_stats(documents: DataFrame, embeddings: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: documents, embeddings, dimensions."""
    d = documents.agg(F.count("*").alias("documents"))
    e = embeddings.agg(F.count("*").alias("embeddings"), F.max(F.size(embedding)).alias("dimensions"))
    return d.join(e)


def rag_context(documents: DataFrame, order: Sequence[Column], path: str = "path", content: str = "content", n: int = 3) -> DataFrame:
    """One row `context`: the first n documents by ``order`` (newest first), each cut to 200 characters."""
    preview = F.concat(F.substring(content, 1, 200), F.when(F.octet_length(content) > 200, "...").otherwise(""))
    few = documents.orderBy(*order).limit(n)  # n rows, so one task may number them
    newest = few.select(preview.alias("p"), F.col(path).cast("string").alias("s"), F.row_number().over(Window.orderBy(*order)).alias("i"))
    held = newest.agg(F.array_sort(F.collect_list(F.struct("i", "p", "s"))).alias("d"))
    lines = F.transform("d", lambda x, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), x["p"], F.lit(" (from: "), x["s"], F.lit(")")))
    full = F.concat(F.lit("RAG Context from indexed documents:\n"), F.array_join(lines, "\n\n"))
    return held.select(F.when(F.size("d") > 0, full).otherwise("No indexed documents available for context.").alias("context"))


def rerank(hits: DataFrame, key: str, k: int, query: str | None = None, score: str = "score", content: str = "content") -> DataFrame:
    """Hits by their score, or by the text score with ``query``."""
    return top(hits.withColumn(score, text_score(F.col(content), query)) if query is not None else hits, key, k, score=score)


def rerank_with(hits: DataFrame, scorer, key: str, k: int, schema_type: str = "double", content: str = "content") -> DataFrame:
    """Hits by a scorer of Arrow-batched pandas series of passages, such as a cross-encoder."""
    return top(hits.withColumn("score", F.pandas_udf(scorer, schema_type)(F.col(content))), key, k)


def fuse_passages(hits: DataFrame, key: str, most: int, score: str = "score", content: str = "content", cite: bool = False, path: str | None = None) -> DataFrame:
    """One row `fused`: the best passages joined by blank lines; with ``cite`` numbered, and their sources listed."""
    best = top(hits, key, most, score=score).select(F.struct((-F.col(score)).alias("o"), F.col(key).alias("k"), F.col(content).alias("c"), F.col(path or key).cast("string").alias("s")).alias("h"))
    held = best.agg(F.array_sort(F.collect_list("h")).alias("h"))
    number = lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
    if not cite:
        return held.select(F.array_join(F.transform("h", lambda x: x["c"]), "\n\n").alias("fused"))
    body = F.array_join(F.transform("h", lambda x, i: F.concat(number(i), x["c"])), "\n\n")
    sources = F.array_join(F.transform("h", lambda x, i: F.concat(number(i), x["s"])), "\n")
    return held.select(F.concat(body, F.lit("\n\nCitations:\n"), sources).alias("fused"))


def distinct_passages(hits: DataFrame, key: str, most: int, threshold: float, score: str = "score", content: str = "content") -> DataFrame:
    """Array `passages` of the best hits, without those that share ``threshold`` of their words with one chosen before.

    Hits are a search's top rows: the choice runs over their ordered array.
    """
    held = hits.agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(key).alias("k"), F.col(content).alias("c")))).alias("h"))
    start = F.array().cast("array<string>")

    def shared(a: Column, b: Column) -> Column:
        x, y = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
        return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))

    def step(chosen: Column, hit: Column) -> Column:
        full = (F.size(chosen) >= most) | F.exists(chosen, lambda c: shared(c, hit["c"]) >= threshold)
        return F.when(full, chosen).otherwise(F.concat(chosen, F.array(hit["c"])))

    return held.select(F.aggregate("h", start, step).alias("passages"))


def fuse_distinct(hits: DataFrame, key: str, most: int, threshold: float, score: str = "score", content: str = "content") -> DataFrame:
    """One row `fused`: the passages of :func:`distinct_passages`, numbered, and the keys of their hits listed.

    A passage that several hits have is cited by the best of them.
    """
    chosen = distinct_passages(hits, key, most, threshold, score, content).select(F.posexplode("passages").alias("i", "c"))
    own = hits.select(F.col(content).alias("c"), F.struct((-F.col(score)).alias("o"), F.col(key).alias("k")).alias("at"))
    cited = chosen.join(own, "c").groupBy("i", "c").agg(F.min("at").alias("at"))  # as many rows as passages
    held = cited.agg(F.array_sort(F.collect_list(F.struct("i", "c", F.col("at.k").cast("string").alias("k")))).alias("h"))
    number = lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
    body = F.array_join(F.transform("h", lambda x, i: F.concat(number(i), x["c"])), "\n\n")
    sources = F.array_join(F.transform("h", lambda x, i: F.concat(number(i), x["k"])), "\n")
    return held.select(F.concat(body, F.lit("\n\nCitations:\n"), sources).alias("fused"))


def optimize_window(hits: DataFrame, key: str, budget: int, margin: int = 0, score: str = "score", content: str = "content") -> DataFrame:
    """Best hits first while their words together stay within the budget less the margin; adds tokens and total.

    Each hit with words takes one of the budget at least, so only as many of the best as the budget has words, with keys and
    counts but no texts, are brought together; every hit then finds its total among them. Hits without a score come last.
    """
    most = max(budget - margin, 0)
    place = F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))).alias("o"), F.col(key).alias("k"))
    counted = hits.withColumns({"tokens": F.size(tokens(F.col(content))), "_at": place})
    best = counted.filter("tokens > 0").select("_at", F.col("tokens").cast("long").alias("t")).orderBy("_at").limit(most + 1)
    held = best.agg(F.array_sort(F.collect_list(F.struct("_at", "t"))).alias("h"))
    rows = counted.withColumn("_held", held.scalar())
    rows = rows.filter((F.size("_held") <= most) | (F.col("_at") <= F.element_at("_held", -1)["_at"]))
    before = F.filter("_held", lambda e: e["_at"] <= F.col("_at"))
    total = F.aggregate(before, F.lit(0).cast("long"), lambda a, e: a + e["t"])
    return rows.withColumn("total", total).filter(F.col("total") <= budget - margin).drop("_held", "_at")
