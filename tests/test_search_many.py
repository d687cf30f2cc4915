import random

from pyspark.sql import functions as F

from terrace.operators import retrieval


def test_search_of_many_queries_equals_single_searches(spark, monkeypatch):
    """Over many blocks, with ties, zero, null and shorter vectors, and pages."""
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rng = random.Random(4)
    vectors = [[rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)] for _ in range(60)] + [[0.0] * 4, None, [1.0, 2.0], []]
    rows = spark.createDataFrame([(i, v, "one" if i % 3 else "two") for i, v in enumerate(vectors)], "doc_id long, embedding array<double>, content string")
    asked = [0, 7, 21, 33, 59, 62]
    queries = rows.filter(F.col("doc_id").isin(asked)).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plain = retrieval.search_many(rows, queries, 5).collect()
    mixed = retrieval.search_many(rows, queries, 4, alpha=0.7, text=retrieval.text_score(F.col("content"), "two"), offset=3).collect()
    for q in asked:
        one = retrieval.vector_search(rows, vectors[q], 5).collect()
        assert sorted((r["doc_id"], round(r["score"], 12)) for r in plain if r["query_id"] == q) == sorted((r["doc_id"], round(r["score"], 12)) for r in one)
    for q in asked[:2]:
        one = retrieval.hybrid_search(rows, "two", vectors[q], 4, offset=3).collect()
        assert sorted((r["doc_id"], round(r["score"], 12)) for r in mixed if r["query_id"] == q) == sorted((r["doc_id"], round(r["score"], 12)) for r in one)
    assert retrieval.search_many(rows, queries.filter("false"), 5).count() == 0
