import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrace.errors import DataError
from terrace.functions import evaluation, stdlib
from terrace.functions.expressions import compile_expression
from terrace.operators import chunking, retrieval, validation


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0)])
    return row.select(column).first()[0]


def windows(items, size, overlap):
    out, at = [], 0
    while at < len(items):
        out.append(items[at : at + size])
        if at + size >= len(items):
            break
        at += max(size - overlap, 1)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab é漢\n ", max_size=60), min_size=1, max_size=6), st.integers(1, 7), st.integers(0, 8))
def test_chunks_equal_a_plain_model(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", chunking.chunk_tokens(F.col("text"), size, overlap).alias("t"), chunking.chunk_chars(F.col("text"), size, overlap).alias("c")).collect()
    for r in rows:
        assert r["t"] == [" ".join(w) for w in windows(texts[r["i"]].split(), size, overlap)]
        assert r["c"] == windows(texts[r["i"]], size, overlap)


def test_paragraphs(spark):
    text = "aa\n\nbb\n\ncccccc\n\nd"
    assert one(spark, chunking.chunk_paragraphs(F.lit(text), 8)) == ["aa\n\nbb", "cccccc", "d"]
    assert one(spark, chunking.chunk_paragraphs(F.lit(text), 8, repeat=True)) == ["aa\n\nbb", "cccccc", "cccccc", "d", "d"]
    assert one(spark, chunking.chunks(F.lit("a b c"), "tokens", 0)) == []
    with pytest.raises(DataError):
        chunking.chunks(F.lit(""), "pages")


def test_ingest_is_idempotent(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "q"), ("d", "")], "path string, content string")
    first = chunking.new_by_content(docs)
    assert sorted(r["path"] for r in first.collect()) == ["a", "c", "d"]
    assert chunking.new_by_content(docs, first).count() == 0
    pieces = chunking.ingest_chunks(docs, size=2, overlap=1).orderBy("path").collect()
    assert [r["path"] for r in pieces] == ["a#chunk_0", "a#chunk_1", "c#chunk_0"]
    assert pieces[0]["metadata"] == {"source_path": "a", "chunk_index": "0", "chunk_count": "2", "chunking": "tokens"}


def test_goldens_of_functions(spark):
    x = lambda c: one(spark, c)
    L = F.lit
    assert [x(stdlib.lower(L("AbC"))), x(stdlib.upper(L("AbC"))), x(stdlib.length(L("hola"))), x(stdlib.replace(L("banana"), "na", "NA")), x(stdlib.join(stdlib.split(L("a,b,c"), ","), "|"))] == ["abc", "ABC", 4, "baNANA", "a|b|c"]
    assert [x(stdlib.sqrt(L(9))), x(stdlib.power(L(2), L(3))), x(stdlib.minimum(L(5), L(2))), x(stdlib.maximum(L(5), L(2))), x(stdlib.clamp(L(10), L(0), L(7))), x(stdlib.clamp(L(10), L(7), L(0)))] == [3, 8, 2, 5, 7, 10]
    for there, back in ((stdlib.base64_encode, stdlib.base64_decode), (stdlib.hex_encode, stdlib.hex_decode), (stdlib.url_encode, stdlib.url_decode)):
        assert x(back(there(L("hé llo/+")))) == "hé llo/+"
    assert x(stdlib.format_number(L(3.14159), 3)) == "3.142"
    assert x(stdlib.regex_replace(L("abc-123-xyz"), r"\d+", "#")) == "abc-#-xyz" and x(stdlib.regex_match(L("abc123"), r"\d+"))
    assert x(evaluation.bleu(L("the quick brown fox"), L("the quick fox"))) == 0.75
    assert math.isclose(x(evaluation.rouge_l(L("the quick brown fox"), L("the quick fox"))), 6 / 7)
    assert x(stdlib.render_template(L("Hello {{name}}"), {"name": L("Ana")})) == "Hello Ana"
    assert x(stdlib.pii_redact(L("mail a.b@c.org or 555-123-4567"))) == "mail [EMAIL] or [PHONE]"
    assert not x(stdlib.free_of_pii(L("a@b.org"))) and x(stdlib.free_of_pii(L("none")))
    assert x(stdlib.substring(L("hello"), 1)) == "ello" and x(stdlib.starts_with(L("hello"), "he"))
    assert x(stdlib.whole_quotient(L(-7), L(2))) == -3 and x(stdlib.whole_quotient(L(7), L(0))) is None


def test_arrays(spark):
    x = lambda c: one(spark, c)
    a = F.array(*[F.lit(i) for i in (1, 2, 3, 4)])
    evens = stdlib.array_filter(a, "x % 2 == 0")
    assert x(evens) == [2, 4] and x(stdlib.array_reduce(evens, F.lit(0), "acc + x")) == 6 and x(stdlib.array_map(a, "x*2")) == [2, 4, 6, 8]
    assert x(stdlib.array_count(a, "x > 2 && x != 4")) == 1 and x(stdlib.array_find(a, "x > 9")) is None
    assert x(stdlib.number_range(F.lit(2), F.lit(7), 2)) == [2, 4, 6] and x(stdlib.number_range(F.lit(3), F.lit(3))) == [] and x(stdlib.number_range(F.lit(3), F.lit(0), -1)) == [3, 2, 1]
    assert x(stdlib.chunk_array(a, 3)) == [[1, 2, 3], [4]] and [tuple(r) for r in x(stdlib.zip_arrays(a, F.array(F.lit("p"), F.lit("q"))))] == [(1, "p"), (2, "q")]
    assert x(stdlib.array_sort(a, "desc")) == [4, 3, 2, 1] and [tuple(r) for r in x(stdlib.enumerate_array(F.array(F.lit("a"))))] == [(0, "a")]
    assert x(stdlib.unwrap(stdlib.ok(F.lit(5)))) == 5 and x(stdlib.is_error(stdlib.error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        x(stdlib.unwrap(stdlib.error(F.lit("no"))))


def test_json_values(spark):
    v = stdlib.json_parse(F.lit('{"a": [1, {"b~/c": "x"}], "d": null}'))
    x = lambda c: one(spark, c)
    assert x(stdlib.json_path(v, "/a/1/b~0~1c", "string")) == "x" and x(stdlib.json_index(stdlib.json_get(v, "a"), 0, "int")) == 1
    assert x(stdlib.json_keys(F.lit('{"a":1,"b":2}'))) == ["a", "b"]
    assert [x(stdlib.json_length(F.lit(t))) for t in ("[1,2]", '{"a":1}', '"abc"')] == [2, 1, 3]
    assert [x(stdlib.type_name(stdlib.json_parse(F.lit(t)))) for t in ("1", "1.5", "true", '"s"', "[1]", '{"a":1}')] == ["int", "float", "bool", "string", "array", "object"]


@pytest.mark.parametrize("bad", ["x +", "y", "x ? 1", "(x", "__import__('os')"])
def test_bad_expressions(bad):
    with pytest.raises(DataError):
        compile_expression(bad, {"x": F.lit(1)})


def test_retrieval(spark):
    assert math.isclose(0.7 * 0.11140851676 + 0.3, 0.377985954, abs_tol=1e-6)
    rows = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0], {"k": "a"}), (2, "beta", [0.0, 1.0], {"k": "b"}), (3, "gamma", [0.0, 0.0], {})], "doc_id int, content string, embedding array<float>, metadata map<string,string>")
    assert [(r["doc_id"], r["score"]) for r in retrieval.vector_search(rows, [1.0, 0.0], 5).collect()] == [(1, 1.0)]
    assert [r["doc_id"] for r in retrieval.hybrid_search(rows, "Beta beta nope", [0.0, 1.0], 5).collect()] == [2, 1]
    assert [r["doc_id"] for r in retrieval.hybrid_search(rows, "beta", [0.0, 1.0], 5, filters={"k": "a"}).collect()] == [1]
    assert retrieval.hybrid_search(rows, "beta", [0.0, 1.0], 5, offset=9).count() == 0
    assert [r["doc_id"] for r in rows.filter(retrieval.metadata_filter({"k": ""})).collect()] == [3]
    assert one(spark, retrieval.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    blank = one(spark, retrieval.keyword_vector(F.lit("  ")))
    assert len(blank) == 128 and not any(blank)
    v = one(spark, retrieval.keyword_vector(F.lit("data data model, OK")))
    assert len(v) == 128 and math.isclose(sum(x * x for x in v), 1.0)
    empty = rows.limit(0)
    assert retrieval.rag_context(empty.withColumn("path", F.lit("p")), [F.desc("doc_id")]).first()[0].startswith("No indexed")
    hits = spark.createDataFrame([(1, 0.9, "a b c d"), (2, 0.8, "a b c d"), (3, 0.7, "x y")], "doc_id int, score double, content string")
    assert retrieval.distinct_passages(hits, "doc_id", 2, 0.8).first()[0] == ["a b c d", "x y"]
    assert retrieval.fuse_passages(hits, "doc_id", 2, cite=True).first()[0] == "[1] a b c d\n\n[2] a b c d\n\nCitations:\n[1] 1\n[2] 2"
    assert [r["doc_id"] for r in retrieval.optimize_window(hits, "doc_id", 8).collect()] == [1, 2]
    assert [r["doc_id"] for r in retrieval.rerank_with(hits, lambda s: s.str.len().astype(float), "doc_id", 1).collect()] == [1]


def test_validation(spark):
    x = lambda c: one(spark, c)
    assert x(validation.relevance(F.lit("about spark engines"), F.lit("spark engines run"))) == 2 / 3
    assert x(validation.similarity(F.lit("same words here"), F.lit("same words here"))) == 1.0 and x(validation.similarity(F.lit(""), F.lit("a"))) == 0.0
    assert x(validation.contradicts(F.lit("it is Fast"), F.lit("it is slow"))) and not x(validation.contradicts(F.lit("it is"), F.lit("it was")))
    assert x(validation.claims(F.lit("In the year 1999 we met at the big hall. Studies show things. plain"))) == ["In the year 1999 we met at the big hall", "In the year 1999 we met at the big hall", "Studies show things"]
    df = spark.createDataFrame([("g", 1, "cats like warm milk"), ("g", 2, "cats like warm milk daily"), ("g", 3, "dogs bark")], "g string, n int, t string")
    assert validation.consensus(df, "g", "n", "t").first()["n"] == 1
    assert validation.combine(df, "g", "n", "t", "best_of_n").first()["combined"] == "cats like warm milk daily"
    assert validation.combine(df, "g", "n", "t", "synthesize").first()["combined"].startswith("From response 1: cats like warm milk. From response 2")
    assert validation.combine(df, "g", "n", "t", "weighted").first()["combined"].startswith("Response 1 (weight: 0.33): cats")
    tries = spark.createDataFrame([("q", 1, 0.3), ("q", 2, 0.9), ("q", 3, 0.95), ("r", 1, 0.2), ("r", 2, 0.1)], "q string, n int, c double")
    assert sorted((r["q"], r["n"], r["is_valid"]) for r in validation.best_attempt(tries, "q", "n", "c").collect()) == [("q", 2, True), ("r", 1, False)]
    facts = spark.createDataFrame([("a", "FALSE: x"), ("a", "uncertain"), ("a", None), ("b", "TRUE")], "g string, v string")
    assert sorted((r["g"], r["confidence"]) for r in validation.fact_validation(facts, "g", "v").collect()) == [("a", 0.65), ("b", 1.0)]
