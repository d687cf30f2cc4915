import public_tokenizers
import pytest
from plain_llm import documents, kept_lines, near_classes, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from terrace.llm import quality
from terrace.llm.shared import written
from test_bpe_and_packing import rebuilt

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("split", range(4))
def test_held_out_labels(spark, tables, split):
    docs, labels = tables
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == split
    model = quality.train(docs, labels.filter(~aside))
    judged = quality.judged(docs.join(labels.filter(aside), "doc_id"), model, ["doc_id", "toxic"]).join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").collect()
    assert len(judged) > 500
    right = sum(r["accepted"] == (r["good"] == 1 and r["toxic"] == 0) for r in judged)
    clean = [r for r in judged if r["good"] == 1 and r["toxic"] == 0]
    assert right / len(judged) > 0.95 and sum(r["accepted"] for r in clean) / len(clean) > 0.98
    toxic = [r for r in judged if r["toxic"] == 1]
    assert sum(r["toxicity"] >= model.faults["toxic"].least for r in toxic) >= 0.9 * len(toxic)


def test_odd_tables(spark, tables):
    docs, labels = tables
    assert quality.score(docs.filter("false"), labels).count() == 0
    assert quality.score(docs, labels.filter("false")).filter("accepted").count() == docs.count()
    odd = documents(spark, [None, "", "x" * 100000, "plain words"], 10**9)
    odd = odd.union(odd.withColumn("source", F.lit(None)).withColumn("lang", F.lit(None)))
    rows = quality.score(docs.limit(500).union(odd).withColumn("accepted", F.lit("clash")), labels.union(spark.createDataFrame([(None, 1, 0), (5, None, 1)], labels.schema))).collect()
    assert len(rows) == 508 and all(0 <= r["quality"] <= 1 and 0 <= r["toxicity"] <= 1 for r in rows)
    assert quality.accept(odd, labels.filter("false")).columns == odd.columns


def test_pipeline_equals_plain_stages(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    (_, classify), (_, lines), (_, dedup), (_, pack) = corpus_pipeline.STAGES
    one = written(classify(spark, docs, source), "t")
    accepted = {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{source}/labels.parquet")).filter("accepted").collect()}
    assert {r["doc_id"] for r in one.collect()} == accepted and one.schema == docs.schema and len(accepted) > 0
    two = written(lines(spark, one, source), "t")
    before = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = kept_lines(before)
    want = {k: want[k] for k, t in before if want[k] == t or words(want[k])}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in two.collect() if r["text"] is not None)
    three = written(dedup(spark, two, source), "t")
    assert {r["doc_id"] for r in three.collect()} == set(near_classes(sorted(want.items())).values()) and three.schema == docs.schema
    four = pack(spark, three, source).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_padding(), tokenizer.no_truncation()
    rebuilt(four, tokenizer, {r["doc_id"]: r["text"] for r in three.collect()})
    assert corpus_pipeline.run(spark, source).agg(F.sum("length")).first()[0] == sum(r["length"] for r in four)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_of_odd_tables(spark, stage):
    source = "/root/testdata/sf0.001"
    docs = documents(spark, [None, "", "a b", "a b"]).union(spark.createDataFrame([(None, None, None, None, None)], documents(spark, []).schema))
    out = stage[1](spark, docs.withColumn("key", F.lit(1)).withColumn("node", F.lit("clash")), source)
    assert out.count() >= 1
    assert stage[1](spark, docs.filter("false"), source).count() == 0
