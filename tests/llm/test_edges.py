"""Null, repeated and clashing columns, empty tables and very long values through each operator, and the registered queries."""

import hashlib
import json
import random
import zlib

import public_tokenizers
import pytest
from plain_llm import documents, padded
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from terrace.llm import bpe, fingerprints, kneser_ney, media, packing, shared, url_rules, warc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """A null key, a repeated row, null and empty texts, and columns named as the operators' own."""
    docs = documents(spark, ["some words here", None, "", "some words here"])
    docs = docs.union(docs.filter("doc_id = 0")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("key", "ids", "n_tokens", "sequence_id", "node", "digest", "own", "score", "data", "length"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def test_encoding(spark, odd):
    lexicon = bpe.ship_lexicon(odd, PATH)
    rows = bpe.round_trip(odd, lexicon).collect()
    assert len(rows) == 6 and sum(r["doc_id"] is None for r in rows) == 1
    tokenizer = Tokenizer.from_file(PATH)
    n = len(tokenizer.encode("some words here", add_special_tokens=False).ids)
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, *[n] * 4]
    none = odd.filter("false")
    assert bpe.round_trip(none, bpe.ship_lexicon(none, PATH)).count() == 0
    pieces = packing.pack_documents(odd, lexicon).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] + 1 for r in rows) and any(r["doc_id"] is None for r in pieces)


def test_scoring_of_long_texts(spark, odd):
    long = documents(spark, [" ".join(f"w{i % 977}" for i in range(400_000)), "w1 w2"], 100)
    rows = {r["doc_id"]: r for r in kneser_ney.train_and_score(long.unionByName(odd.select(long.columns))).collect()}
    assert rows[100]["n_tokens"] == 400_001 and rows[None]["held_out"] and rows[100]["score"] > rows[100]["base_score"]


def test_fingerprints_of_sparse_and_repeated_keys(spark):
    rng = random.Random(3)
    keys = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(60)] + [7] * 40
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(8)) for _ in keys]
    rows = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(3)
    found = fingerprints.edited_pairs(rows).collect()
    order = [r["text"] for r in rows.orderBy("doc_id", F.xxhash64("text")).collect()]
    want = []
    for i, t in enumerate(order):
        half, after = len(t) // 2, order[(i + 1) % len(order)]
        want.append(hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in found) == sorted(want)
    nulls = rows.withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    assert fingerprints.edited_pairs(nulls).count() == 100


def test_media_of_null_and_repeated_keys(spark, odd):
    rows = media.round_trip(odd).collect()
    assert len(rows) == 6
    for r in rows:
        data = padded("some words here" if r["n_bytes"] else "")
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert sum(r["doc_id"] is None for r in rows) == 1


def test_very_long_urls(spark):
    host = ".".join(["a" * 60] * 1500) + ".example.net"
    urls = [f"http://{host}/en/" + "x" * 100_000, "http://" + "y" * 200_000, f"http://{host}/" + "/" * 50_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string")
    rows = url_rules.judge(pages, url_rules.rule_table(spark)).collect()
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in rows} == {(0, "example.net/en/", "allow"), (1, None, "allow"), (2, "net/", "block"), (None, "example.net/en/", "allow")}


def test_archives_of_odd_pages(spark):
    pages = spark.createDataFrame([(None, "http://a/ b  c", "same"), (None, None, "same"), (3, "http://a/\r\nX-Head: 1", "same"), (4, "u", None)], "page_id long, url string, html string")
    rows = warc.round_trip(pages).collect()
    assert sorted((r["page_id"] is None, r["record_type"]) for r in rows) == [(False, "response")] * 2 + [(True, "response")] * 2
    uri = shared.shared_dir(spark, "odd-pages")
    warc.archive(pages, uri)
    for payload in ("read", "skip"):
        found = warc.read_archives(spark, uri, payload).collect()
        assert {r["target_uri"] for r in found} == {"http://a/ b  c", "", "http://a/%0D%0AX-Head: 1", "u"} and len(found) == 4
        assert all((r["payload"] is None) == (payload == "skip") for r in found)


COLUMNS = {
    "op1_": "doc_id n_tokens ids_sha256 decoded_sha256", "op2_": "doc_id held_out n_tokens n_known train_tokens base_score score", "op3_": "doc_id text n_lines n_removed",
    "op4_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op5_": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op7_": "page_id host path rule verdict", "op8_": "doc_id class_id kept", "op9_": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_": "doc_id quality toxicity accepted",
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_registered_queries(spark, prefix):
    """Each query over its whole table, with the columns that are asked for and a row for each row of the table (or more)."""
    (name,) = [q for q in entry.queries() if q.startswith(prefix)]
    rows = entry.queries()[name](spark, SF)
    assert set(COLUMNS[prefix].split()) <= set(rows.columns)
    table, key = ("pages", "page_id") if prefix in ("op7_", "op9_") else ("documents", "doc_id")
    keys = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert rows.select(key).exceptAll(keys).count() == 0 or prefix == "op6_"
    assert keys.exceptAll(rows.select(key)).count() == 0


def test_pipeline_of_long_and_odd_texts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = documents(spark, [None, "", "word " * 200_000, "\n".join(f"line {i} of a very long text that goes on" for i in range(20_000))], 10**6).select(docs.columns)
    both = docs.union(odd).union(odd.withColumn("doc_id", F.lit(None).cast("long")))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.filter("doc_id IS NULL").count() > 0 and rows.count() > 100
    assert json.dumps(rows.schema.jsonValue())


def test_shared_folders_need_a_name_on_a_cluster(monkeypatch):
    from terrace.errors import DataError
    from terrace.sources.folders import shared_folder

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(DataError):
        shared_folder(Session(), "x")
