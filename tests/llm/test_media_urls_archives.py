import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from plain_llm import documents, padded
from pyspark.sql import functions as F

from terrace.llm import media, shared, url_rules, warc


def test_media_round_trip(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(20000))
    texts = ["", None, "x" * 64, "short", passage, "head " + passage, passage[:9000] + "é" + passage[9000:], passage, "y" * 70000]
    rows = {r["doc_id"]: r for r in media.round_trip(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = padded(t)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r["media_bytes"] > len(data) and r["feature"] == media.feature(np.frombuffer(data, np.uint8))
    assert rows[4]["media_sha256"] == rows[7]["media_sha256"] and rows[0]["feature"] == rows[1]["feature"]


def test_media_shares_chunks(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(50000))
    kept, chunks = media.store(documents(spark, [passage, "shifted by this " + passage, "unlike " * 30 + passage[::-1]]))
    assert kept.filter("data IS NULL").count() == 2
    held = chunks.agg(F.sum(F.octet_length("data")), F.count("*"), F.countDistinct("digest")).first()
    assert held[0] < 60000 and held[1] == held[2]
    assert media.round_trip(documents(spark, []).withColumn("data", F.lit(1))).count() == 0


def test_only_shared_chunks_leave_their_payload(spark):
    """Unlike texts that hold one passage in common: the store has the passage's chunks, not those of the texts about it."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(12000)
    texts = [text(30000) + passage + text(30000) for _ in range(5)]
    kept, chunks = media.store(documents(spark, texts))
    assert chunks.agg(F.sum(F.octet_length("data"))).first()[0] <= len(passage)
    own = [r["rest"] for r in kept.filter("data IS NULL").collect()]
    assert len(own) == 5 and sum(map(len, own)) < 5 * 68000
    rows = media.round_trip(documents(spark, [*texts, texts[2]])).collect()
    assert sorted(r["payload_sha256"] for r in rows) == sorted(hashlib.sha256(padded(t)).hexdigest() for t in [*texts, texts[2]])


def test_cuts_move_with_the_text():
    data = np.random.default_rng(2).integers(0, 256, 60000).astype(np.uint8)
    cuts = lambda x: media.chunk_ends(len(x), media.cut_marks(x).tolist())
    a, b = cuts(data), cuts(np.concatenate([np.zeros(77, np.uint8), data]))
    assert len({x + 77 for x in a} & set(b)) > 0.8 * len(a)
    assert max(np.diff([0, *a])) <= media.MOST and a[-1] == len(data)


URLS = [
    None, "", "no scheme", "http://", "https://Example.NET/en/x?q#f", "https://a.b.example.net/en/", "https://example.net/de/", "https://notexample.net/", "https://example.com/de/a", "https://www.example.com/DE/a", "http://x.org/fr/", "http://org/fr/a#b", "http://net", "http://net/", "http://a.net?x=/en/", "ftp://u@EXAMPLE.com:80/de/", "http://ex.com#http://a.net/", "http://..net/x", "http://net./x", "http://a-b.net/x", "http://example.nett/en/", "://net/a", "http://é.net/ü",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_equal_all_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 3)], "page_id long, url string").repartition(3)
    rules = url_rules.rule_table(spark)
    rows = url_rules.judge(pages.withColumn("rule", F.lit("clash")).withColumn("key", F.lit(1)), rules).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == {i: plain_verdict(u) for i, u in enumerate(URLS * 3)}
    assert url_rules.judge(pages.filter("false"), rules).count() == 0
    assert url_rules.judge(pages, rules.filter("false")).filter("rule IS NULL AND verdict = 'allow'").count() == pages.count()
    plan = url_rules.judge(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


HTML = ["<p>a</p>", "", None, "<p>a</p>", "ünï", "x" * 300000, "", "WARC/1.1\r\n\r\n", "<p>a</p>"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}" if i != 4 else None, h) for i, h in enumerate(HTML)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archives_round_trip(spark, pages):
    rows = {r["page_id"]: r for r in warc.round_trip(pages.withColumn("payload", F.lit("clash")).withColumn("refers_to", F.lit(1))).collect()}
    assert len(rows) == len(HTML)
    for i, h in enumerate(HTML):
        data = (h or "").encode()
        first = next(k for k, x in enumerate(HTML) if (x or "") == (h or ""))
        assert (rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))
    assert warc.round_trip(pages.filter("false")).count() == 0
    assert warc.round_trip(pages.union(pages)).filter("record_type = 'response'").count() == 2 * len({h or "" for h in HTML})


def test_archive_predicates_are_pushed_down(spark, pages):
    uri = shared.shared_dir(spark, "warc-test")
    warc.archive(pages, uri, least=1)
    read = warc.read_archives(spark, uri)
    assert {(r["target_uri"], bytes(r["payload"]).decode()) for r in read.filter("record_type = 'response'").select("target_uri", "payload").collect()} == {(f"http://h/{i}" if i != 4 else "", HTML[i] or "") for i in (0, 1, 2, 4, 5, 6, 7)}
    revisits = read.filter("record_type = 'revisit' AND target_uri LIKE 'http://h/3%'")
    assert [r["refers_to"] for r in revisits.collect()] == [f"{warc.ID}0"]
    assert "EvaluatePython" not in revisits._jdf.queryExecution().toString()
    reader = warc.ArchiveReader(uri, "read")
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload_bytes",), 3)])) == [EqualTo(("payload_bytes",), 3)]
    got = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert len(got) == 2 and all(r["payload"] is None for r in got)
    assert warc.read_archives(spark, uri, "skip").filter("payload IS NOT NULL").count() == 0
