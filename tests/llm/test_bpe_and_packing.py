import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_llm import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrace.llm import arrayfile, bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "Hello world", "  two  spaces\n\n\tand tabs ", "it's I'll we've don't 'quoted' 's", "naïve café Ünïcödé ßtraße", "日本語 のテキスト 👩‍👩‍👧 emoji",
    "a<|endoftext|>b <|endoftext|>", "x" * 700, "ab" * 400 + " " + "word " * 3000, "١٢٣ ½ ² 1234567", "   odd　space \r\n", "the same line\n" * 50, "word word word", "word word word", "''' 're'll", "\u0000nul\u0001",
]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_round_trip_equals_the_library(spark, tokenizer):
    docs = documents(spark, TEXTS)
    for docs_, min_count in ((docs, 3), (docs, 1), (docs.filter("false"), 3)):
        rows = bpe.round_trip(docs, bpe.ship_lexicon(docs_, PATH, min_count=min_count)).collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            ids = tokenizer.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()), TEXTS[r["doc_id"]]
            assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_columns(spark):
    docs = documents(spark, TEXTS[:8]).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    lexicon = bpe.ship_lexicon(docs, PATH)
    back = bpe.decode(bpe.encode(docs, lexicon), lexicon)
    assert sorted(back.columns) == sorted(docs.columns)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS[:8])}
    assert bpe.encode(docs.filter("false"), lexicon).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=8), max_size=40))
def test_transducer_numbers_its_words(found):
    words = sorted(set(found))
    a = bpe.compile_transducer(words)
    lexicon = bpe.compile_lexicon(VOCABULARY, [])
    c = bpe.Codec(arrayfile.unpack_arrays(memoryview(lexicon)) | a)
    probe = [*words, *(w + b"x" for w in words), b"zz"]
    lengths = np.array([len(w) for w in probe])
    rows = c.rows_of_words(np.frombuffer(b"".join(probe), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert rows.tolist() == [words.index(w) if w in words else -1 for w in probe]


VOCABULARY = bpe.Vocabulary(PATH)


def test_suffixes_are_shared():
    words = sorted(f"{a}{b}ing".encode() for a in "abcdefgh" for b in "ijklmnop")
    assert len(bpe.compile_transducer(words)["final"]) <= 8


def rebuilt(rows, tokenizer, texts, end=1):
    """Whether pieces hold each id once, windows are gapless, and how much padding there is."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, end]
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["length"], r["doc_tokens"]) == (at, len(part), len(ids))
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    used = room = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= pieces[0]["tier"] and pieces[0]["tier"] in packing.TIERS and len({(r["tier"], r["step_group"]) for r in pieces}) == 1
        used, room = used + at, room + pieces[0]["tier"]
    return room - used


def test_packing(spark, tokenizer):
    docs = documents(spark, TEXTS)
    lexicon = bpe.ship_lexicon(docs, PATH)
    rows = packing.pack_documents(docs.coalesce(1), lexicon).collect()
    assert rebuilt(rows, tokenizer, dict(enumerate(TEXTS))) < 2048
    small = packing.pack_documents(docs.coalesce(1), lexicon, batch_tokens=500, with_ids=True).collect()
    assert rebuilt(small, tokenizer, dict(enumerate(TEXTS))) < 2048
    assert all(len(r["ids"]) == r["length"] for r in small)
    assert packing.pack_documents(docs.filter("false"), lexicon).count() == 0
    twice = packing.pack_documents(docs.union(docs), lexicon)
    assert twice.agg(F.sum("length")).first()[0] == 2 * sum(r["length"] for r in rows)


def test_pool_finds_what_fits():
    pool = packing.Pool()
    for n in (3, 7, 7, 100):
        pool.put(0, 0, n)
    assert (pool.largest(50), pool.largest(2), pool.smallest()) == (7, 0, 3)
    pool.take(7), pool.take(7)
    assert pool.largest(50) == 3


def test_step_groups_are_balanced():
    sizes = [2048] * 10 + [256] * 37 + [1024] * 5
    load = np.bincount(packing.step_groups(sizes, 8192), weights=sizes)
    assert load.max() - load.min() <= 2048
