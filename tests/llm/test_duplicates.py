import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_llm import documents, kept_lines, near_classes, shingles, weighted_jaccard, within_one, words
from pyspark.sql import functions as F

from terrace.llm import bagminhash, fingerprints, line_dedup
from terrace.llm import textkernels as K


def prose(rng, n):
    return [rng.choice("amber birch cedar delta ember fjord grove heron islet jetty knoll larch".split()) + str(rng.randrange(30)) for _ in range(n)]


def corpus():
    """Copies, near copies in chains, short and empty texts, repeated rows, and a text over a hundred times as long."""
    rng, texts = random.Random(5), ["", None, " \n\t", "one two", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    for size in (40, 80, 200):
        base = prose(rng, size)
        texts += [" ".join(base)] * 3
        for _ in range(6):
            base = list(base)
            base[rng.randrange(size)] = "changed"
            texts.append(" ".join(base))
    texts += [" ".join(prose(rng, 60)) for _ in range(10)]
    long = prose(rng, 9000)
    return texts + [" ".join(long), " ".join([*long[:4000], "x", *long[4000:]]), "again and again and again " * 90, "again and again and again " * 100]


def test_near_duplicates_equal_all_pairs(spark):
    texts = corpus()
    docs = documents(spark, texts)
    rows = bagminhash.near_duplicates(docs).collect()
    want = near_classes(list(enumerate(texts)))
    assert {r["doc_id"]: r["class_id"] for r in rows} == want and len(rows) == len(texts)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)
    kept = bagminhash.keep_first(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_near_duplicates_of_odd_tables(spark):
    docs = documents(spark, ["same text here now yes", "same text here now yes"])
    assert bagminhash.near_duplicates(docs.filter("false")).count() == 0
    odd = docs.union(docs).union(spark.createDataFrame([(None, "same text here now yes", None, None, None)] * 2, docs.schema)).withColumn("kept", F.lit("clash"))
    rows = bagminhash.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] is None, r["class_id"]) for r in rows if r["doc_id"] is not None) == [(False, 0)] * 4
    assert all(r["class_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert bagminhash.keep_first(odd).count() == 3


def test_near_duplicates_of_repeated_keys(spark):
    """Two unlike texts under one key, each with copies elsewhere, stay two documents, whatever the partitions."""
    rng = random.Random(4)
    one, two = " ".join(prose(rng, 60)), " ".join(prose(rng, 60))
    docs = documents(spark, [one, one, two, two + " x", "own words of a text that is alone"])
    docs = docs.union(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(0).cast("long"))).union(docs.filter("doc_id = 0"))
    found = set()
    for parts in (1, 5):
        rows = bagminhash.near_duplicates(docs.repartition(parts), all_links=False).collect()
        assert len(rows) == 7 and sorted(r["class_id"] for r in rows) == [0] * 6 + [4]
        assert len({(r["class_id"], r["class_hash"]) for r in rows}) == 3
        found.add(tuple(sorted((r["doc_id"], r["class_hash"], r["kept"]) for r in rows)))
        assert sorted((r["doc_id"], r["text"]) for r in bagminhash.keep_first(docs.repartition(parts)).collect()) == sorted([(0, one), (0, two), (4, "own words of a text that is alone")])
    assert len(found) == 1


@pytest.mark.parametrize("similarity", [0.6, 0.8])
def test_recall_just_above_the_similarity(spark, similarity):
    """Planted pairs of unlike texts whose overlap lies between the similarity asked for and 0.05 more, among many of less."""
    rng, texts, planted = random.Random(9), [], 0
    while planted < 150:
        base = prose(rng, 100)
        other = list(base)
        for at in rng.sample(range(100), rng.randrange(1, 6)):
            other[at] = f"new{rng.randrange(1000)}"
        like = weighted_jaccard(shingles(" ".join(base)), shingles(" ".join(other)))
        planted += similarity <= like < similarity + 0.05
        if like >= similarity + 0.05:
            continue
        texts += [" ".join(base), " ".join(other)]
    rows = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(documents(spark, texts), similarity=similarity, all_links=False).collect()}
    pairs = [(i, weighted_jaccard(shingles(texts[i]), shingles(texts[i + 1]))) for i in range(0, len(texts), 2)]
    wrong = [like for i, like in pairs if (rows[i] == rows[i + 1]) != (like >= similarity)]
    assert len(wrong) == 0


def test_registers_agree_as_often_as_multisets_overlap():
    rng = random.Random(3)
    a = " ".join(f"w{rng.randrange(40)}" for _ in range(300))
    b = " ".join(a.split()[:240] + [f"v{i}" for i in range(60)])
    buf, at = K.buffers(pa.array([a, b]))
    times = bagminhash.signatures(*bagminhash.weighted_shingles(buf, at, 1), 2, 4000)
    want = weighted_jaccard(shingles(a, 1), shingles(b, 1))
    assert np.mean(times[0] == times[1]) == pytest.approx(want, abs=0.04)
    whole = bagminhash.signatures(*bagminhash.weighted_shingles(*K.buffers(pa.array([b])), 1), 1, 4000)
    assert (whole[0] == times[1]).all()


LINES = [
    "the quick brown fox jumps over it\nshort line\n\nthe quick brown fox jumps over it",
    "The quick  brown FOX jumps over it\nanother line of this text here\nshort line",
    "the quick brown fox leaps over it\nquick brown fox jumps over it\none two three four",
    "one two three five\nanother line of this text\nanother line in this text here now",
    None, "", "   \n\t\n", "a b c d e\na b c d\na b c d x\nlast words of all stand here", "\n".join(f"filler line number {i} of a long text" for i in range(400)),
]


def test_lines_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = LINES + ["\n".join(" ".join(prose(rng, rng.randrange(1, 9))) for _ in range(8)) for _ in range(10)]
    texts += [t.replace("amber", "ember", 1) for t in texts[9:14]]
    rows = line_dedup.dedup_lines(documents(spark, texts)).collect()
    want = kept_lines(list(enumerate(texts)))
    assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == len(texts)
    assert all(r["n_lines"] - r["n_removed"] == (len((want[r["doc_id"]] or "").split("\n")) if want[r["doc_id"]] else r["n_lines"] - r["n_removed"]) for r in rows)


def test_lines_of_odd_tables(spark):
    docs = documents(spark, ["a line that two rows have\nown"] * 2)
    assert line_dedup.dedup_lines(docs.filter("false")).count() == 0
    odd = docs.withColumn("n_lines", F.lit("clash")).union(spark.createDataFrame([(None, "a line that two rows have", None, None, None, "x")], documents(spark, []).withColumn("n_lines", F.lit("")).schema))
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(odd).collect()}
    assert rows == {0: "a line that two rows have\nown", 1: "", None: "a line that two rows have"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
def test_edit_distance(a, b):
    assert line_dedup.within_edits(np.array(a), np.array(b)) == within_one(a, b)


def plain_sketch(text, scale=fingerprints.SCALE):
    """Kept shingle hashes, as Spark's xxhash64 chains them."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
    runs = [hashes[i : i + 5] for i in range(len(hashes) - 4)] if len(hashes) >= 5 else [hashes] if hashes else []
    out = set()
    for run in runs:
        h = 42
        for x in run:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        out.add(signed(h))
    low = {x for x in out if x < -(1 << 63) + (1 << 64) // scale}
    return low or ({min(out)} if out else set())


def test_fingerprints_equal_plain_sketches(spark):
    texts = [t for t in corpus() if t is None or t.isascii()] + ["é" * 11, "日本 語 " * 700]
    rows = {r["doc_id"]: r for r in fingerprints.edited_pairs(documents(spark, texts)).collect()}
    as_text = lambda s: "".join(f"{x % (1 << 64):016X}" for x in sorted(s))
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        like = lambda x, y: len(x & y) / min(len(x), len(y)) if x and y else float(len(x) == len(y))
        assert (rows[i]["n_chars"], rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (len(t), as_text(a), as_text(b))
        assert (rows[i]["near_edited"], rows[i]["near_next"]) == (pytest.approx(like(a, b)), pytest.approx(like(a, c)))


def test_fingerprints_merge_and_contain(spark):
    a, b = " ".join(prose(random.Random(1), 400)), " ".join(prose(random.Random(2), 100))
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, whole string")
    for c in df.columns:
        df = fingerprints.with_sketch(df, c, f"{c}_s")
    row = df.select(fingerprints.merge(F.col("a_s"), F.col("b_s")).alias("m"), "whole_s", fingerprints.containment(F.col("a_s"), F.col("whole_s")).alias("c")).first()
    assert row["c"] == 1.0 and set(row["m"]) <= set(row["whole_s"]) and len(row["whole_s"]) - len(row["m"]) <= 4
    docs = documents(spark, ["x"])
    assert fingerprints.edited_pairs(docs.filter("false")).count() == 0
    assert fingerprints.edited_pairs(docs.withColumn("own", F.lit(1)).withColumn("key", F.lit(2))).first()["near_next"] == 1.0
    assert fingerprints.edited_pairs(docs.union(docs).withColumn("doc_id", F.lit(None).cast("long"))).count() == 2
