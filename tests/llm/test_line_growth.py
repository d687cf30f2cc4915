import random

import numpy as np
from plain_llm import documents
from pyspark.sql import functions as F

from terrace.llm import blocks, line_dedup
from terrace.llm import textkernels as K


def lines_with_passage(rng, n, passage, own):
    """Lines that have a passage in common and else words of their own."""
    return [" ".join([*(f"own{rng.randrange(10**9)}" for _ in range(own)), *passage, *(f"own{rng.randrange(10**9)}" for _ in range(own))]) for _ in range(n)]


def test_passage_of_unlike_lines_makes_no_large_bucket(spark):
    """Lines that share a passage of long words are known by their other runs, so that they aren't tried against each other."""
    rng = random.Random(2)
    passage = [f"averylongwordofthepassage{k}" for k in range(6)]
    docs = documents(spark, lines_with_passage(rng, 600, passage, 15)).select(F.col("doc_id").cast("long").alias("doc"), "text")
    bits = 2
    common = spark.sparkContext.broadcast(line_dedup._common_runs(docs, bits))
    met = line_dedup._met(line_dedup._keys(docs, bits, common), bits).filter(F.shiftright("shard", bits) == line_dedup.RUNS)
    rows = [x for parts in blocks.gathered(met.select("shard", "block").toArrow().to_batches()).values() for x in parts]
    assert all(line_dedup._members(x["key"])[1].max(initial=0) <= line_dedup.FEW for x in rows)


def test_near_lines_with_a_passage_are_found(spark):
    """What runs come last changes no result: near copies among such lines go, whether the passage is most of the line or little."""
    rng = random.Random(3)
    for own, words in ((15, 6), (2, 40)):
        lines = lines_with_passage(rng, 120, [f"averylongwordofthepassage{k}" for k in range(words)], own)
        for k in (3, 50, 70):
            copy = lines[k].split()
            copy[1] = "other"
            lines.append(" ".join(copy))
        words_of = [[hash(w) & 0xFFFF_FFFF for w in x.split()] for x in lines]
        gone = {i for i, b in enumerate(words_of) if any(line_dedup.near(np.array(a), np.array(b)) for a in words_of[:i])}
        rows = line_dedup.dedup_lines(documents(spark, lines)).collect()
        assert {120, 121, 122} <= gone and {r["doc_id"] for r in rows if r["n_removed"]} == gone


def test_common_runs_come_last():
    """Of a line's runs those of the filter are taken only where the others don't suffice."""
    text = " ".join([f"plain{k}" for k in range(30)] + [f"thelongestwordsofall{k}" for k in range(6)])
    parsed = line_dedup.line_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    first = line_dedup._known_runs(parsed)
    runs = parsed[5](np.arange(30, 35), np.arange(32, 37))
    assert np.isin(runs, first["key"]).all()
    common = np.zeros(1 << 15, np.uint32)
    line_dedup.bloom.set_bits(common, runs)
    assert not np.isin(runs, line_dedup._known_runs(parsed, common)["key"]).any()


def test_many_pairs_at_once_are_judged_like_each_alone():
    """Lines of all sizes, with edits up to the bound and beyond, words rare and common."""
    rng, lines = random.Random(4), []
    for n in (8, 9, 10, 14, 15, 16, 31, 39, 40, 41, 79, 80, 100, 159, 160, 161, 319, 320, 400, 599, 601, 700):
        for words in (2, 5, 10**6):
            base = [rng.randrange(words) for _ in range(n)]
            for edits in (0, 1, n // 10, n // 5 - 1, n // 5, n // 5 + 1):
                line = list(base)
                for at in sorted(rng.sample(range(n), edits), reverse=True):
                    line[at : at + 1] = rng.choice([[], [line[at], 10**7 + rng.randrange(9)], [10**7 + rng.randrange(9)]])
                lines.append(line)
    size = np.array([len(x) for x in lines])
    first, words = np.cumsum(size) - size, np.concatenate([np.array(x, np.uint64) for x in lines])
    i = np.repeat(np.arange(0, len(lines), 6), 6)
    j = np.arange(len(lines))
    i, j = np.concatenate([i, j[:-7], j]), np.concatenate([j, j[7:], j])
    want = [line_dedup.near(words[first[a] : first[a] + size[a]], words[first[b] : first[b] + size[b]]) for a, b in zip(i, j)]
    got = line_dedup.near_pairs(words, first, size, i, j)
    assert 100 < sum(want) < len(want) and got.tolist() == want


def test_words_in_files_are_the_words(tmp_path):
    """What a line's place in the files leads to are its words, as many bits of each as files hold."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    with line_dedup.open_shared(f"file://{tmp_path}/{7:016x}") as out:
        out.write(line_dedup._packed_words(words))
    h = np.sort(rng.integers(0, 1 << 63, 3).astype(np.uint64))
    columns = {"h": h, "file": np.full(3, 7, np.uint64), "at": np.array([20, 0, 35]), "n": np.array([15, 20, 15], np.int32)}
    line_dedup.write_shared(f"file://{tmp_path}/000000", line_dedup.pack_arrays(columns))
    got, first, size = line_dedup.LineFiles(f"file://{tmp_path}", 0).words(h[[2, 0, 1]])
    held = words & np.uint64((1 << line_dedup.WORD_BITS) - 1)
    assert [got[a : a + n].tolist() for a, n in zip(first, size)] == [held[35:].tolist(), held[20:35].tolist(), held[:20].tolist()]
    assert K.ragged_positions(first, size).tolist() == list(range(50))
