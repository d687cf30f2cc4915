import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_llm import documents
from pyspark.sql import functions as F

from terrace.llm import bloom, line_dedup


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, edits):
    line = list(line)
    for at in sorted(rng.sample(range(len(line)), edits), reverse=True):
        line[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(99)), line[at]], ["other" + str(rng.randrange(99))]])
    return line


def corpus():
    """Lines with edits up to the bound of their length and beyond it, words rare and common, and one line's many edits."""
    rng, lines = random.Random(11), []
    for size in (8, 9, 10, 11, 14, 15, 23, 50, 120, 200):
        for words in (6, 40, 5000):
            base = [f"w{rng.randrange(words)}" for _ in range(size)]
            lines += [base] + [edited(rng, base, e) for e in (1, size // 5 - 1, size // 5, size // 5 + 1) if e > 0]
    base = [f"hot{i}" for i in range(30)]
    lines += [edited(rng, base, rng.randrange(8)) for _ in range(40)]
    rng.shuffle(lines)
    return [" ".join(x) for x in lines]


def test_bound_grows_with_the_line(spark):
    lines = corpus()
    split = [x.split() for x in lines]
    gone = {i for i, b in enumerate(split) if any(plain_distance(a, b) <= max(len(a), len(b)) // 5 for a in split[:i])}
    beyond_one = {i for i in gone if not any(plain_distance(a, split[i]) <= 1 for a in split[:i])}
    assert len(beyond_one) > 20
    rows = line_dedup.dedup_lines(documents(spark, lines)).collect()
    assert {r["doc_id"] for r in rows if r["n_removed"]} == gone


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(0, 9))
def test_distance(a, b, most):
    assert line_dedup.distance(a, b) == plain_distance(a, b)
    assert line_dedup.within_edits(np.array(a, int), np.array(b, int), most) == (plain_distance(a, b) <= most)


def test_lines_of_one_group_are_told_apart_before_pairs_are_made():
    """Lines with one passage in common, each too far from the others: the marks alone let them pass, finer ones don't."""
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    lines = [np.concatenate([common, rng.integers(0, 1 << 63, 20).astype(np.uint64)]) for _ in range(40)]
    lines.append(np.concatenate([lines[0][:-1], lines[1][-1:]]))  # near the first
    words = np.concatenate(lines)
    size = np.array([len(x) for x in lines])
    first = np.cumsum(size) - size
    x = {"n": size, "h": np.arange(len(lines)).astype(np.uint64), "words": words, "first": first, "size": size}
    x["marks"] = line_dedup._marks(x, np.arange(len(lines)))
    held = line_dedup.FineMarks("", 0)
    rows = line_dedup._fine_marks(words, first, size)
    held._rows = lambda h: rows[h.astype(np.int64)]
    i, j = np.triu_indices(len(lines), 1)
    near = np.array([line_dedup.near(lines[a], lines[b]) for a, b in zip(i, j)])
    coarse, fine = line_dedup._may_be_near(x, i, j), held.may_be_near(x, i, j)
    assert near.any() and coarse[near].all() and fine[near].all()
    assert (coarse & fine).sum() < 0.2 * coarse.sum()


def test_counts_that_end_still_bound_the_edits():
    """A word that fills its mark in one line and is rare in the other tells the lines apart."""
    words = np.repeat(np.arange(2, dtype=np.uint64), [40, 40])
    size = np.array([40, 40])
    x = {"n": size, "words": words, "first": np.array([0, 40]), "size": size}
    x["marks"] = line_dedup._marks(x, np.arange(2))
    assert not line_dedup._may_be_near(x, np.array([1]), np.array([0]))[0]


def test_texts_are_not_moved(spark):
    """Lines that go are looked up where the texts lie; a shuffle of whole texts is no part of the plan."""
    docs = documents(spark, ["one line of six plain words", "one line of six plain words\nown words stay"])
    rows = line_dedup.dedup_lines(docs)
    plan, before = (x._jdf.queryExecution().executedPlan().toString() for x in (rows, docs))
    assert plan.count("Exchange") == before.count("Exchange") and "Join" not in plan
    assert {r["doc_id"]: r["text"] for r in rows.collect()} == {0: "one line of six plain words", 1: "own words stay"}


def test_filter_is_set_by_tasks(spark):
    """A filter of many keys is the one that a single task would set, without a row for each bit."""
    keys = spark.range(60_000, numPartitions=5).select(F.xxhash64("id").alias("key"))
    words = bloom.build(keys, "key")
    held = np.array([r["key"] for r in keys.collect()]).view(np.uint64)
    plain = np.zeros(len(words), np.uint32)
    bloom.set_bits(plain, held)
    assert (words == plain).all() and bloom.may_hold(words, held).all()
    others = np.arange(60_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert bloom.may_hold(words, others).mean() < 0.05


def test_line_with_many_allowed_ones_finds_the_last(spark):
    """Lines that marks allow but that aren't near, as their words stand in another order, come before the near one."""
    rng = random.Random(5)
    base = [f"word{i}" for i in range(40)]
    # the same words in pieces of other order: two words at the end keep the bucket
    lines = []
    for _ in range(90):
        pieces = [base[i : i + 2] for i in range(0, 40, 2)]
        rng.shuffle(pieces)
        lines.append([w for p in pieces for w in p])
    lines.append([*lines[70][:-1], "other"])
    rows = line_dedup.dedup_lines(documents(spark, [" ".join(x) for x in lines])).collect()
    gone = {i for i, b in enumerate(lines) if any(plain_distance(a, b) <= max(len(a), len(b)) // 5 for a in lines[:i])}
    assert 90 in gone and {r["doc_id"] for r in rows if r["n_removed"]} == gone
