"""Operators against plain versions: windows of a budget, running sums, limits, masks, fused passages, schema gates, caches."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from terrace.errors import DataError
from terrace.functions import stdlib
from terrace.operators import chunking, jsonops, relational, retrieval, state, validation
from terrace.sources import readers, sinks


def test_budget_window_equals_a_plain_sweep(spark):
    rng = random.Random(6)
    hits = [(i, " ".join(["w"] * rng.choice([0, 0, 1, 3, 9, 40])), rng.choice([None, 0.5, 0.5, rng.random()])) for i in range(200)]
    df = spark.createDataFrame(hits, "k long, content string, score double").repartition(5)
    for budget, margin in ((0, 0), (1, 0), (60, 10), (10_000, 0), (5, 9)):
        total, want = 0, {}
        for k, text, score in sorted(hits, key=lambda h: (-(h[2] if h[2] is not None else float("-inf")), h[0])):
            total += len(text.split())
            if total <= budget - margin:
                want[k] = total
        assert {r["k"]: r["total"] for r in retrieval.optimize_window(df, "k", budget, margin).collect()} == want
    assert retrieval.optimize_window(df.limit(0), "k", 10).count() == 0


def test_running_sums_equal_plain_ones(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 9 + ["cold", None]), rng.choice([None, 5, rng.randrange(1000)]), i, rng.choice([None, rng.randrange(9)])) for i in range(700)]
    df = spark.createDataFrame(rows, "by string, at long, id long, v long").repartition(3)
    sums, want = {}, {}
    for by, at, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        if v is not None:
            sums[by] = sums.get(by, 0) + v
        want[i] = sums.get(by)
    assert {r["id"]: r["out"] for r in relational.running_sum(df, ["by"], ["at", "id"], "v", "out").collect()} == want
    assert relational.running_sum(df.limit(0), ["by"], ["at", "id"], "v", "out").count() == 0


def test_places_among_cuts(spark):
    for cuts in ([], [3], [1, 4, 4, 9], list(range(0, 100, 7))):
        found = spark.range(-2, 110).select("id", relational.place_among(F.col("id"), cuts).alias("p")).collect()
        assert all(r["p"] == sum(c < r["id"] for c in cuts) for r in found)


def test_limits_equal_a_plain_sweep(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, 1_700_000_000 + rng.randrange(400)) for i in range(500)]
    calls = spark.createDataFrame(rows, "who long, id long, s long").select("who", "id", F.timestamp_seconds("s").alias("at"))
    for limit in (1, 3, 1000):
        open_, want = {}, {}
        for who, i, s in sorted(rows, key=lambda r: (r[2], r[1])):
            begun, used = open_.get(who, (s, 0))
            if s - begun >= 60:
                begun, used = s, 0
            open_[who] = begun, used + 1
            want[i] = used < limit
        assert {r["id"]: r["accepted"] for r in state.fixed_window_limit(calls, "who", "at", "id", limit).collect()} == want


def test_masks_of_personal_data(spark):
    cases = {
        "write to a.b+c@mail.example.org now": "write to [EMAIL] now", "call 555-123-4567 or (555) 123 4567": "call [PHONE] or [PHONE]", "+1 555.123.4567": "[PHONE]", "a@b": "a@b", "12345678": "12345678",
        "no 555-12-4567": "no 555-12-4567", "x@y.co, z@w.info": "[EMAIL], [EMAIL]", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", stdlib.pii_redact(F.col("t")).alias("m"), stdlib.free_of_pii(F.col("t")).alias("free")).collect()
    assert {r["t"]: r["m"] for r in rows} == cases
    assert all(r["free"] == (r["t"] == r["m"]) for r in rows)


def test_fused_passages_equal_a_plain_choice(spark):
    rng = random.Random(8)
    hits = [(i, " ".join(rng.choices("a b c d e f".split(), k=rng.randrange(1, 6))), round(rng.random(), 2)) for i in range(30)]
    chosen = []
    for k, text, score in sorted(hits, key=lambda h: (-h[2], h[0])):
        own = set(text.split())
        if len(chosen) < 4 and all(len(own & set(t.split())) / len(own | set(t.split())) < 0.5 for _, t in chosen):
            chosen.append((k, text))
    best = {t: min((-s, k) for k, u, s in hits if u == t)[1] for _, t in chosen}
    want = "\n\n".join(f"[{i}] {t}" for i, (_, t) in enumerate(chosen, 1)) + "\n\nCitations:\n" + "\n".join(f"[{i}] {best[t]}" for i, (_, t) in enumerate(chosen, 1))
    df = spark.createDataFrame(hits, "k long, content string, score double")
    assert [r["fused"] for r in retrieval.fuse_distinct(df, "k", 4, 0.5).collect()] == [want]


def test_schema_gate_of_files(spark, tmp_path):
    schema = {"type": "object", "required": ["name"], "properties": {"age": {"type": "number", "minimum": 0}}}
    for value, want in (({"name": "a", "age": 3}, True), ({"age": 3}, False), ([{"name": "a", "age": 1}, {"name": "b", "age": -1}], False)):
        path = tmp_path / f"{abs(hash(str(value)))}.json"
        path.write_text(json.dumps(value))
        assert jsonops.value_is_valid(spark, str(path), schema) is want
    (tmp_path / "broken.json").write_text("{not json")
    assert jsonops.value_is_valid(spark, str(tmp_path / "broken.json"), schema) is False


def test_json_from_an_address_is_gated(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(readers.HTTP_GATE, raising=False)
    with pytest.raises(DataError):
        readers.load_json_value(spark, "http://localhost/x.json", folder=str(tmp_path))


def test_dataset_cache_and_small_files(spark, tmp_path):
    sinks.save_json({"a": [1, 2]}, str(tmp_path / "v.json"))
    assert json.loads((tmp_path / "v.json").read_text()) == {"a": [1, 2]}
    sinks.save_json("text", str(tmp_path / "w.json"))
    assert json.loads((tmp_path / "w.json").read_text()) == {"value": "text"}
    sinks.save_csv(spark.range(4), str(tmp_path / "t.csv"))
    cache = readers.DatasetCache(spark)
    first = cache.load(str(tmp_path / "t.csv"))
    assert cache.load(str(tmp_path / "t.csv")) is first and first.df.count() == 4
    cache.forget(str(tmp_path / "t.csv"))
    assert cache.load(str(tmp_path / "t.csv")) is not first


def test_contents_of_repeated_and_null_keys(spark):
    rows = [("b", "x"), ("a", "x"), ("a", "x"), (None, "x"), (None, "only"), ("c", None), ("d", None)]
    found = chunking.new_by_content(spark.createDataFrame(rows, "path string, content string"))
    assert sorted((r["path"], r["content"]) for r in found.filter("content IS NOT NULL").collect()) == [("a", "x")]


def test_answers_that_are_missing(spark):
    rows = [(1, 1, "aa"), (1, 2, None), (1, 3, "bb"), (2, 1, None)]
    df = spark.createDataFrame(rows, "g long, n long, t string")
    assert {r["g"]: r["combined"] for r in validation.combine(df, "g", "n", "t", "best_of_n").collect()} == {1: "bb", 2: ""}
    assert {r["g"]: r["combined"] for r in validation.combine(df, "g", "n", "t", "first").collect()} == {1: "aa", 2: None}
    assert validation.answered(df, lambda s: s.fillna("").str.upper(), "t").filter("response = 'AA'").count() == 1
    assert {r["g"] for r in validation.ensemble_validation(df, "g", "n", "t").collect()} == {1, 2}


def test_texts_and_stamps(spark):
    row = spark.range(1).select(stdlib.now_iso8601().alias("t"), stdlib.json_as_string(stdlib.json_parse(F.lit('"x"'))).alias("s"), stdlib.json_as_string(stdlib.json_parse(F.lit("3"))).alias("n")).first()
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", row["t"]) and row["s"] == "x" and row["n"] is None
