import datetime as dt

from pyspark.sql import functions as F

from terrace.operators import memory, relational, state, usage
from terrace.streaming import events

T0 = dt.datetime(2025, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


OBJECT = "id string, space string, path string, kind string, raw string, summary_micro string, summary_short string, summary_long string, tags array<string>, metadata map<string,string>, relevance string, pinned boolean, created_at timestamp, updated_at timestamp"


def objects(spark):
    rows = [
        ("m1", "demo", "demo/specs/runtime", "guide", "raw about runtime", "Runtime guide.", "short", "long", ["spec", "guide"], {"importance": "high"}, "high", True, T0, T0),
        ("m2", "demo", "demo/notes/other", "note", "text", "Other.", "short", "long", [], {}, "low", False, T0, at(5)),
    ]
    return spark.createDataFrame(rows, OBJECT)


def test_memory(spark):
    o = objects(spark)
    assert [(r["id"], r["score"]) for r in memory.rank_topic(o, "runtime").orderBy("place").collect()] == [("m1", 13.5), ("m2", 1.0)]
    assert [r["score"] for r in memory.rank_topic(o, "demo/specs", "patricia").orderBy("place").collect()] == [16.0, 3.0]
    bundle = memory.recall_context(o, "runtime", options=memory.Recall(limit=1, include_raw=True, include_metadata=True, freeze_clock="2025-01-01T00:00:00Z")).first()
    assert bundle["global_summary"] == "Context bundle for 'runtime' (1 items):\n• demo/specs/runtime — Runtime guide."
    assert bundle["sections"][0]["metadata"] == {"importance": "high"} and bundle["raw"][0]["kind"] == "guide"
    gate = memory.rank_topic(o.filter("id = 'm2'"), "x", options=memory.Recall(require_high_relevance=True))
    assert gate.count() == 1
    new = spark.createDataFrame([("m2", " Demo ", "p", "note", "Raw text", None, None, None, ["b", "a"], {"k": "v"}, None, None, T0, at(9))], OBJECT)
    after = memory.remember(o, new)
    got = after.filter("id = 'm2'").first()
    assert after.count() == 2 and got["tags"] == ["a", "b"] and got["metadata"] == {"k": "v", "space": "demo"} and got["summary_micro"] == "Raw text" and got["relevance"] == "medium"
    assert memory.set_pinned(o, "demo", "demo/notes/other").filter("pinned").count() == 2
    assert memory.expire(o, 1, F.lit(at(3 * 86400)).cast("timestamp")).count() == 1
    assert [r[0] for r in spark.createDataFrame([("  A b!/C-",), ("!!",)], "s string").select(memory.space_name(F.col("s"))).collect()] == ["a_b/c-", "default"]
    assert memory.strategy("GraphRAG") == "hybrid" and memory.strategy("nope") == "basic"
    assert memory.rank_kind(o, "GUIDE", "hybrid").first()["id"] == "m1" and memory.reset_space(o, "demo").count() == 0
    assert memory.space_summaries(o).first()["pinned"] == 1


def model_of_limit(calls, limit, window):
    out, held = {}, {}
    for key, who, when in sorted(calls, key=lambda c: (c[1], c[2], c[0])):
        opened, used = held.get(who, (None, 0))
        if opened is None or (when - opened).total_seconds() >= window:
            opened, used = when, 0
        held[who] = (opened, used + 1)
        out[key] = used + 1 <= limit
    return out


CALLS = [(i, i % 3, at((i * 37) % 400)) for i in range(60)]


def test_batch_limit_equals_a_plain_model(spark):
    df = spark.createDataFrame(CALLS, "id long, who long, at timestamp")
    got = {r["id"]: r["accepted"] for r in state.fixed_window_limit(df, "who", "at", "id", 4).collect()}
    assert got == model_of_limit(CALLS, 4, 60)
    assert all(r["accepted"] for r in state.fixed_window_limit(df, "who", "at", "id", 0).collect())


def test_streams(spark, tmp_path):
    df = spark.createDataFrame(CALLS, "id long, who long, at timestamp").withColumn("v", F.col("id") * 1.0)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: events.file_stream(spark, str(tmp_path / "in"), "id long, who long, at timestamp, v double")
    got = {}
    events.run_to_end(events.limited(stream(), "who", "at", "id", 4), lambda b, n: got.update({r["id"]: r["accepted"] for r in b.collect()}), str(tmp_path / "c1"))
    assert got == model_of_limit(CALLS, 4, 60)
    counts = {}
    windows = events.tumbling(stream(), "at", "1 minute", "10 minutes", ["who"], {"n": F.count("*")})
    events.run_to_end(windows, lambda b, n: counts.update({(r["start"], r["who"]): r["n"] for r in b.collect()}), str(tmp_path / "c2"), "update")
    want = {(r["start"], r["who"]): r["n"] for r in df.groupBy(F.window("at", "1 minute"), "who").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "who", "n").collect()}
    assert counts == want
    events.into_parquet(stream().select("id"), str(tmp_path / "out"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    events.into_parquet(events.distinct_events(stream(), "at", "1 hour", ["who"]), str(tmp_path / "out4"), str(tmp_path / "c4"))
    assert spark.read.parquet(str(tmp_path / "out4")).count() == 3
    last = {}
    events.run_to_end(events.last_values(stream(), "who", "at", "v"), lambda b, n: last.update({r["who"]: r["v"] for r in b.collect()}), str(tmp_path / "c5"), "update")
    assert last == {r["who"]: r["v"] for r in df.groupBy("who").agg(F.max_by("v", "at").alias("v")).collect()}
    events.run_to_end(stream(), events.upsert_parquet(str(tmp_path / "up"), ["id"]), str(tmp_path / "c6"))
    assert events.latest(spark, str(tmp_path / "up"), ["id"]).count() == 60


def test_state(spark):
    log = spark.createDataFrame([("s", 1, "k", "a", T0, None), ("s", 2, "k", "b", T0, 1000), ("s", 3, "j", "c", T0, 5000)], "scope string, seq long, key string, value string, created_at timestamp, ttl_ms long")
    now = F.lit(at(2)).cast("timestamp")
    assert sorted(r["seq"] for r in state.live(log, now).collect()) == [1, 3]
    asked = spark.createDataFrame([("k",), ("j",), ("z",)], "key string")
    assert sorted(tuple(r) for r in state.lookup(log, asked, ["key"], "value", now).fillna("-").collect()) == [("j", True, "c"), ("k", True, "-"), ("z", False, "-")]
    assert [r["seq"] for r in state.last_n(log, 2).orderBy("place").collect()] == [2, 3]
    assert state.invalidate(log, "k").count() == 1
    turns = spark.createDataFrame([("a", 1, "user", "hi", T0), ("a", 2, "bot", None, T0), ("b", 1, "user", "yo", at(100))], "s string, n int, role string, text string, at timestamp")
    assert state.history(turns, "s", ["n"], "role", "text").filter("s = 'a'").first()["history"] == "user: hi\nbot: "
    assert state.collect_garbage(turns, "s", "at", F.lit(at(110)).cast("timestamp"), 60).select("s").distinct().count() == 1
    calls = spark.createDataFrame([("p", 1, 3.0), ("p", 2, 4.0), ("q", 1, 9.0)], "p string, n int, cost double")
    budgets = spark.createDataFrame([("p", 5.0)], "p string, budget double")
    assert sorted((r["p"], r["n"], r["allowed"]) for r in usage.within_budget(calls, budgets, "p", ["n"], "cost").collect()) == [("p", 1, True), ("p", 2, False), ("q", 1, True)]
    priced = spark.createDataFrame([("gpt-4", 1000, 1000), ("other", 1, 1)], "model string, prompt_tokens long, completion_tokens long")
    assert sorted(round(r["cost"], 6) for r in usage.with_cost(priced).collect()) == [0.0, 0.09]


def test_relational(spark):
    a = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t int")
    b = spark.createDataFrame([(1, 5, "x"), (1, 20, "y"), (2, 6, "z")], "k int, t int, v string")
    assert sorted(relational.asof_join(a, b, ["k"], "t", ["v"]).fillna("-").collect()) == [(1, 10, "x"), (1, 20, "y"), (2, 5, "-")]
    spans = spark.createDataFrame([(0.0, 10.0, "p"), (10.0, 35.0, "q"), (4.0, 4.0, "none")], "low double, high double, name string")
    points = spark.createDataFrame([(-1.0,), (0.0,), (10.0,), (34.9,), (35.0,)], "x double")
    assert sorted((r["x"], r["name"]) for r in relational.range_join(points, spans, "x", "low", "high", 7.0).collect()) == [(0.0, "p"), (10.0, "q"), (34.9, "q")]
    assert relational.rollup(a, ["k"], "t").count() == 3


def test_range_join_of_a_full_cell_is_many_tasks(spark, monkeypatch):
    """All points and intervals in one cell: each pair once, in any of the blocks, and no task with more than its share."""
    monkeypatch.setattr(relational, "BLOCK_ROWS", 50)
    points = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") % 97 / 10).alias("x"))
    spans = spark.range(300).select(F.col("id").alias("i"), (F.col("id") % 9).cast("double").alias("low"), (F.col("id") % 9 + 1.5).alias("high"))
    met = relational.range_join(points, spans.union(spark.createDataFrame([(-1, None, 3.0), (-2, 4.0, 1.0)], "i long, low double, high double")), "x", "low", "high", 20.0)
    wanted = points.join(spans, (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
    assert met.columns == wanted.columns
    assert sorted(met.select("p", "i").collect()) == sorted(wanted.select("p", "i").collect())
    shares = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 2 and max(shares) < 0.7 * sum(shares)
