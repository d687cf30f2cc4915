"""Bounded, expiring and keyed state as queries over an append log (scope, seq, key, value, created_at, ttl_ms)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.errors import DataError

CAPACITY = 100


def _millis(at: Column | str) -> Column:
    return F.unix_millis((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def live(log: DataFrame, now: Column) -> DataFrame:
    """Entries whose time to live, if they have one, is not over."""
    age = _millis(now) - _millis("created_at")
    return log.filter(F.col("ttl_ms").isNull() | (age <= F.col("ttl_ms")))


def last_n(log: DataFrame, n: int = CAPACITY, by: str = "scope", seq: str = "seq") -> DataFrame:
    """The newest n entries of each scope, with place from the oldest of them."""
    newest = Window.partitionBy(by).orderBy(F.desc(seq))
    kept = log.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(seq))).drop("_r")


# The names of the strategies by which a memory is kept.
STRATEGIES = ("buffer", "vector", "summary", "hybrid")


def recalled(log: DataFrame, strategy: str, summaries: DataFrame, n: int = CAPACITY, by: str = "scope", seq: str = "seq", text: str = "value") -> DataFrame:
    """What a memory gives back for each scope: by, place and text. All strategies keep the newest n entries; ``summary`` gives
    the stored summary (by, summary) alone where a scope has one."""
    if strategy not in STRATEGIES:
        raise DataError(f"unknown strategy {strategy!r}")
    held = last_n(log, n, by, seq).select(by, "place", text)
    if strategy != "summary":
        return held
    stored = summaries.filter(F.col("summary").isNotNull()).select(by, F.lit(1).alias("place"), F.col("summary").alias(text))
    return held.join(stored.select(by), by, "left_anti").unionByName(stored)


def last_write(log: DataFrame, by: list[str], value: str, seq: str = "seq") -> DataFrame:
    """The last value written under each key."""
    return log.groupBy(*by).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def lookup(log: DataFrame, keys: DataFrame, by: list[str], value: str, now: Column, seq: str = "seq") -> DataFrame:
    """Keys with known (ever written) and the last value, null if it has expired."""
    last = log.groupBy(*by).agg(F.max_by(F.struct(value, "created_at", "ttl_ms"), seq).alias("e"))
    age = _millis(now) - _millis("e.created_at")
    fresh = F.col("e").isNotNull() & (F.col("e.ttl_ms").isNull() | (age <= F.col("e.ttl_ms")))
    return keys.join(last, by, "left").select(*by, F.col("e").isNotNull().alias("known"), F.when(fresh, F.col(f"e.{value}")).alias(value))


def least_recent(touches: DataFrame, capacity: int, by: str, key: str, seq: str) -> DataFrame:
    """Keys of each cache that are out: all but the last touched."""
    last = touches.groupBy(by, key).agg(F.max(seq).alias("last"))
    order = Window.partitionBy(by).orderBy(F.desc("last"), key)
    # those that stay are cut to the capacity in each task before they meet; the rest never does
    held = last.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= capacity).select(by, key)
    both = [last[c].eqNullSafe(held[c]) for c in (by, key)]
    return last.join(held, both[0] & both[1], "left_anti")


def invalidate(entries: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Entries without those whose key begins with the prefix."""
    return entries.filter(~F.startswith(F.col(key), F.lit(prefix)))


def history(turns: DataFrame, session: str, order: list[str], role: str, text: str) -> DataFrame:
    """Per session: `role: text` lines in order."""
    line = F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))
    held = turns.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("h"))
    return held.select(session, F.array_join(F.transform("h", lambda x: x["_line"]), "\n").alias("history"))


def sessions(turns: DataFrame, session: str, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Sessions with turns, first and last time, and whether they have expired."""
    out = turns.groupBy(session).agg(F.count("*").alias("turns"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return out.withColumn("expired", _millis(now) - _millis("last_at") > ttl_seconds * 1000)


def collect_garbage(turns: DataFrame, session: str, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Turns of sessions that have not expired."""
    return turns.join(sessions(turns, session, at, now, ttl_seconds).filter("expired").select(session), session, "left_anti")


def output_events(texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Characters of a text in events of a fixed size: key, index, offset, length, total and chunk."""
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    each = texts.filter(n > 0).select(key, F.col(text).alias("_t"), n.alias("total"), F.posexplode(starts).alias("index", "offset"))
    chunk = F.substring("_t", F.col("offset") + 1, F.lit(size))
    return each.select(key, "index", "offset", F.char_length(chunk).alias("length"), "total", chunk.alias("chunk"))


def fixed_window_limit(calls: DataFrame, by: str, at: str, key: str, limit: int, window_seconds: int = 60) -> DataFrame:
    """Adds accepted: a caller's window begins with the first call after the last window's end, and takes ``limit`` calls;
    0 takes all. Calls of a caller are passed in order, in Arrow batches, with window and count as the only state."""
    if limit <= 0:
        return calls.withColumn("accepted", F.lit(True))
    ordered = calls.repartition(by).sortWithinPartitions(by, at, key)
    schema = ordered.withColumn("accepted", F.lit(True)).schema
    who, when, width = calls.columns.index(by), calls.columns.index(at), window_seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller, opened, used = object(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = pc.dictionary_encode(batch.column(who), null_encoding="encode").indices.to_numpy()
            times = pc.cast(batch.column(when), pa.timestamp("us", batch.schema.field(when).type.tz)).cast(pa.int64()).to_numpy()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            accepted = np.zeros(len(code), bool)
            for a, b in zip(starts, np.append(starts[1:], len(code))):
                name, at_ = batch.column(who)[int(a)].as_py(), int(a)
                if a or name != caller:
                    caller, opened, used = name, int(times[a]), 0
                while at_ < b:  # from window to window
                    if times[at_] - opened >= width:
                        opened, used = int(times[at_]), 0
                    end = at_ + int(np.searchsorted(times[at_:b], opened + width))
                    accepted[at_ : min(end, at_ + max(limit - used, 0))] = True
                    used, at_ = used + end - at_, end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted)], schema.names)

    return ordered.mapInArrow(run, schema)
