"""A Bloom filter, set by tasks and merged in parts, that lets tasks pass by rows with no partner."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import blocks

#: Bits of a filter: sixteen for each key, up to 32 megabytes for each worker. Beyond some sixteen million keys more rows pass; none is lost.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Words of a filter that are merged apart, in one row.
PART = 1 << 18
_U = np.uint64


def build(keys: DataFrame, key: str, most: int | None = None) -> np.ndarray:
    """Words of the filter of a column of 64-bit hashes, for ``most`` keys if their number is known."""
    column = keys.select(F.col(key).cast("long").alias("key"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            yield {"key": batch.column(0).drop_null().to_numpy().view(_U)}

    return build_from(column, read, column.count() if most is None else most)


def build_from(rows: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray]]], n: int) -> np.ndarray:
    """Words of the filter of the n keys that ``read`` takes out of ``rows``: tasks set bits of their own and send words packed."""
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    part = min(PART, bits // 32)
    parts = bits // 32 // part

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 32, np.uint32)
        for columns in read(batches):
            for at in range(0, len(columns["key"]), 1 << 18):
                set_bits(words, columns["key"][at : at + (1 << 18)])
        word = np.flatnonzero(words)
        yield blocks.dealt(word // part, {"word": word.astype(np.uint32), "bits": words[word]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, found in blocks.gathered([batch]).items():
                words = held.setdefault(shard, np.zeros(part, np.uint32))
                for x in found:
                    words[x["word"] - np.uint32(shard * part)] |= x["bits"]
        for shard, words in held.items():
            yield blocks.dealt(np.array([shard]), {"bits": words[None]})

    out = np.zeros((parts, part), np.uint32)
    found = rows.mapInArrow(task, blocks.SCHEMA).repartitionById(parts, F.col("shard")).mapInArrow(merged, blocks.SCHEMA).toArrow()
    for shard, words in blocks.gathered(found.to_batches()).items():
        out[shard] = words[0]["bits"][0]
    return out.reshape(-1)


def set_bits(words: np.ndarray, keys: np.ndarray) -> None:
    """Enter 64-bit keys into a filter."""
    mask = _U(len(words) * 32 - 1)
    spots = np.sort(np.concatenate([keys & mask, (keys >> _U(32)) & mask]))
    if len(spots):
        word = (spots >> _U(5)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] |= np.bitwise_or.reduceat(np.uint32(1) << (spots & _U(31)).astype(np.uint32), first)


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each 64-bit key may be in the filter; false is certain."""
    keys, mask = keys.astype(_U), _U(len(words) * 32 - 1)
    out = np.ones(len(keys), bool)
    for spot in (keys & mask, (keys >> _U(32)) & mask):
        spot = spot.astype(np.int64)
        out &= (words[spot >> 5] >> (spot & 31).astype(np.uint32)) & 1 == 1
    return out
