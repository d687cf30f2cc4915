"""Columns of numbers that tasks send each other packed: one row for each task and shard, not one for each number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from terrace.llm.arrayfile import pack_arrays, unpack_arrays

SCHEMA = "shard int, block binary"
_U = np.uint64


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Shard of each 64-bit key, by its leading bits."""
    return (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def dealt(shards: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (shard, block) of columns that are in the order of their shards."""
    at = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(shards))
    return pa.RecordBatch.from_arrays([pa.array(shards[at].astype(np.int32)), pa.array([pack_arrays({k: v[a:b] for k, v in columns.items()}) for a, b in zip(at, ends)], pa.binary())], ["shard", "block"])


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict[str, np.ndarray]]]:
    """Blocks of each shard."""
    out: dict[int, list[dict[str, np.ndarray]]] = {}
    for batch in batches:
        for shard, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            out.setdefault(shard, []).append(unpack_arrays(memoryview(block.as_buffer()).cast("B")))
    return out


def joined(blocks: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([b[k] for b in blocks]) for k in blocks[0]}


def slim(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
