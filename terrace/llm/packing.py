"""Hierarchical packing of tokenised documents into context windows of several sizes.

Each document's ids end with one end id. Full longest windows are cut off first; what remains is routed to the smallest
tier that holds it. Every tier is then packed, longest first: a window takes its tier's largest remainder, and its gap
is filled from the shorter tiers, the largest fitting one first; a gap that no remainder fits is filled by cutting the
smallest. So all windows are full but the last of a task. Windows are spread over step groups so that the groups of one
batch hold about as many tokens each.

A task packs the rows it reads, in batches of ``BATCH_TOKENS``, and carries unfinished windows on: nothing is shuffled,
memory is bounded, and a lost task can be run again. Defined cases: a null or empty text is the end id alone; repeated
rows are packed once each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import textkernels as K
from terrace.llm.bpe import codec
from terrace.llm.shared import extended

TIERS = (256, 512, 1024, 2048)
END_ID = 1
BATCH_TOKENS = 1 << 20
#: Tokens of one step group.
STEP_TOKENS = 32 * 2048


class Pool:
    """Remainders by length; finding the largest that fits costs one operation on a bit set."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.lengths = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.by_length.setdefault(length, []).append((doc, start))
        self.lengths |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        held = self.by_length[length]
        doc, start = held.pop()
        if not held:
            del self.by_length[length]
            self.lengths &= ~(1 << length)
        return doc, start, length

    def largest(self, most: int) -> int:
        """The largest length up to ``most``, 0 if there is none."""
        return max(0, (self.lengths & ((2 << most) - 1)).bit_length() - 1)

    def smallest(self) -> int:
        return (self.lengths & -self.lengths).bit_length() - 1


def pack(lengths: list[int], last: bool, tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Windows (size, pieces as document, start, length) for documents of these lengths, and the pieces left over.

    Pieces are left over only when ``last`` is false: those of windows that the documents at hand don't fill.
    """
    tiers, pool, windows, left = tuple(sorted(tiers)), Pool(), [], []
    longest = tiers[-1]
    for doc, n in enumerate(lengths):
        full = n - n % longest
        windows += [(longest, [(doc, at, longest)]) for at in range(0, full, longest)]
        if n > full:
            pool.put(doc, full, n - full)
    for k in range(len(tiers) - 1, -1, -1):
        size, floor = tiers[k], tiers[k - 1] if k else 0
        while (first := pool.largest(size)) > floor:
            pieces = [pool.take(first)]
            gap = size - first
            while gap and pool.lengths:
                fit = pool.largest(gap)
                if fit:
                    pieces.append(pool.take(fit))
                    gap -= fit
                else:
                    doc, start, n = pool.take(pool.smallest())
                    pieces.append((doc, start, gap))
                    pool.put(doc, start + gap, n - gap)
                    gap = 0
            if gap and not last:
                left += pieces
            else:
                windows.append((size, pieces))
    return windows, left


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: long windows first, each to the group with the fewest tokens so far."""
    import heapq

    groups = max(1, round(sum(sizes) / step_tokens))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        total, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (total + sizes[k], g))
    return out


def pack_documents(docs: DataFrame, lexicon: str, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, batch_tokens: int = BATCH_TOKENS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (and the ids)."""
    frame = docs.select(key, F.col(text).cast("string").alias("text"))
    columns = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    schema = extended(frame.select(key).schema, columns + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, base = codec(lexicon), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        held: list[tuple[object, np.ndarray, int, int]] = []  # key scalar, ids, start of these ids, tokens of the document
        held_tokens, sequence, group = 0, 0, 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, held_tokens, sequence, group
            windows, left = pack([len(ids) for _, ids, _, _ in held], last, tiers)
            steps = step_groups([sum(n for _, _, n in pieces) for _, pieces in windows], step_tokens)
            out: list[list] = [[] for _ in range(9)]
            keys = []
            for (size, pieces), step in zip(windows, steps):
                at = 0
                for doc, start, n in pieces:
                    k, ids, first, tokens = held[doc]
                    keys.append(k)
                    part = ids[start : start + n]
                    for column, x in zip(out, (first + start, n, zlib.crc32(part), tokens, base + sequence, at, size, base + group + step, part)):
                        column.append(x)
                    at += n
                sequence += 1
            group += max(steps, default=-1) + 1
            held = [(held[d][0], held[d][1][s : s + n], held[d][2] + s, held[d][3]) for d, s, n in left]
            held_tokens = sum(n for _, _, n in left)
            arrays = [pa.array(keys, key_type), *(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.int32()), pa.array(out[7], pa.int64())]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in out[8]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            buf, offsets = K.buffers(batch.column(1))
            keys = batch.column(0).to_pylist()
            for a, b in K.slices(offsets):
                ids, at = c.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                for k in range(b - a):
                    held.append((keys[a + k], ids[at[k] : at[k + 1]], 0, int(at[k + 1] - at[k])))
                held_tokens += len(ids)
                if held_tokens >= batch_tokens:
                    yield flush(False)
        if held:
            yield flush(True)

    return frame.mapInArrow(run, schema)
