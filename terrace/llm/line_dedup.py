"""Line deduplication across all documents by a deletion-neighbourhood join.

A line is the sequence of its lower-cased words; its edit distance to another counts words put in, left out or changed.
Lines with equal words are found by hash. Two lines are near if their distance is at most a fifth of the longer one's
words (a similarity of 0.8), so lines of one to four words have no near ones.

Where the longer has five to nine words the bound is one edit, and near lines are found by their deletion variants: of
two lines of equal length that differ in one word, both give the same variant when they leave out that place, and of
lines that differ by one word the longer gives the shorter.
Variants travel as hashed keys; equal keys are joined to the earliest line of the bucket, and the pair's edit distance is
verified on the words. Buckets of one place are cliques and buckets of a shorter line are stars, so one partner each
suffices. A line goes if an earlier line, by key and then line number, is equal or near; the earliest stays.

Variants are many, so lines that cannot have a partner are passed over first, exactly: two lines within one edit share
their first or their last half words. Lines that share such a half, like the variants' own keys that two lines share, are
told to the tasks by a Bloom filter of fixed size, whose false answers cost time only.

Where the longer has ten words or more, near lines are found by the pairs of neighbouring words that they share. Each
line is known by its first pairs in one order for all lines: by so many that more of them lie apart than there may be
edits. Then no near line can lack all of them, and of two near lines the one whose first pairs end earlier in the order
shares one with the first pairs of the other. Any order will do; long words come first, and last the pairs that several
lines of a part of the documents are known by, so that a passage that many unlike lines have doesn't bring these together.
Pairs that two lines have are found by their hashes alone, which with the lines' hashes make the buckets; places, numbers
of words and marks of these lines, counts of their words by a few bits of their hashes, which bound the edits from below,
lie in files, once for each line, and so do their words.
Lines of a small bucket are tried by marks against every earlier one in it, those of a large one first against its earliest
line only; what passes is dealt by line and verified on the words, many pairs at once. Lines of large buckets that stay open
after that are tried in their buckets against the next eight, the next 56 and every earlier line there, by marks, by finer
marks and on the words, until one is near.

Texts are read where they lie and never shuffled: what goes is told by files, too, hashes of lines with the first document
that has them, or of near ones, and each task looks up the lines of its own texts.

Defined cases: a null text is empty and stays null; lines without words stay; rows with a null key are left as they are;
rows that share a key count as one document; a document may lose all its lines and then has an empty text. Keys are whole
numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import blocks, bloom
from terrace.llm import textkernels as K
from terrace.llm.arrayfile import map_shared, open_shared, pack_arrays, view_shared, write_shared
from terrace.llm.shared import count_slices, dropped, extended, released, removed, shared_dir, written

#: Lines with fewer than MIN_WORDS words have no near ones; of MIN_WORDS * e words and more, near ones are up to e edits away.
MIN_WORDS = 5
#: Marks by which pairs of lines are passed over, a power of two, and the count at which they end; the longer of two lines from which on shared runs of RUN words (two: _prefix counts on it) find them, below it variants; lines of a small bucket.
MARKS, FULL, LONG_WORDS, RUN, FEW = 64, 15, 2 * MIN_WORDS, 2, 16
#: Finer marks of lines in large buckets, a power of two, and the count at which they end; lines of a file of them.
FINE, FINE_FULL, FINE_LINES = 512, 3, 1 << 18
#: Places in a large bucket from which on, turn by turn, earlier lines are tried by marks; and at which of those that marks allow a line's words are compared anew if it is still open.
TURNS, TRIED = (1, 9, 65), (1, 8, 64)
#: One document in LOOKED tells the common runs, which COMMON of its lines are known by; bits of a word's hash in files, where words of lines are compared.
LOOKED, COMMON, WORD_BITS = 16, 3, 48
#: Kinds of keys that are dealt; bytes of text, keys and rows of buckets handled at once, a larger bucket alone; different lines for each file of lines that go; places of lines dealt at once.
LINES, HALVES, RUNS = 0, 1, 2
SLICE, SENT, BUCKET_ROWS, GONE_LINES, HELD_LINES = 1 << 19, 1 << 19, 1 << 17, 1 << 18, 1 << 17
#: Bands in which distances are sought, by kind and number of the numbers that hold a column; longer lines are compared one by one.
BANDS, BAND_WORDS = ((np.uint16, 1), (np.uint32, 1), (np.uint64, 1), (np.uint64, 2), (np.uint64, 4)), 600
_U = np.uint64
_FRONT, _BACK, _PLACE, _SHORT = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between newlines, and where each row's lines begin; every row has one at least."""
    breaks = np.flatnonzero(buf == 10)
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(per, out=at[1:])
    starts, ends = np.empty(int(at[-1]), np.int64), np.empty(int(at[-1]), np.int64)
    head, tail = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    head[at[:-1]], tail[at[1:] - 1] = True, True
    starts[head], starts[~head] = offsets[:-1], breaks + 1
    ends[tail], ends[~tail] = offsets[1:], breaks
    return starts, ends, at


def _word_spans(space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, which rows set apart, too."""
    edge = np.ones(len(space) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    word = ~space[at[:-1]]
    return at[:-1][word], at[1:][word]


class Sequences:
    """Hashes of any runs of a sequence of words, from one running polynomial."""

    def __init__(self, words: np.ndarray):
        if len(K._powers[0]) <= len(words):
            K.span_hashes(np.zeros(len(words) + 1, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))  # extends the powers
        self.power, self.inverse = K._powers
        self.run = np.zeros(len(words) + 1, _U)
        np.cumsum(words * self.power[: len(words)], out=self.run[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial of the words from start to end, the first with power 0."""
        return (self.run[end] - self.run[start]) * self.inverse[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return K.mix(self.raw(start, end) + (end - start).astype(_U) * _PLACE)


def line_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Sequences, np.ndarray, np.ndarray]:
    """Lines' starts, ends, row bounds, first and last word, the sequences of the words, the lines' hashes (0: no word) and the words' lengths."""
    starts, ends, at = line_spans(buf, offsets)
    # A-Z to a-z; white space is a space and tab to carriage return
    small = buf | ((buf - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    spans, stops = _word_spans((buf == 32) | (buf - np.uint8(9) < 5), offsets)
    words = K.span_hashes(small, spans, stops)
    first, last = np.searchsorted(spans, starts), np.searchsorted(spans, ends)
    seq = Sequences(words)
    h = np.where(last > first, seq(first, last), _U(0))
    return starts, ends, at, first, last, seq, h, stops - spans


def half_keys(seq: Sequences, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Four keys for each line: of its first and last half words, as the shorter and as the longer of two lines."""
    out = []
    for less in (0, 1):
        short = np.maximum(last - first - less, 0)
        half, tag = short // 2, short.astype(_U) * _PLACE
        out += [K.mix(seq(first, first + half) ^ (tag + _FRONT)), K.mix(seq(last - half, last) ^ (tag + _BACK))]
    return np.stack(out, axis=1)


def variants(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a line's deletion variants and their kinds: 0 with the place, 1 as the longer line, 2 the line as the shorter."""
    n = len(words)
    seq = Sequences(words)
    k, zero, end = np.arange(n), np.zeros(n, np.int64), np.full(n, n)
    # the words after the one left out move one power down
    without = seq.raw(zero, k) + np.where(k + 1 < n, seq.raw(np.minimum(k + 1, n), end), _U(0)) * seq.power[k]
    whole = K.mix(seq.raw(np.zeros(1, np.int64), np.full(1, n)) + np.full(1, n, _U) * _PLACE) ^ _SHORT
    if n < MIN_WORDS:
        return whole, np.full(1, 2, np.int8)
    v = K.mix(without + np.full(n, n - 1, _U) * _PLACE)
    return np.concatenate([K.mix(v + (k.astype(_U) + _U(1)) * _FRONT), v ^ _SHORT, whole]), np.repeat(np.array([0, 1, 2], np.int8), [n, n, 1])


def distance(a: list[int], b: list[int]) -> int:
    """Edit distance of two word sequences, one column of the table at a time in the bits of whole numbers (Myers, Hyyro)."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, out = full, 0, len(a)
    for w in b:
        equal = at.get(w, 0)
        level = equal | down
        across = ((equal & up) + up ^ up) | equal
        more, less = down | full & ~(across | up), up & across
        out += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | full & ~(level | more), more & level
    return out


def within_edits(a: np.ndarray, b: np.ndarray, most: int = 1) -> bool:
    """Whether two word sequences are within ``most`` edits."""
    n = min(len(a), len(b))
    if max(len(a), len(b)) - n > most:
        return False
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n -= head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    return max(len(a), len(b)) <= most or distance(a, b) <= most


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences are within an edit for each MIN_WORDS words of the longer."""
    return within_edits(a, b, max(len(a), len(b)) // MIN_WORDS)


def _keys(frame: DataFrame, bits: int, common=None) -> DataFrame:
    """Blocks by key, of the lines' hashes with their documents, and, given a filter of common runs, of half keys and known runs with their lines' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict[str, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                columns = blocks.joined(parts)
                order = np.argsort(columns["key"])
                columns = {k: v[order] for k, v in columns.items()}
                yield blocks.dealt((kind << bits) + blocks.shard_of(columns["key"], bits), columns)
            held.clear()

        for batch in batches:
            buf, offsets = K.buffers(batch.column(1))
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in K.slices(offsets, SLICE):
                parsed = line_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                _, _, at, first, last, seq, h, _ = parsed
                row = np.repeat(np.arange(b - a), np.diff(at))
                real = np.flatnonzero(h != 0)
                pick = real[np.unique(h[real] ^ K.mix(row[real].astype(_U) + _U(1)), return_index=True)[1]]
                new = {LINES: {"key": h[pick], "doc": docs[a + row[pick]]}}
                if common is not None:
                    short = pick[(last[pick] - first[pick] >= MIN_WORDS - 1) & (last[pick] - first[pick] < LONG_WORDS)]
                    new[HALVES] = {"key": half_keys(seq, first[short], last[short]).reshape(-1), "h": np.repeat(h[short], 4)}
                    x = _known_runs(parsed, common.value)
                    new[RUNS] = {"key": x["key"], "h": x["h"][x["owner"]]}
                for kind, columns in new.items():
                    held.setdefault(kind, []).append(columns)
                    size += len(columns["key"])
                if size >= SENT:
                    yield from flush()
                    size = 0
        yield from flush()

    return frame.mapInArrow(run, blocks.SCHEMA).repartitionById(1 << bits, F.col("shard").bitwiseAND((1 << bits) - 1))


def _common_runs(frame: DataFrame, bits: int) -> np.ndarray:
    """Filter of the runs that several lines of some documents are known by: these come last in the order of runs, which decides
    speed only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.buffers(batch.column(1))
            for a, b in K.slices(offsets, SLICE):
                x = _known_runs(line_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                order = np.argsort(x["key"])
                yield blocks.dealt(blocks.shard_of(x["key"][order], bits), {"key": x["key"][order], "h": x["h"][x["owner"][order]]})

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in blocks.gathered(batches).values():
            x = blocks.joined(parts)
            order = np.lexsort((x["h"], x["key"]))
            key, h = x["key"][order], x["h"][order]
            key = key[np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])]] if len(key) else key
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            key = key[at[np.diff(at, append=len(key)) >= COMMON]]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    some = frame.filter(F.pmod(F.xxhash64("doc"), F.lit(LOOKED)) == 0)
    found = written(some.mapInArrow(run, blocks.SCHEMA).repartitionById(1 << bits, F.col("shard")).mapInArrow(often, "key long"), "common")
    out = bloom.build(found, "key")
    dropped(found)
    return out


def _met(dealt: DataFrame, bits: int) -> DataFrame:
    """Blocks of what lines share: hashes that several documents have, with the first of these; lines with a half key in
    common; and the buckets of known runs, each run with its lines, for runs of two lines and more. n: different lines of a
    block of the first kind, lines of one of the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said(shard: int, columns: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack_arrays(columns)], pa.binary()), pa.array([n])], ["shard", "block", "n"])

        found = blocks.gathered(batches)
        for shard in list(found):
            x = blocks.joined(found.pop(shard))
            if not len(x["key"]):
                continue
            order = np.argsort(x["key"])
            key, of = x["key"][order], x["doc" if "doc" in x else "h"][order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            low = np.minimum.reduceat(of, at)
            several = low < np.maximum.reduceat(of, at)
            if shard >> bits == LINES:
                yield said(shard, {"h": key[at[several]], "low": low[several]}, len(at))
                continue
            mask = np.repeat(several, np.diff(at, append=len(key)))
            key, of = key[mask], of[mask]
            if shard >> bits == HALVES:
                lines = np.unique(of)
                yield said(shard, {"h": lines}, len(lines))
                continue
            at = np.append(np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)) if len(key) else np.zeros(1, np.int64)
            for a, b in K.slices(at, BUCKET_ROWS):
                yield said(shard, {"key": key[at[a] : at[b]], "h": of[at[a] : at[b]]}, 0)

    return dealt.mapInArrow(run, blocks.SCHEMA + ", n long")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The different lines of each block, as keys of a filter."""
    for batch in batches:
        for parts in blocks.gathered([batch]).values():
            for x in parts:
                yield {"key": np.unique(x["h"])}


def _members(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's bucket begins and how many rows it has, of rows in the order of their buckets."""
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
    return start, np.bincount(start, minlength=len(start))[start]


def _write_lines(frame: DataFrame, short, cuts: tuple[str, int, set[int]], folder: str, bits: int) -> DataFrame:
    """Writes the words of the long lines to a file for each task, and their places, sizes, marks and where their words lie to files by hash; gives blocks of the short lines wanted with their places and words. Each line comes from its earliest place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, name, end = Gone(*cuts), uuid.uuid4().int >> 64, 0
        held: list[list[dict[str, np.ndarray]]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                if parts:
                    columns = blocks.joined(parts)
                    order = np.argsort(columns["h"])
                    yield blocks.dealt((kind << bits) + blocks.shard_of(columns["h"][order], bits), {k: v[order] for k, v in columns.items()})
                    parts.clear()

        with open_shared(f"{folder}/{name:016x}") as out:
            for batch in batches:
                buf, offsets = K.buffers(batch.column(1))
                docs = batch.column(0).to_numpy(zero_copy_only=False)
                for a, b in K.slices(offsets, SLICE):
                    _, _, at, first, last, seq, h, _ = line_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    row = np.repeat(np.arange(b - a), np.diff(at))
                    real = np.flatnonzero(last - first >= MIN_WORDS - 1)
                    real = real[~gone.goes(h[real], docs[a + row[real]])]
                    # what is left of a line lies in one document
                    pick = real[np.unique(h[real], return_index=True)[1]]
                    size, words = last - first, np.diff(seq.run) * seq.inverse[: len(seq.run) - 1]
                    x = {"words": words, "first": first, "size": size}
                    place = {"h": h[pick], "doc": docs[a + row[pick]], "line": (pick - at[row[pick]]).astype(np.int32), "n": np.minimum(size[pick], 1 << 30).astype(np.int32)}
                    some = np.flatnonzero(size[pick] >= LONG_WORDS - LONG_WORDS // MIN_WORDS)
                    long = pick[some]
                    starts = end + np.cumsum(size[long]) - size[long]
                    end += int(size[long].sum())
                    out.write(_packed_words(words[K.ragged_positions(first[long], size[long])]))
                    held[0].append({k: v[some] for k, v in place.items()} | {"marks": _marks(x, long), "file": np.full(len(long), name, _U), "at": starts})
                    some = np.flatnonzero(size[pick] < LONG_WORDS)
                    some = some[bloom.may_hold(short.value, h[pick[some]])]
                    padded = np.zeros((len(some), LONG_WORDS), _U)
                    for k in range(LONG_WORDS - 1):
                        has = size[pick[some]] > k
                        padded[has, k] = words[first[pick[some[has]]] + k]
                    held[1].append({k: v[some] for k, v in place.items()} | {"words": padded})
                    if sum(len(part["h"]) for part in held[0]) + sum(len(part["h"]) for part in held[1]) >= HELD_LINES:
                        yield from flush()
            yield from flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in sorted(blocks.gathered(batches).items()):
            x = blocks.joined(parts)
            order = np.lexsort((x["line"], x["doc"], x["h"]))
            h = x["h"][order]
            order = order[np.r_[True, h[1:] != h[:-1]]] if len(h) else order
            x = {k: v[order] for k, v in x.items()}
            if shard >> bits:
                yield blocks.dealt(np.zeros(len(order), np.int64), x)
            else:
                write_shared(f"{folder}/{shard:06d}", pack_arrays(x))

    return frame.mapInArrow(run, blocks.SCHEMA).repartitionById(1 << bits, F.col("shard").bitwiseAND((1 << bits) - 1)).mapInArrow(write, blocks.SCHEMA)


def _packed_words(words: np.ndarray) -> bytes:
    """Words for a file, WORD_BITS of each."""
    return np.ascontiguousarray(words.astype("<u8").view("<u2").reshape(-1, 4)[:, : WORD_BITS // 16]).tobytes()


def _short_lines(rows: DataFrame) -> DataFrame:
    """Hash, key, line number and words of lines in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in blocks.gathered([batch]).values():
                for x in parts:
                    n = x["n"].astype(np.int64)
                    words = K.binary_array(x["words"].reshape(-1).view(np.uint8), np.arange(len(n)) * LONG_WORDS * 8, n * 8)
                    yield pa.RecordBatch.from_arrays([pa.array(x["h"].view(np.int64)), pa.array(x["doc"]), pa.array(x["line"]), words], ["h", "doc", "line", "words"])

    return rows.mapInArrow(run, "h long, doc long, line int, words binary")


def _variant_rows(lines: DataFrame, filter_words=None) -> DataFrame:
    """key and h of each variant; with a filter only of keys that may be shared, with kind, key and line number."""
    schema = "key long, h long" + (", kind byte, doc long, line int" if filter_words else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, sizes = [], [], []
            for w in batch.column(3):
                key, kind = variants(np.frombuffer(w.as_buffer(), _U))
                keys.append(key)
                kinds.append(kind)
                sizes.append(len(key))
            if not keys:
                continue
            key, kind, owner = np.concatenate(keys), np.concatenate(kinds), np.repeat(np.arange(len(sizes)), sizes)
            if filter_words is None:
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(owner))], ["key", "h"])
            else:
                hit = bloom.may_hold(filter_words.value, key)
                of = pa.array(owner[hit])
                yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), batch.column(0).take(of), pa.array(kind[hit]), batch.column(1).take(of), batch.column(2).take(of)], ["key", "h", "kind", "doc", "line"])

    return lines.mapInArrow(run, schema)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that two different lines have."""
    return rows.groupBy(key).agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select(key)


def near_lines(found: DataFrame) -> DataFrame:
    """Hashes of short lines (h, doc, line, words), each once, that an earlier one is within the bound of."""
    sc = found.sparkSession.sparkContext
    equal = sc.broadcast(bloom.build(_shared(_variant_rows(found), "key"), "key"))
    rows = written(_variant_rows(found, equal), "variants")
    place = F.struct("doc", "line", "h")
    heads = rows.groupBy("key").agg(F.min(F.when(F.col("kind") != 1, place)).alias("a"), F.min(F.when(F.col("kind") == 1, place)).alias("b"))
    met = rows.join(heads, "key").withColumn("w", F.when(F.col("kind") == 2, F.col("b")).otherwise(F.col("a")))
    pairs = met.filter(F.col("w") < place).select("h", F.col("w.h").alias("by")).filter("h <> by").distinct()
    return _verified(pairs, found.select("h", "words"))


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Each h of ``pairs`` (h, by) that is within the bound of one of its ``by``, once."""
    both = pairs.join(words, "h").join(words.select(F.col("h").alias("by"), F.col("words").alias("by_words")), "by").select("h", "words", "by_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [near(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)) for x, y in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["h"]).filter(pa.array(held, pa.bool_()))

    return both.mapInArrow(verify, "h long").distinct()


def _known_runs(parsed: tuple, common: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Hashes of the lines that shared runs can find, each kind once in the slice; and the line and hash of each run by which a line is known. parsed: what :func:`line_hashes` gives; common: a filter of the runs that come last."""
    _, _, _, first, last, seq, h, width = parsed
    # the shorter of two lines may lack a fifth of the longer one's words
    real = np.flatnonzero(last - first >= LONG_WORDS - LONG_WORDS // MIN_WORDS)
    pick = real[np.unique(h[real], return_index=True)[1]]
    size, first = last[pick] - first[pick], first[pick]
    start = K.ragged_positions(first, size - RUN + 1)
    owner = np.repeat(np.arange(len(pick)), size - RUN + 1)
    runs = seq(start, start + RUN)
    # one order for all lines: common runs last, long words first, which are the rarer ones, then by hash
    length = np.minimum(width[start] + width[np.minimum(start + 1, len(width) - 1)], 63) if len(start) else start
    late = (63 - length).astype(_U)
    if common is not None:
        late |= bloom.may_hold(common, runs).astype(_U) << _U(6)
    if len(pick) < 1 << 19:
        order = np.argsort((owner.astype(_U) << _U(45)) | (late << _U(38)) | (runs >> _U(26)))
    else:
        order = np.lexsort((runs >> _U(26), late, owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(size - RUN + 1) - (size - RUN + 1), size - RUN + 1)
    rank = np.empty(len(order), np.int64)
    rank[order] = place
    # a line of n words has near ones of up to 5n/4 words, n/4 edits away
    known = order[place < _prefix(rank, owner, size // (MIN_WORDS - 1))[owner]] if len(order) else order
    key, of = runs[known], owner[known]
    known = known[np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])]] if len(known) else known
    return {"h": h[pick], "owner": owner[known], "key": runs[known]}


def _prefix(rank: np.ndarray, owner: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """How many runs of each line, by rank, it takes to hold more runs without a word in common than the line's edits."""
    low, high = edits + 1, RUN * edits + 1
    some = np.flatnonzero(rank < high[owner])
    rank, owner = rank[some].astype(np.int32), owner[some].astype(np.int32)
    index = some + owner  # runs of two lines never lie side by side
    while (low < high).any():
        middle = ((low + high) // 2).astype(np.int32)
        held = np.flatnonzero(rank < middle[owner])
        at = index[held]
        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1]) if len(at) else at
        # of runs side by side every second lies apart
        apart = (np.diff(begins, append=len(at)) + 1) // RUN
        enough = np.bincount(owner[held[begins]], weights=apart, minlength=len(edits)) > edits
        low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
    return high


def _marks(x: dict[str, np.ndarray], pick: np.ndarray) -> np.ndarray:
    """How many words of each line fall to each mark, half a byte each."""
    size = x["size"][pick]
    spot = np.repeat(np.arange(len(pick)), size) * MARKS + (x["words"][K.ragged_positions(x["first"][pick], size)] & _U(MARKS - 1)).astype(np.int64)
    count = np.minimum(np.bincount(spot, minlength=len(pick) * MARKS), FULL).astype(np.uint8).reshape(-1, MARKS)
    return count[:, : MARKS // 2] | count[:, MARKS // 2 :] << 4


def _apart(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.maximum(u, v) - np.minimum(u, v)


def _byte_sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows of small numbers, of which any eight in a row come to less than 256; rows are multiples of eight long."""
    return ((np.ascontiguousarray(x).view(_U) * _U(0x0101010101010101)) >> _U(56)).sum(1).astype(np.int64)


def _may_be_near(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and marks allow lines i and j to be near; one of them is long."""
    out, sums = [], _byte_sums(x["marks"] & FULL) + _byte_sums(x["marks"] >> 4)
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        longer = np.maximum(x["n"][p], x["n"][q])
        most = longer // MIN_WORDS
        fits = np.flatnonzero((longer >= LONG_WORDS) & (longer - np.minimum(x["n"][p], x["n"][q]) <= most))
        a, b = x["marks"][p[fits]], x["marks"][q[fits]]
        # an edit takes one word from its mark, gives one to another, or both; counts cut at FULL differ by less, if at all
        apart = _byte_sums(_apart(a & FULL, b & FULL) + _apart(a >> 4, b >> 4))
        held = np.zeros(len(p), bool)
        held[fits[apart + np.abs(sums[p[fits]] - sums[q[fits]]) <= 2 * most[fits]]] = True
        out.append(held)
    return np.concatenate([*out, np.empty(0, bool)])


def _fine_marks(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many words of each line fall to each finer mark, two bits each."""
    out = np.empty((len(first), FINE // 4), np.uint8)
    for k in range(0, len(first), 1 << 11):
        n = size[k : k + (1 << 11)]
        # the bits that MARKS does not use
        spot = np.repeat(np.arange(len(n)), n) * FINE + ((words[K.ragged_positions(first[k : k + (1 << 11)], n)] >> _U(32)) & _U(FINE - 1)).astype(np.int64)
        count = np.minimum(np.bincount(spot, minlength=len(n) * FINE), FINE_FULL).astype(np.uint8).reshape(len(n), 4, FINE // 4)
        out[k : k + (1 << 11)] = count[:, 0] | count[:, 1] << 2 | count[:, 2] << 4 | count[:, 3] << 6
    return out


class LineFiles:
    """A worker's mapped files of long lines, by hash."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.files, self.texts = folder, bits, {}, {}

    def rows(self, h: np.ndarray, *names: str) -> dict[str, np.ndarray]:
        """The columns named of lines that the files hold."""
        out: dict[str, np.ndarray] = {}
        shards = blocks.shard_of(h, self.bits)
        for k in np.unique(shards).tolist():
            if k not in self.files:
                self.files[k] = map_shared(f"{self.folder}/{k:06d}")
            some = np.flatnonzero(shards == k)
            at = np.searchsorted(self.files[k]["h"], h[some])
            for name in names:
                column = self.files[k][name]
                if name not in out:
                    out[name] = np.empty((len(h), *column.shape[1:]), column.dtype)
                out[name][some] = column[at]
        return out


    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of lines, where each line's begin, and their numbers."""
        if not len(h):
            return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
        x = self.rows(h, "file", "at", "n")
        size = x["n"].astype(np.int64)
        first = np.cumsum(size) - size
        out = np.zeros((int(size.sum()), 4), "<u2")
        for name in np.unique(x["file"]).tolist():
            if name not in self.texts:
                self.texts[name] = view_shared(f"{self.folder}/{name:016x}")
            some = np.flatnonzero(x["file"] == _U(name))
            stored = self.texts[name].view("<u2").reshape(-1, WORD_BITS // 16)
            out[K.ragged_positions(first[some], size[some]), : WORD_BITS // 16] = stored[K.ragged_positions(x["at"][some], size[some])]
        return out.view("<u8").reshape(-1).astype(_U, copy=False), first, size


class FineMarks(LineFiles):
    """Finer marks of lines, from the words in the files."""

    def _rows(self, h: np.ndarray) -> np.ndarray:
        return _fine_marks(*self.words(h))

    def may_be_near(self, x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the finer marks, too, allow lines i and j to be near."""
        out = np.empty(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            lines, back = np.unique(np.concatenate([x["h"][p], x["h"][q]]), return_inverse=True)
            rows = self._rows(lines)
            a, b = back[: len(p)], back[len(p) :]
            layers = [rows >> s & FINE_FULL for s in (0, 2, 4, 6)]
            sums, apart = sum(_byte_sums(layer) for layer in layers), 0
            for layer in layers:
                apart = apart + _apart(layer[a], layer[b])
            out[k : k + (1 << 16)] = _byte_sums(apart) + np.abs(sums[a] - sums[b]) <= 2 * (np.maximum(x["n"][p], x["n"][q]) // MIN_WORDS)
        return out


def _in_buckets(x: dict[str, np.ndarray], files: LineFiles) -> dict[str, np.ndarray]:
    """Rows of buckets with size and marks, each line once in a bucket, the earliest first."""
    lines, back = np.unique(x["h"], return_inverse=True)
    found = files.rows(lines, "doc", "line", "n", "marks")
    rank = np.empty(len(lines), np.int64)
    rank[np.lexsort((found["line"], found["doc"]))] = np.arange(len(lines))
    at = np.cumsum(np.r_[False, x["key"][1:] != x["key"][:-1]]) << 32 | rank[back]
    order = np.argsort(at)
    at = at[order]
    pick = order[np.r_[True, at[1:] != at[:-1]]]
    return {k: v[pick] for k, v in x.items()} | {k: found[k][back[pick]] for k in ("n", "marks")}


def near_pairs(words: np.ndarray, first: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`near` of lines i and j, many pairs at once. words: less than 2**62 each; first, size: where a line's words begin, and how many they are."""
    a, b = np.where(size[i] >= size[j], i, j), np.where(size[i] >= size[j], j, i)
    most = size[a] // MIN_WORDS
    out, open_ = np.zeros(len(i), bool), size[a] - size[b] <= most
    # narrow bands first: most pairs that are near are so by far
    for kind, limbs in BANDS:
        widest = np.iinfo(kind).bits * limbs // 2 - 1
        # the band must not be wider than a line is long
        some = np.flatnonzero(open_ & (size[a] > widest) & (size[a] <= BAND_WORDS) & (size[a] - size[b] <= widest))
        some = some[np.argsort(-size[b[some]], kind="stable")]
        for at in range(0, len(some), 1 << 13):
            part = some[at : at + (1 << 13)]
            if len(part) < FEW * (limbs - 1):
                continue  # not worth a band's steps
            found = _band_distances(words, first[a[part]], size[a[part]], first[b[part]], size[b[part]], widest, kind, limbs)
            out[part] = found <= np.minimum(most[part], widest)
            open_[part] = (found > widest) & (most[part] > widest)
    for k in np.flatnonzero(open_).tolist():
        out[k] = near(words[first[a[k]] : first[a[k]] + size[a[k]]], words[first[b[k]] : first[b[k]] + size[b[k]]])
    return out


def _band_distances(words: np.ndarray, first: np.ndarray, m: np.ndarray, other: np.ndarray, n: np.ndarray, most: int, kind: type, limbs: int) -> np.ndarray:
    """Edit distances of lines of m words and shorter ones of n, the longest n first, exact up to ``most``: a column of the table's
    band at a time, in the bits of some numbers for each pair (Hyyro)."""
    bits = np.iinfo(kind).bits
    width, begins = bits * limbs, np.cumsum(n) - n
    before = width - most - 1
    one, top, pad = kind(1), kind(bits - 1), (_U(1) << _U(62), _U(1) << _U(63))
    equal = np.empty((limbs, int(n.sum())), kind)
    at = 0
    while at < len(m):
        columns = int(n[at])
        p = slice(at, at + max(1, (1 << 21) // (columns * width)))
        at = p.stop
        k = np.arange(columns + most)
        x = np.full((len(m[p]), before + columns + most), pad[0])
        x[:, before:] = np.where(k < m[p, None], words[np.minimum(first[p, None] + k, len(words) - 1)], pad[0])
        k = k[:columns]
        y = np.where(k < n[p, None], words[np.minimum(other[p, None] + k, len(words) - 1)], pad[1])
        met = np.packbits(np.lib.stride_tricks.sliding_window_view(x, width, axis=1) == y[:, :, None], axis=2, bitorder="little").view(kind)
        equal[:, begins[p.start] : begins[p.start] + int(n[p].sum())] = met[k < n[p, None]].T
    ones = (1 << width) - (1 << before)
    up = np.repeat(np.array([[ones >> bits * k & (1 << bits) - 1] for k in range(limbs)], kind), len(m), axis=1)
    down, out, corner = np.zeros_like(up), np.full(len(m), most, kind), m - most
    active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")  # pairs with more columns than each
    for t, k in enumerate(active.tolist()):
        e, u, d = equal[:, begins[:k] + t], up[:, :k], down[:, :k]
        low = e & u
        sums = low + u
        for c in range(1, limbs):
            sums[c] += _carry(low[c - 1], u[c - 1], sums[c - 1])
        level = (sums ^ u) | e | d
        more, less = d | ~(level | u), level & u
        # along the band's lower edge first, then along the last row
        past = t - corner[:k]
        spot = (width - 2) - np.maximum(past, 0)
        if limbs == 1:
            spot = spot.astype(kind)
            edge = ((more[0] >> spot) & one) - ((less[0] >> spot) & one)
        else:
            index, spot = (spot // bits, np.arange(k)), (spot % bits).astype(kind)
            edge = ((more[index] >> spot) & one) - ((less[index] >> spot) & one)
        out[:k] += np.where(past < 0, one - (level[-1] >> top), edge)
        right = level >> one
        if limbs > 1:
            right[:-1] |= level[1:] << top
        up[:, :k], down[:, :k] = less | ~(right | more), right & more
    return out.astype(np.int64)


def _carry(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What a sum of two numbers, and of what was carried to it, carries on."""
    return ((a & b) | ((a | b) & ~total)) >> total.dtype.type(total.dtype.itemsize * 8 - 1)


def _near_ones(h: np.ndarray, by: np.ndarray, files: LineFiles) -> np.ndarray:
    """Those of ``h`` that are within the bound of one of their ``by``; of each h, pairs given more often are tried first, until one is."""
    _, once, times = np.unique(K.mix(h) ^ by, return_index=True, return_counts=True)
    once = once[np.lexsort((once, -times, h[once]))]
    h, by = h[once], by[once]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    rank = np.arange(len(h)) - np.flatnonzero(new)[group]
    found = np.zeros(int(new.sum()), bool)
    for low, high in zip((0, *TRIED), (*TRIED, len(h) + 1)):
        some = np.flatnonzero((rank >= low) & (rank < high) & ~found[group])
        for at in range(0, len(some), 1 << 14):
            part = some[at : at + (1 << 14)]
            lines, back = np.unique(np.concatenate([h[part], by[part]]), return_inverse=True)
            held = near_pairs(*files.words(lines), back[: len(part)], back[len(part) :])
            found[group[part[held]]] = True
    return h[new][found]


def near_long_lines(buckets: DataFrame, files: tuple[str, int], near_bits: int, bits: int) -> DataFrame:
    """Blocks for :func:`_write_gone` of the lines that an earlier line is within the bound of, where the longer has LONG_WORDS or more."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a line and an earlier one of its small bucket, or the earliest one of its large bucket, that marks allow, as
        shards below 0; lines of large buckets, the earliest first, as a shard 0."""
        known = LineFiles(*files)
        for batch in batches:
            for part in (p for parts in blocks.gathered([batch]).values() for p in parts):
                x = _in_buckets(part, known)
                start, members = _members(x["key"])
                at = np.arange(len(start))
                # all earlier lines of a small bucket, the earliest one of a large
                others = np.where(members <= FEW, at - start, np.minimum(at - start, 1))
                out = []
                for a, b in K.slices(np.concatenate([[0], np.cumsum(others)])):
                    i, j = np.repeat(at[a:b], others[a:b]), K.ragged_positions(start[a:b], others[a:b])
                    fits = _may_be_near(x, i, j)
                    out.append(np.stack([i[fits], j[fits]]))
                i, j = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
                h, by = x["h"][i], x["h"][j]
                once = np.unique(K.mix(h) ^ by, return_index=True)[1]
                once = once[np.argsort(h[once])]
                yield blocks.dealt(blocks.shard_of(h[once], bits) - (1 << bits), {"h": h[once], "by": by[once]})
                large = members > FEW
                if large.any():
                    yield blocks.dealt(np.zeros(int(large.sum()), np.int64), {k: x[k][large] for k in ("key", "h")})

    rows = written(buckets.mapInArrow(tried, blocks.SCHEMA), "runs")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LineFiles(*files)
        for parts in blocks.gathered(batches).values():
            x = blocks.joined(parts)
            yield _near_block(_near_ones(x["h"], x["by"], known), near_bits)

    pairs = rows.filter("shard < 0").repartitionById(1 << bits, F.col("shard") + (1 << bits))
    near = written(pairs.mapInArrow(verified, blocks.SCHEMA), "near-early")
    spark = buckets.sparkSession
    folder = shared_dir(spark, "near-first")
    first = folder, near_bits, _write_gone(near, folder, near_bits)

    def earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Open lines of large buckets that are near to a later one than the earliest there."""
        finer, gone = FineMarks(*files), Gone(*first)
        for x in _gathered_rows(batches):
            start, _ = _members(x["key"])
            place = np.arange(len(start)) - start
            at = np.flatnonzero(place > 1)
            at = at[~gone.goes(x["h"][at], np.zeros(len(at), np.int64))]
            if not len(at):
                continue
            lines, back = np.unique(x["h"], return_inverse=True)
            x = x | {k: v[back] for k, v in finer.rows(lines, "n", "marks").items()}
            for begin, end in zip(TURNS, (*TURNS[1:], None)):
                at = at[place[at] > begin]
                others = (place[at] if end is None else np.minimum(place[at], end)) - begin
                near = [np.empty(0, _U)]
                for a, b in K.slices(np.concatenate([[0], np.cumsum(others)])):
                    i, j = np.repeat(at[a:b], others[a:b]), K.ragged_positions(start[at[a:b]] + begin, others[a:b])
                    fits = np.flatnonzero(_may_be_near(x, i, j))
                    i, j = i[fits], j[fits]
                    once = np.sort(np.unique(K.mix(x["h"][i]) ^ x["h"][j], return_index=True)[1])
                    i, j = i[once], j[once]
                    fits = finer.may_be_near(x, i, j)
                    near.append(_near_ones(x["h"][i[fits]], x["h"][j[fits]], finer))
                found = np.unique(np.concatenate(near))
                yield _near_block(found, near_bits)
                at = at[~np.isin(x["h"][at], found)]

    out = written(near.union(rows.filter("shard = 0").mapInArrow(earlier, blocks.SCHEMA)), "near-long")
    removed(spark, folder)
    dropped(rows, near)
    return out


def _gathered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of several blocks at once, BUCKET_ROWS or more but for the last."""
    held, size = [], 0
    for batch in batches:
        for x in (p for parts in blocks.gathered([batch]).values() for p in parts):
            held.append(x)
            size += len(x["key"])
            if size >= BUCKET_ROWS:
                yield blocks.joined(held)
                held, size = [], 0
    if held:
        yield blocks.joined(held)


def _near_block(h: np.ndarray, bits: int) -> pa.RecordBatch:
    """Near lines for :func:`_write_gone`."""
    h = np.unique(h)
    return blocks.dealt(blocks.shard_of(h, bits), {"h": h, "low": np.zeros(len(h), np.int64), "near": np.ones(len(h), np.uint8)})


def _write_gone(rows: DataFrame, folder: str, bits: int) -> set[int]:
    """Writes the hashes of lines that go to files, from blocks by these files: with the first document that has the line, whose
    own one stays, or as near ones, that go everywhere; gives the files there are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in blocks.gathered(batches).items():
            x = blocks.joined(parts)
            order = np.argsort(x["h"], kind="stable")
            h = x["h"][order]
            order = order[np.r_[True, h[1:] != h[:-1]]] if len(h) else order
            if len(order):
                write_shared(f"{folder}/{shard:06d}", pack_arrays({k: v[order] for k, v in x.items()}))
                yield pa.RecordBatch.from_arrays([pa.array([shard])], ["shard"])

    with released(rows.sparkSession):
        return {r["shard"] for r in rows.repartitionById(1 << bits, F.col("shard")).mapInArrow(write, "shard long").collect()}


class Gone(LineFiles):
    """A worker's mapped files of lines that go."""

    def __init__(self, folder: str, bits: int, there: set[int]):
        super().__init__(folder, bits)
        self.there = there

    def goes(self, h: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether each line of a document goes for an earlier one."""
        out = np.zeros(len(h), bool)
        shards = blocks.shard_of(h, self.bits)
        for k in self.there.intersection(np.unique(shards).tolist()):
            if k not in self.files:
                self.files[k] = map_shared(f"{self.folder}/{k:06d}")
            x, some = self.files[k], np.flatnonzero(shards == k)
            at = np.minimum(np.searchsorted(x["h"], h[some]), len(x["h"]) - 1)
            out[some] = (x["h"][at] == h[some]) & ((x["near"][at] == 1) | (docs[some] > x["low"][at]))
        return out


def _near(frame: DataFrame, met: DataFrame, bits: int, n: int, cuts: tuple[str, int, set[int]]) -> DataFrame:
    """Blocks for :func:`_write_gone` of the lines that an earlier line is within the bound of. n: the number of different lines; cuts: files of the lines that several documents have."""
    spark, near_bits = frame.sparkSession, cuts[1]
    halves, buckets = (met.filter(F.shiftright("shard", bits) == kind).select("shard", "block", "n") for kind in (HALVES, RUNS))
    some = halves.agg(F.sum("n")).first()[0] or 0
    short = spark.sparkContext.broadcast(bloom.build_from(halves.select("shard", "block"), _hashes, some))
    files = shared_dir(spark, "long-lines"), min((n // FINE_LINES).bit_length(), 14)
    lines = written(_write_lines(frame, short, cuts, *files), "short-lines")
    short_lines = written(_short_lines(lines), "lines")
    dropped(lines)
    found = near_lines(short_lines)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _near_block(batch.column(0).to_numpy().view(_U), near_bits)

    out = written(found.mapInArrow(packed, blocks.SCHEMA), "near-short").union(near_long_lines(buckets.select("shard", "block"), files, near_bits, bits))
    removed(spark, files[0])
    dropped(short_lines)
    return out


def _cuts(seen: DataFrame, bits: int) -> DataFrame:
    """Blocks for :func:`_write_gone` of the lines that several documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in blocks.gathered([batch]).values():
                for x in parts:
                    yield blocks.dealt(blocks.shard_of(x["h"], bits), x | {"near": np.zeros(len(x["h"]), np.uint8)})

    return seen.mapInArrow(run, blocks.SCHEMA)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", near: bool = True) -> DataFrame:
    """``docs`` with ``text`` without the lines that go, and n_lines and n_removed after the other columns."""
    docs = docs.drop("n_lines", "n_removed")
    frame = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    bits = max(0, (count_slices(spark) - 1).bit_length())
    common = spark.sparkContext.broadcast(_common_runs(frame, bits)) if near else None
    met = written(_met(_keys(frame, bits, common), bits), "met")
    seen = met.filter(F.shiftright("shard", bits) == LINES)
    n = seen.agg(F.sum("n")).first()[0] or 0
    file_bits = min((n // GONE_LINES).bit_length(), 14)

    def files_of(rows: DataFrame, name: str) -> tuple[str, int, set[int]]:
        folder = shared_dir(spark, name)
        return folder, file_bits, _write_gone(rows, folder, file_bits)

    files = [files_of(_cuts(seen.select("shard", "block"), file_bits), "gone")]
    if near:
        files.append(files_of(_near(frame, met, bits, n, files[0]), "near"))
    dropped(met)
    names = docs.columns
    joined = docs.select(*names, F.col(key).cast("long").alias("__doc"))
    schema = extended(docs.schema, "n_lines int, n_removed int")
    k, t = names.index(key), names.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = [Gone(*x) for x in files]
        for batch in batches:
            buf, offsets = K.buffers(batch.column(t))
            for a, b in K.slices(offsets, SLICE):
                part = batch.slice(a, b - a)
                body, rel = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, at, _, _, _, h, _ = line_hashes(body, rel)
                row = np.repeat(np.arange(b - a), np.diff(at))
                keep = np.zeros(len(h), bool)
                keep[np.unique(h ^ K.mix(row.astype(_U) + _U(1)), return_index=True)[1]] = True
                of = pc.fill_null(part.column(len(names)), 0).to_numpy(zero_copy_only=False)[row]
                for x in gone:
                    keep &= ~x.goes(h, of)
                keep |= h == 0
                keep |= ~part.column(k).is_valid().to_numpy(zero_copy_only=False)[row]
                # a kept line brings its newline unless it is the last of its row that is kept
                index = np.flatnonzero(keep)
                last = np.ones(len(index), bool)
                last[:-1] = row[index[1:]] != row[index[:-1]]
                extent = np.diff(starts, append=len(body))
                held = np.repeat(keep, extent)
                cut = index[last & (ends[index] < starts[index] + extent[index])]
                held[ends[cut]] = False
                out = body if keep.all() else body[held]
                per = np.bincount(row[index], weights=np.where(last, ends[index] - starts[index], extent[index]), minlength=b - a).astype(np.int64)
                texts = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.py_buffer(out)])
                old = part.column(t)
                if old.null_count:
                    texts = pc.if_else(old.is_valid(), texts, pa.scalar(None, pa.string()))
                n = np.diff(at)
                columns = [part.column(i) for i in range(len(names))]
                columns[t] = texts
                kept = np.bincount(row[index], minlength=b - a)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int32)), pa.array((n - kept).astype(np.int32))], schema.names)

    return joined.mapInArrow(rewrite, schema)
