"""Interpolated modified Kneser-Ney trigram model, counted in Spark and stored as sorted hash arrays.

Tokens are the lower-cased words of a text and one end; two begins stand before the first. All three orders are recursive:
trigrams u v w by their counts, pairs v w by how many words u precede them, words w by how many words v precede them, and
what each order's three discounts leave goes to the order below, at last to the uniform share. With ``every_context`` all
contexts have their trigram order. Without it a context u v that occurs once has none: there the pairs' order stands, and all
shares still add up to one.

Training is three passes of the same shape: tasks add up what their texts hold, deal it as packed blocks to shards by hash,
and each shard writes its sorted arrays. (1) Pairs, by first word: their hashes, which of them occur more than once, and, with
``every_context``, 32 bits of the one pair that follows each of the others: its trigram, count and context in one.
(2) Trigrams of contexts that do: their hashes with counts, and the contexts with totals; texts are read again and contexts
looked up in the mapped files of (1), in ROUNDS turns with a share of the contexts each. A trigram of a context that occurs
once is itself unique, so it goes straight into the count of (3). (3) Pairs' counts of words before them, with totals by
first word, in the order of (1), whose files stay. Scoring tasks map the files and look sorted batches of hashes up in them; nothing but file names and a row of
totals is sent to a worker, whatever the corpus.

A pair or trigram is dealt out only after its task has added it up, so that a frequent word brings one entry for each distinct
neighbour and task. There are as many shards as the training text has SHARD_BYTES, up to 2 ** HEAD, and at least as many as
the session's shuffles have. Contexts of trigrams are spread by a hash of both words; pairs lie with their first word, so the
largest shard of pairs grows with the words that follow the most frequent one, not with its occurrences.

Defined cases: a null or empty text is one end token; with no training text every token is unknown, of which base and
model know only the uniform share; repeated rows count as often as they occur; a null key is held out; texts of any length
are taken in slices of tokens. Hashes have 64 bits; words, pairs or trigrams that share one would be counted together. Of a
text held out, another word than the one known after a context seen once passes for it once in 2 ** 32 times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm import blocks
from terrace.llm import textkernels as K
from terrace.llm.arrayfile import map_shared, pack_arrays, write_shared
from terrace.llm.shared import count_slices, dropped, extended, released, shared_dir, written

_U = np.uint64
BEGIN, END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
#: Tokens that a task counts, and scores, at once.
COUNT_TOKENS, BATCH_TOKENS = 1 << 22, 1 << 20
#: Leading bits that a pair's hash takes from its first word, by which pairs are dealt to shards; training bytes of a shard.
HEAD, SHARD_BYTES = 16, 64 << 20
#: Passes in which the trigrams are counted, a share of the contexts in each: so much less of them lies in shuffle files at once.
ROUNDS = 2
ADD = 0.1
_STEP = _U(0x9E3779B97F4A7C15)


def held_out(key: Column) -> Column:
    """One document in ten, by the checksum of its key as text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def token_pairs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second of each pair, one for each word and end, and where each row's pairs begin."""
    words, rows = K.word_hashes(buf, offsets)
    n = len(offsets) - 1
    at = rows + np.arange(n + 1)
    second = np.empty(len(words) + n, _U)
    ends = at[1:] - 1
    is_end = np.zeros(len(second), bool)
    is_end[ends] = True
    second[is_end], second[~is_end] = END, words
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[at[:-1]] = BEGIN
    return first, second, at


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64 bits, HEAD of them the first word's own."""
    return ((first >> _U(64 - HEAD)) << _U(64 - HEAD)) | (K.mix(first * _STEP + second) >> _U(HEAD))


#: The context of a text's first word.
START = pair_hash(np.array([BEGIN]), np.array([BEGIN]))[0]


def contexts(pairs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Context of each token: the pair before its own, or START."""
    out = np.empty_like(pairs)
    out[1:] = pairs[:-1]
    out[starts] = START
    return out


def triple_hash(context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return K.mix(context * _STEP + pair)


def _added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, the place of one occurrence of each, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], order[at], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def _runs(x: np.ndarray, shards: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each shard's bounds in rows that are in its order, and where the runs of equal x in it begin."""
    cut = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else np.empty(0, np.int64)
    new = np.r_[True, x[1:] != x[:-1]] if len(x) else np.empty(0, bool)
    new[cut] = True
    for a, b in zip(cut, np.append(cut[1:], len(shards))):
        yield int(a), int(b), np.flatnonzero(new[a:b])


def _row(shard: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack_arrays(columns)], pa.binary())], ["shard", "block"])


def narrow(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, and those from 255 on apart with their places."""
    large = np.flatnonzero(x >= 255)
    return {name: np.minimum(x, 255).astype(np.uint8), f"{name}_at": large.astype(np.int64), f"{name}_large": x[large].astype(np.int64)}


def taken(held: dict[str, np.ndarray], name: str, spot: np.ndarray) -> np.ndarray:
    """The counts of :func:`narrow` at the places."""
    out = held[name][spot].astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = held[f"{name}_large"][np.searchsorted(held[f"{name}_at"], spot[large])]
    return out


def count_pairs(texts: DataFrame, bits: int, every_context: bool = False) -> DataFrame:
    """Blocks of (first, second, count) for each shard of first words, and what follows a pair that is alone in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            first, second = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            pair = pair_hash(first, second)
            _, at, (n,) = _added(pair, np.ones(len(first), np.int64))
            at = at[(order := np.argsort(first[at], kind="stable"))]
            first, second, n = first[at], second[at], n[order]
            after = pair[np.minimum(at + 1, len(pair) - 1)].astype(np.uint32)
            # each run of a first word is sent once
            for a, b, runs in _runs(first, shards := blocks.shard_of(first, bits)):
                own = {"after": after[a:b][n[a:b] == 1]} if every_context else {}
                yield _row(int(shards[a]), {"first": first[a:b][runs], "run": blocks.slim(np.diff(np.append(runs, b - a))), "second": second[a:b], "n": blocks.slim(n[a:b]), **own})

        size = 0
        for batch in batches:
            buf, offsets = K.buffers(batch.column(0))
            for a, b in K.slices(offsets):
                first, second, _ = token_pairs(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append((first, second))
                size += len(first)
                if size >= COUNT_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, blocks.SCHEMA)


def write_pairs(dealt: DataFrame, folder: str, bits: int, every_context: bool = False) -> DataFrame:
    """Writes each shard's pairs; gives blocks of (word, continuations, count) for the shards of second words, and totals:
    tokens, texts, and contexts that occur once, each with its one trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in blocks.gathered(batches).items():
            first = np.concatenate([np.repeat(x["first"], x["run"]) for x in parts])
            second = np.concatenate([x["second"] for x in parts])
            n = np.concatenate([x["n"].astype(np.int64) for x in parts])
            own = {}
            if every_context:
                after = np.zeros(len(n), np.uint32)
                after[n == 1] = np.concatenate([x["after"] for x in parts])
            keys, at, (n,) = _added(pair_hash(first, second), n)
            first, second = first[at], second[at]
            words, of = np.unique(first, return_inverse=True)
            many = n > 1
            if every_context:
                own = {"after": after[at[~many]], "rank": (np.cumsum(~many) - ~many)[::64]}
            packed = np.packbits(np.pad(many, (0, -len(many) % 64)))
            write_shared(f"{folder}/seen/{shard:06d}", pack_arrays({"pair": keys, "many": packed, "first": words, "single": np.bincount(of[~many], minlength=len(words)).astype(np.int64), "of": of[many].astype(np.uint32), **own}))
            after, _, (kinds, count) = _added(second, np.ones(len(second), np.int64), n)
            yield blocks.dealt(blocks.shard_of(after, bits), {"word": after, "kinds": blocks.slim(kinds), "n": blocks.slim(count)})
            yield _row(-1, {"totals": np.array([n.sum(), n[first == BEGIN].sum(), (~many & (second != END)).sum()], np.int64)})

    return dealt.mapInArrow(run, blocks.SCHEMA)


def write_words(dealt: DataFrame, folder: str) -> DataFrame:
    """Writes each shard of second words; gives one row of totals for each: words and continuation counts of 1 to 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in blocks.gathered(batches).items():
            words, _, (kinds, n) = _added(*(np.concatenate([x[k].astype(_U if k == "word" else np.int64) for x in parts]) for k in ("word", "kinds", "n")))
            write_shared(f"{folder}/words/{shard:06d}", pack_arrays({"word": words, **narrow("kinds", kinds), **narrow("n", n)}))
            totals = [len(words), int(kinds.sum()), *(int((kinds == r).sum()) for r in (1, 2, 3, 4))]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in totals], ["v", "kinds", "k1", "k2", "k3", "k4"])

    return dealt.mapInArrow(run, "v long, kinds long, k1 long, k2 long, k3 long, k4 long")


def _before(shards: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return blocks.dealt(shards, {"pair": pairs, "before": blocks.slim(n)})


def count_triples(texts: DataFrame, folder: str, bits: int, started: bool, turn: int) -> DataFrame:
    """Blocks of (context, pair, count) of contexts seen more than once, for each shard of contexts whose turn it is; and, in
    the first turn, for the shards of pairs after these, how many words precede a pair in contexts seen once."""
    shards_ = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, size = Files(folder, bits), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            pair, starts = np.concatenate([x[0] for x in held]), np.cumsum([0, *(len(x[0]) for x in held)])[:-1]
            starts = np.concatenate([x[1] + s for x, s in zip(held, starts)])
            held.clear()
            distinct, back = np.unique(pair, return_inverse=True)
            many_ = files.many(distinct)[back]
            context, many_before = contexts(pair, starts), np.empty(len(pair), bool)
            many_before[1:], many_before[starts] = many_[:-1], started
            if turn == 0:  # one unique trigram for each of the others
                alone, _, (n,) = _added(pair[~many_before & many_], np.ones(int((~many_before & many_).sum()), np.int64))
                if len(alone):
                    yield _before(blocks.shard_of(alone, bits) + shards_, alone, n)
            here = np.flatnonzero(many_before)
            here = here[blocks.shard_of(K.mix(context[here]), bits) % ROUNDS == turn]
            context, pair, many_ = context[here], pair[here], many_[here]
            _, at, (n,) = _added(triple_hash(context, pair), np.ones(len(pair), np.int64))
            spread = K.mix(context[at])
            order = np.argsort(spread, kind="stable")
            at, n, spread = at[order], n[order], spread[order]
            context, pair, flag = context[at], pair[at], many_[at]
            for a, b, runs in _runs(context, shards := blocks.shard_of(spread, bits)):
                # pairs that follow one context have their first word, and so the bits that are its own, in common
                own = pair[a:b]
                rest = {"head": (own[runs] >> _U(48)).astype(np.uint16), "middle": (own >> _U(32)).astype(np.uint16), "low": own.astype(np.uint32)}
                yield _row(int(shards[a]), {"context": context[a:b][runs], "run": blocks.slim(np.diff(np.append(runs, b - a))), **rest, "n": blocks.slim(2 * n[a:b] + flag[a:b])})

        for batch in batches:
            buf, offsets = K.buffers(batch.column(0))
            for a, b in K.slices(offsets):
                first, second, at = token_pairs(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append((pair_hash(first, second), at[:-1]))
                size += len(first)
                if size >= COUNT_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, blocks.SCHEMA)


def write_triples(dealt: DataFrame, folder: str, bits: int) -> DataFrame:
    """Writes each shard's trigrams and contexts; gives, for the shards of pairs, how many words precede a pair, in parts."""
    shards_ = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in blocks.gathered(batches).items():
            if shard >= shards_:
                pairs, _, (n,) = _added(np.concatenate([x["pair"] for x in parts]), np.concatenate([x["before"].astype(np.int64) for x in parts]))
                yield _before(np.full(len(pairs), shard - shards_), pairs, n)
                continue
            context = np.concatenate([np.repeat(x["context"], x["run"]) for x in parts])
            pair = np.concatenate([np.repeat(x["head"].astype(_U), x["run"]) << _U(48) | x["middle"].astype(_U) << _U(32) | x["low"] for x in parts])
            n = np.concatenate([x["n"].astype(np.int64) for x in parts])
            keys, at, (n, flag) = _added(triple_hash(context, pair), n >> 1, n & 1)
            context, pair = context[at], pair[at]
            seen, _, stats = _added(context, n, n == 1, n == 2, n >= 3)
            columns = {"triple": keys, **narrow("n", n), "context": seen}
            for name, x in zip(("total", "one", "two", "more"), stats):
                columns |= narrow(name, x.astype(np.int64))
            write_shared(f"{folder}/triples/{shard:06d}", pack_arrays(columns))
            yield _row(-1, {"totals": np.array([(n == r).sum() for r in (1, 2, 3, 4)], np.int64)})
            pairs, _, (n,) = _added(pair[flag > 0], np.ones(int((flag > 0).sum()), np.int64))
            if len(pairs):
                yield _before(blocks.shard_of(pairs, bits), pairs, n)

    return dealt.mapInArrow(run, blocks.SCHEMA)


def write_before(dealt: DataFrame, folder: str) -> DataFrame:
    """Writes the counts of words before each shard's pairs, in the order of its file of pairs, and totals by first word; gives
    counts of 1 to 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in blocks.gathered(batches).items():
            try:
                held = map_shared(f"{folder}/seen/{shard:06d}")
            except FileNotFoundError:  # no first word fell into this shard
                continue
            pairs, _, (n,) = _added(np.concatenate([x["pair"] for x in parts]), np.concatenate([x["before"].astype(np.int64) for x in parts]))
            many = np.flatnonzero(np.unpackbits(held["many"], count=len(held["pair"])))
            k = np.ones(len(held["pair"]), np.int64)  # what occurs once has one word before it
            k[many] = n[np.searchsorted(pairs, held["pair"][many])] if len(many) else 1
            of, size = held["of"].astype(np.int64), len(held["first"])
            columns = narrow("k", k)
            for name, hit in (("total", k[many]), ("one", k[many] == 1), ("two", k[many] == 2), ("more", k[many] >= 3)):
                columns |= narrow(name, np.bincount(of, weights=hit, minlength=size).astype(np.int64) + (held["single"] if name in ("total", "one") else 0))
            write_shared(f"{folder}/pairs/{shard:06d}", pack_arrays(columns))
            yield pa.RecordBatch.from_arrays([pa.array([int((k == r).sum())]) for r in (1, 2, 3, 4)], ["n1", "n2", "n3", "n4"])

    return dealt.mapInArrow(run, "n1 long, n2 long, n3 long, n4 long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts of counts 1, 2 and more, kept within 0 and the count."""
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return min(max(d1, 0.1), 0.95), min(max(d2, 0.1), 1.95), min(max(d3, 0.1), 2.95)


@dataclass(frozen=True)
class Model:
    """Where the shards lie, and what holds for all of them."""

    folder: str
    bits: int
    tokens: int
    words: int
    kinds: int
    triple_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_left: float  # the share that discounting leaves to the uniform distribution
    every_context: bool  # whether contexts that occur once have a trigram order


def _totals(made: DataFrame, n: int) -> list[int]:
    found = made.filter("shard < 0").select("block").collect()  # one row of a few numbers for each shard
    return np.sum([blocks.unpack_arrays(memoryview(r[0]))["totals"] for r in found], axis=0).tolist() if found else [0] * n


def train(texts: DataFrame, text: str = "text", every_context: bool = False) -> Model:
    """Count ``texts`` and write the model into the shared folder."""
    spark = texts.sparkSession
    own = texts.select(F.col(text).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder, bits = shared_dir(spark, "kneser-ney"), min(max(0, (max(count_slices(spark), size // SHARD_BYTES) - 1).bit_length()), HEAD)
    shards = 1 << bits
    by_shard = lambda df, n=shards: df.repartitionById(n, F.col("shard"))
    made = written(write_pairs(by_shard(count_pairs(own, bits, every_context)), folder, bits, every_context), "words")
    n, rows, alone = _totals(made, 3)
    with released(spark):
        v, kinds, *k = (x or 0 for x in write_words(by_shard(made.filter("shard >= 0")), folder).groupBy().sum().collect()[0])
    dropped(made)
    before = [written(write_triples(by_shard(count_triples(own, folder, bits, rows > 1 or every_context, turn), 2 * shards), folder, bits), "before") for turn in range(ROUNDS)]
    made = reduce(DataFrame.unionByName, before)
    triples = _totals(made, 4)
    triples[0] += alone if every_context else 0
    # every shard of pairs is finished, also one without a pair that occurs twice
    none = bytearray(pack_arrays({"pair": np.empty(0, _U), "before": np.empty(0, np.int64)}))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(none).alias("block"))
    with released(spark):
        pairs = [x or 0 for x in write_before(by_shard(made.filter("shard >= 0").unionByName(every)), folder).groupBy().sum().collect()[0]]
    dropped(*before)
    low = discounts(*k)
    left = (low[0] * k[0] + low[1] * k[1] + low[2] * (v - k[0] - k[1])) / kinds if kinds else 1.0
    return Model(folder, bits, n, v, kinds, discounts(*triples), discounts(*pairs), low, left, every_context)


def _many(held: dict[str, np.ndarray], spot: np.ndarray) -> np.ndarray:
    return (held["many"][spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1


class Files:
    """A worker's mapped shards."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.files = folder, bits, {}

    def shard(self, kind: str, k: int) -> dict[str, np.ndarray] | None:
        if (kind, k) not in self.files:
            try:
                self.files[kind, k] = map_shared(f"{self.folder}/{kind}/{k:06d}")
                if kind == "pairs":  # counts are in the order of the keys
                    self.files[kind, k] |= map_shared(f"{self.folder}/seen/{k:06d}")
            except FileNotFoundError:  # nothing fell into this shard
                self.files[kind, k] = None
        return self.files[kind, k]

    def _spots(self, kind: str, key: str, keys: np.ndarray, spread: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        """Each shard that is asked for, with the places in ``keys`` of those that it has and where it has them; ``spread``
        tells the shard, and keys that share one are best in order."""
        shards = blocks.shard_of(spread, self.bits)
        order = np.argsort(shards, kind="stable")
        at = np.flatnonzero(np.r_[True, shards[order][1:] != shards[order][:-1]]) if len(shards) else np.empty(0, np.int64)
        for a, b in zip(at, np.append(at[1:], len(shards))):
            some = order[a:b]
            held = self.shard(kind, int(shards[some[0]]))
            if held is None or not len(held[key]):
                continue
            spot = np.minimum(np.searchsorted(held[key], keys[some]), len(held[key]) - 1)
            hit = held[key][spot] == keys[some]
            yield held, some[hit], spot[hit]

    def find(self, kind: str, key: str, keys: np.ndarray, spread: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """The columns' counts at each key, 0 where the key is unknown."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        for held, some, spot in self._spots(kind, key, keys, spread):
            for o, c in zip(out, columns):
                o[some] = taken(held, c, spot)
        return out

    def many(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair occurs more than once."""
        out = np.zeros(len(pairs), bool)
        for held, some, spot in self._spots("seen", "pair", pairs, pairs):
            out[some] = _many(held, spot)
        return out

    def alone(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair occurs once, and the bits of the pair that follows it then."""
        out, after = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.uint32)
        for held, some, spot in self._spots("pairs", "pair", pairs, pairs):
            once = ~_many(held, spot)
            some, spot = some[once], spot[once]
            # pairs before it that occur once: those before its word of 64 bits, and the bits in front of its own
            inside = spot & 63
            word = held["many"].view(">u8")[spot >> 6].astype(_U)
            place = held["rank"][spot >> 6] + inside - np.bitwise_count(word >> _U(1) >> (63 - inside).astype(_U))
            out[some], after[some] = True, held["after"][place]
        return out, after


STATS = ("total", "one", "two", "more")


def _share(c: np.ndarray, stats: list[np.ndarray], d: tuple[float, float, float], low: np.ndarray) -> np.ndarray:
    """Discounted share of the count, and the lower order's by what its context's discounts leave."""
    total, one, two, more = stats
    seen = np.maximum(total, 1)
    left = np.where(total > 0, (d[0] * one + d[1] * two + d[2] * more) / seen, 1.0)
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0) / seen + left * low


class Lookup(Files):
    """The shards of a model."""

    def __init__(self, model: Model):
        super().__init__(model.folder, model.bits)
        self.m = model

    def score(self, first: np.ndarray, second: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its training count, base log10 probability and model log10 probability."""
        m = self.m
        words, back = np.unique(np.concatenate([second, [BEGIN]]), return_inverse=True)
        n, kinds = self.find("words", "word", words, words, ("n", "kinds"))
        base = np.log10((n + ADD) / (m.tokens + ADD * (m.words + 1)))
        low = np.maximum(kinds - np.array([0.0, *m.word_discounts])[np.minimum(kinds, 3)], 0) / max(m.kinds, 1) + m.word_left / (m.words + 1)
        stats = self.find("pairs", "first", words, words, STATS)
        pair = pair_hash(first, second)
        pairs, pair_back = np.unique(pair, return_inverse=True)
        (k,) = self.find("pairs", "pair", pairs, pairs, ("k",))
        w, v = back[:-1], np.searchsorted(words, first)
        two = _share(k[pair_back], [x[v] for x in stats], m.pair_discounts, low[w])
        context = contexts(pair, starts)
        seen, of = np.unique(context, return_inverse=True)
        stats = [x[of] for x in self.find("triples", "context", seen, K.mix(seen), STATS)]
        known = np.flatnonzero(stats[0] > 0)
        triple, at, back = np.unique(triple_hash(context[known], pair[known]), return_index=True, return_inverse=True)
        (c,) = self.find("triples", "triple", triple, K.mix(context[known][at]), ("n",))
        c_all = np.zeros(len(pair), np.int64)
        c_all[known] = c[back]
        if m.every_context:
            alone, after = self.alone(pairs)
            once = np.zeros(len(pair), bool)
            once[1:] = alone[pair_back[:-1]]
            once[starts] = False
            once = np.flatnonzero(once)
            stats[0][once] = stats[1][once] = 1  # total and one
            c_all[once] = after[pair_back[once - 1]] == pair[once].astype(np.uint32)
        return n[w], base[w], np.log10(_share(c_all, stats, m.triple_discounts, two))


_lookups: dict[str, Lookup] = {}


def lookup(model: Model) -> Lookup:
    if model.folder not in _lookups:
        _lookups.clear()
        _lookups[model.folder] = Lookup(model)
    return _lookups[model.folder]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    frame = docs.select(key, held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    schema = extended(frame.drop("text").schema, "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            first, second = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            counts = np.concatenate([np.diff(x[3]) for x in held])
            at = np.cumsum(counts) - counts
            n, base, own = lookup(model).score(first, second, at)
            known, base, own = (np.add.reduceat(x, at) for x in ((n > 0).astype(np.int64), base, own))
            head = pa.Table.from_batches([x[0] for x in held]).combine_chunks().to_batches()[0]
            held.clear()
            return pa.RecordBatch.from_arrays([*head.columns, pa.array(counts), pa.array(known), pa.array(np.full(len(counts), model.tokens)), pa.array(base), pa.array(own), pa.array(10.0 ** (-own / counts))], schema.names)

        for batch in batches:
            buf, offsets = K.buffers(batch.column(2))
            head = batch.select([0, 1])
            for a, b in K.slices(offsets):
                first, second, at = token_pairs(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append((head.slice(a, b - a), first, second, at))
                size += len(first)
                if size >= BATCH_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return frame.mapInArrow(run, schema)


def train_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text", every_context: bool = False) -> DataFrame:
    """A model of the rows that aren't held out, and all rows' scores."""
    return score(docs, train(docs.filter(~held_out(F.col(key))), text, every_context), key, text)
