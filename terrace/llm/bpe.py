"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The frequent words of a corpus, counted in Spark, are compiled into one automaton whose equal suffixes are shared; the
outputs along a word's path add up to its row in a table of token ids. Workers map the automaton's file and walk it for
all words of a slice at once. Words outside the lexicon are merged exactly, by rank, so the lexicon decides speed only.

Defined cases: a null or empty text has no ids, and its decoded text is empty. Repeated rows give repeated results. The
strings of special tokens in a text become their ids, as the vocabulary's own library has it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import textkernels as K
from terrace.llm.arrayfile import map_arrays, pack_arrays
from terrace.llm.shared import dropped, extended, ship_file, written

#: Words that the lexicon holds at most (some megabytes on each executor), and the count below which a word is left out.
MAX_WORDS, MIN_COUNT = 1 << 17, 3
#: Words longer than this many bytes are always merged.
MAX_WORD_BYTES = 64
_LETTER, _NUMBER, _SPACE = 1, 2, 3


# --- vocabulary -------------------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Pieces, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        self.pieces: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for text, k in ids.items():
            self.pieces[k] = bytes(letters[c] for c in text) if text not in self.special else text.encode()
        for text, k in self.special.items():
            self.pieces[k] = text.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)


class Merger:
    """Exact merging of one word: the adjacent pair of lowest rank first."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        self.byte_ids = byte_ids.tolist()
        self.ranked = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges.tolist())}

    def __call__(self, word: bytes) -> list[int]:
        ids, ranked = [self.byte_ids[b] for b in word], self.ranked
        if len(ids) > 200:
            return self._long(ids)
        while len(ids) > 1:
            best = min((hit for pair in zip(ids, ids[1:]) if (hit := ranked.get(pair))), default=None)
            if best is None:
                break
            new = best[1]
            out, k, last = [], 0, len(ids) - 1
            while k <= last:
                if k < last and ranked.get((ids[k], ids[k + 1])) == best:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words so long that scanning all pairs again for each merge would be slow."""
        import heapq

        ranked, n = self.ranked, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(hit[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (hit := ranked.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if not gone[k] else -1
            if j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], gone[j], after[k] = ranked[a, b][1], True, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (hit := ranked.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (hit[0], left, ids[left], ids[right]))
        return [x for x, dead in zip(ids, gone) if not dead]


class PairTable:
    """The merges as an open-addressed hash table, for merging many words side by side."""

    def __init__(self, merges: np.ndarray):
        self.bits = max(4, int(4 * len(merges) + 1).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.new = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        keys, rank = (merges[:, 0] << 32) | merges[:, 1], np.arange(len(merges))
        slot = self._slot(keys)
        while len(keys):
            _, pick = np.unique(slot, return_index=True)
            pick = pick[self.keys[slot[pick]] < 0]
            self.keys[slot[pick]], self.rank[slot[pick]], self.new[slot[pick]] = keys[pick], rank[pick], merges[rank[pick], 2]
            left = np.ones(len(keys), bool)
            left[pick] = False
            keys, rank, slot = keys[left], rank[left], (slot[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    NONE = 1 << 40

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NONE where there is no merge."""
        keys = (a.astype(np.int64) << 32) | b
        slot = self._slot(keys)
        held = self.keys[slot]
        again = np.flatnonzero((held != keys) & (held >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[again]]
            again = again[(held != keys[again]) & (held >= 0)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.rank[slot], self.NONE), self.new[slot]

    def merge(self, byte_ids: np.ndarray, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. In each round each word merges its first pair of lowest rank."""
        n, width = len(starts), int(lengths.max())
        inside = np.arange(width)[None, :] < lengths[:, None]
        ids = np.where(inside, byte_ids[buf[np.minimum(starts[:, None] + np.arange(width)[None, :], len(buf) - 1)]], -1)
        rank, new = np.full((n, width), self.NONE, np.int64), np.zeros((n, width), np.int64)
        if width > 1:
            r, c = np.nonzero(inside[:, 1:])
            rank[r, c], new[r, c] = self.look(ids[r, c], ids[r, c + 1])
        done_ids, done_size, done_row = [], [], []
        row, size = np.arange(n), lengths.astype(np.int64).copy()
        while len(row):
            best = rank.argmin(1)
            every = np.arange(len(row))
            live = rank[every, best] < self.NONE
            if not live.all():
                stop = ~live
                done_ids.append(ids[stop][np.arange(width)[None, :] < size[stop][:, None]])
                done_size.append(size[stop])
                done_row.append(row[stop])
                ids, rank, new, row, size, best = ids[live], rank[live], new[live], row[live], size[live], best[live]
                if not len(row):
                    break
                every = np.arange(len(row))
            made = new[every, best]
            source = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
            source[:, -1] = np.minimum(source[:, -1], width - 1)
            ids, rank, new = (np.take_along_axis(x, source, 1) for x in (ids, rank, new))
            size -= 1
            ids[every, best] = made
            spare = np.arange(width)[None, :] >= size[:, None] - 1
            rank[spare] = self.NONE
            for side in (-1, 0):
                k = best + side
                ok = (k >= 0) & (k + 1 < size)
                e, k = every[ok], k[ok]
                rank[e, k], new[e, k] = self.look(ids[e, k], ids[e, k + 1])
        sizes, rows, flat = np.concatenate(done_size), np.concatenate(done_row), np.concatenate(done_ids)
        at = np.cumsum(sizes) - sizes
        back = np.argsort(rows)
        return flat[K.ragged_positions(at[back], sizes[back])], sizes[back]


# --- the transducer ---------------------------------------------------------------------------------------------------


def compile_transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct ``words`` whose additive outputs number them in that order.

    Built incrementally: once the next word leaves a path, its states are replaced by equal ones that exist. States lie
    in a double array: the slot base[state] + byte holds the move if owner[slot] is the state.
    """
    finals: list[bool] = [False]
    moves: list[dict[int, int]] = [{}]
    known: dict[tuple, int] = {}
    path: list[int] = [0]

    def settle(depth: int, word: bytes) -> None:
        for k in range(len(path) - 1, depth, -1):
            state, parent, byte = path.pop(), path[-1], word[k - 1]
            kept = known.setdefault((finals[state], *moves[state].items()), state)
            if kept != state:
                moves[parent][byte] = kept

    last = b""
    for word in words:
        depth = 0
        for x, y in zip(last, word):
            if x != y:
                break
            depth += 1
        settle(depth, last)
        for b in word[depth:]:
            finals.append(False)
            moves.append({})
            moves[path[-1]][b] = len(finals) - 1
            path.append(len(finals) - 1)
        finals[path[-1]] = True
        last = word
    settle(0, last)

    order, seen, stack = [], {0}, [0]
    while stack:
        s = stack.pop()
        order.append(s)
        for t in moves[s].values():
            if t not in seen:
                seen.add(t)
                stack.append(t)
    number = {s: k for k, s in enumerate(order)}
    below: dict[int, int] = {}

    def count(s: int) -> int:
        if s not in below:
            below[s] = finals[s] + sum(count(t) for t in moves[s].values())
        return below[s]

    count(0)
    n = len(order)
    size = sum(len(moves[s]) for s in order) * 2 + 4096
    base, owner = np.zeros(n + 1, np.int32), np.full(size, -1, np.int32)
    target, output = np.zeros(size, np.int32), np.zeros(size, np.int32)
    free, hint = np.ones(size, bool), 0
    for s in sorted((s for s in order if len(moves[s]) > 1), key=lambda s: -len(moves[s])):
        bytes_ = np.array(sorted(moves[s]), np.int64)
        at, window = hint, 2048
        while True:
            if at + window + 512 > len(free):
                more = len(free)
                free = np.concatenate([free, np.ones(more, bool)])
                owner = np.concatenate([owner, np.full(more, -1, np.int32)])
                target, output = np.concatenate([target, np.zeros(more, np.int32)]), np.concatenate([output, np.zeros(more, np.int32)])
            fits = free[at + bytes_[0] : at + bytes_[0] + window].copy()
            for b in bytes_[1:]:
                fits &= free[at + b : at + b + window]
            if fits.any():
                at += int(fits.argmax())
                break
            at += window
        k = number[s]
        base[k] = at
        total = int(finals[s])
        for b in bytes_.tolist():
            t = moves[s][b]
            owner[at + b], target[at + b], output[at + b], free[at + b] = k, number[t], total, False
            total += below[t]
        while hint + 1024 < len(free) and not free[hint : hint + 1024].any():
            hint += 1024
    # a state with one move fits any free slot: these take the first ones together
    lone = [s for s in order if len(moves[s]) == 1]
    if len(lone):
        short = max(0, len(lone) + 512 - int(free[256:].sum()))
        free, owner = np.concatenate([free, np.ones(short, bool)]), np.concatenate([owner, np.full(short, -1, np.int32)])
        target, output = np.concatenate([target, np.zeros(short, np.int32)]), np.concatenate([output, np.zeros(short, np.int32)])
        slots, own = 256 + np.flatnonzero(free[256:])[: len(lone)], np.array([number[s] for s in lone], np.int32)
        (bytes_, to) = np.array([next(iter(moves[s].items())) for s in lone], np.int64).T
        base[own] = slots - bytes_
        owner[slots], target[slots], output[slots], free[slots] = own, [number[t] for t in to.tolist()], [int(finals[s]) for s in lone], False
    end = int(np.flatnonzero(~free).max(initial=0)) + 512
    base[n] = end - 256  # the dead state's slots belong to nobody
    out = {"base": base, "owner": owner[:end], "target": target[:end], "output": output[:end]}
    if len(out["owner"]) < end:
        pad = end - len(out["owner"])
        out |= {"owner": np.pad(out["owner"], (0, pad), constant_values=-1), "target": np.pad(out["target"], (0, pad)), "output": np.pad(out["output"], (0, pad))}
    return out | {"final": np.array([finals[s] for s in order] + [False]), "n_words": np.array([len(words)])}


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = np.where((np.arange(a, b + 1) >> 11) == 0x1B, 0, kind)
    return out


def compile_lexicon(vocabulary: Vocabulary, words: Iterable[bytes]) -> bytes:
    """File image of the transducer, its table of ids and the vocabulary."""
    words = sorted({w for w in words if 0 < len(w) <= MAX_WORD_BYTES})
    merge = Merger(vocabulary.byte_ids, vocabulary.merges)
    ids = [merge(w) for w in words]
    sizes = lambda xs: np.concatenate([[0], np.cumsum([len(x) for x in xs], dtype=np.int64)]).astype(np.int64)
    special = sorted(vocabulary.special.items())
    return pack_arrays(
        compile_transducer(words)
        | {
            "id_at": sizes(ids),
            "ids": np.array([x for row in ids for x in row], np.uint32),
            "piece_at": sizes(vocabulary.pieces),
            "pieces": np.frombuffer(b"".join(vocabulary.pieces), np.uint8),
            "byte_ids": vocabulary.byte_ids,
            "merges": vocabulary.merges,
            "classes": character_classes(),
            "special": np.frombuffer(json.dumps(special).encode(), np.uint8),
        }
    )


# --- splitting, encoding and decoding slices --------------------------------------------------------------------------


def split_words(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte starts of the words that the byte-level pattern splits the rows into; the words cover all bytes.

    The pattern takes an apostrophe with s, t, re, ve, m, ll or d; else a run of letters, of numbers or of other signs,
    each with one space before it; else white space, of which the last character is left to what follows.
    """
    if not len(buf):
        return np.empty(0, np.int64)
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = (buf & 0xC0) != 0x80
    byte_at = np.flatnonzero(lead)
    n = len(chars)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(byte_at, offsets)] = True
    edge[n] = True
    kind = classes[chars]
    begins = edge[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begins)
    stop = np.append(run[1:], n)
    what, first = kind[run], chars[run]
    space = what == _SPACE
    start = begins.copy()
    kept_back = space & (stop - run >= 2) & ~edge[stop]
    start[stop[kept_back] - 1] = True
    led = ~space & ~edge[run] & (chars[np.maximum(run - 1, 0)] == 32)
    start[run[led]] = False
    quote = np.flatnonzero((first[:-1] == 39) & (what[:-1] == 0) & (stop[:-1] - run[:-1] == 1) & ~led[:-1] & (what[1:] == _LETTER) & ~edge[run[1:]])
    if len(quote):
        at = run[quote] + 1
        room = stop[quote + 1] - at
        a, b = chars[at], chars[np.minimum(at + 1, n - 1)]
        two = (room >= 2) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        took = np.where(np.isin(a, (115, 116, 109, 100)), 1, np.where(two, 2, 0))
        hit = took > 0
        start[at[hit]] = False
        rest = hit & (room > took)
        start[at[rest] + took[rest]] = True
    return byte_at[start]


class Codec:
    """Encoder and decoder over a mapped lexicon."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.merge = Merger(arrays["byte_ids"], arrays["merges"])
        self.special = {s.encode(): k for s, k in json.loads(arrays["special"].tobytes())}
        self.table = PairTable(arrays["merges"])
        self.dead = len(arrays["final"]) - 1

    def rows_of_words(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The lexicon's row of each word, -1 for words that it lacks: all words walk the automaton together."""
        a, out = self.a, np.full(len(starts), -1, np.int64)
        short = np.minimum(lengths, MAX_WORD_BYTES + 1).astype(np.uint8)
        order = np.argsort(-short.astype(np.int16), kind="stable")
        order = order[np.searchsorted(-short[order].astype(np.int16), -MAX_WORD_BYTES) :]
        at, sizes = starts[order], short[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        live = np.searchsorted(-sizes.astype(np.int16), -np.arange(1, MAX_WORD_BYTES + 1), "right")
        for k in range(int(sizes[0]) if len(sizes) else 0):
            m = live[k]
            now = state[:m]
            slot = a["base"][now] + buf[at[:m] + k]
            ok = a["owner"][slot] == now
            state[:m] = np.where(ok, a["target"][slot], self.dead)
            total[:m] += a["output"][slot]
        out[order] = np.where(a["final"][state], total, -1)
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's ids begin."""
        a, whole, places, given = self.a, buf.tobytes(), offsets, {}
        if any(s in whole for s in self.special):
            given = self._special_spans(whole, offsets)
            places = np.unique(np.concatenate([offsets, np.array([p for s, (e, _) in given.items() for p in (s, e)], np.int64)]))
        starts = split_words(buf, places, a["classes"])
        if given:
            spans = np.array(sorted((s, e) for s, (e, _) in given.items()), np.int64).reshape(-1, 2)
            inside = np.searchsorted(spans[:, 0], starts, "right") - 1
            drop = (inside >= 0) & (starts < spans[np.maximum(inside, 0), 1]) & (starts > spans[np.maximum(inside, 0), 0])
            starts = starts[~drop]
        lengths = np.diff(np.append(starts, len(buf)))
        rows = self.rows_of_words(buf, starts, lengths)
        if given:
            rows[np.searchsorted(starts, spans[:, 0])] = -1
        table, at = a["ids"], np.where(rows >= 0, a["id_at"][rows], 0)
        size = np.where(rows >= 0, a["id_at"][rows + 1] - at, 0)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            extra, new_at, new_size = self._merge_all(buf, starts[missing], lengths[missing], given)
            at[missing], size[missing] = new_at + len(table), new_size
            table = np.concatenate([table, extra])
        ids = table[K.ragged_positions(at, size)]
        first = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=first[1:])
        return ids, first[np.searchsorted(starts, offsets)]

    def _merge_all(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, given: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words outside the lexicon, with place and number for each; each distinct word is merged once."""
        _, first, same = np.unique(K.span_hashes(buf, starts, starts + lengths), return_index=True, return_inverse=True)
        alone = np.zeros(len(starts), bool)
        differs = lengths != lengths[first[same]]
        even = np.flatnonzero(~differs)
        unlike = buf[K.ragged_positions(starts[even], lengths[even])] != buf[K.ragged_positions(starts[first[same[even]]], lengths[even])]
        if unlike.any():
            differs[even[np.unique(np.repeat(np.arange(len(even)), lengths[even])[unlike])]] = True
        alone[differs] = True
        if given:
            alone |= np.isin(starts, np.array(list(given), np.int64))
        words = np.concatenate([first, np.flatnonzero(alone)])
        to = same.copy()
        to[alone] = len(first) + np.arange(int(alone.sum()))
        ids, size = np.empty(0, np.int64), np.zeros(len(words), np.int64)
        at, parts = np.zeros(len(words), np.int64), []
        lens, whole = lengths[words], None
        special = np.isin(starts[words], np.array(list(given), np.int64)) if given else np.zeros(len(words), bool)
        total = 0
        for low, high in ((0, 6), (6, 10), (10, 16), (16, 32), (32, MAX_WORD_BYTES)):
            group = np.flatnonzero((lens > low) & (lens <= high) & ~special)
            if len(group):
                ids, n = self.table.merge(self.a["byte_ids"], buf, starts[words[group]], lens[group])
                at[group], size[group] = total + np.cumsum(n) - n, n
                parts.append(ids)
                total += len(ids)
        for k in np.flatnonzero((lens > MAX_WORD_BYTES) | special).tolist():
            whole = buf.tobytes() if whole is None else whole
            s = int(starts[words[k]])
            got = [given[s][1]] if special[k] else self.merge(whole[s : s + int(lens[k])])
            at[k], size[k] = total, len(got)
            parts.append(np.array(got, np.int64))
            total += len(got)
        return np.concatenate(parts).astype(np.uint32), at[to], size[to]

    def _special_spans(self, whole: bytes, offsets: np.ndarray) -> dict[int, tuple[int, int]]:
        """Start -> (end, id) of the special strings inside rows, leftmost and longest first."""
        import re

        pattern = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        out = {}
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            out |= {m.start(): (m.end(), self.special[m[0]]) for m in pattern.finditer(whole, a, b)}
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids' pieces, one after the other."""
        at = self.a["piece_at"]
        return self.a["pieces"][K.ragged_positions(at[ids], at[ids + 1] - at[ids])]

    def decoded_sizes(self, ids: np.ndarray) -> np.ndarray:
        at = self.a["piece_at"]
        return at[ids + 1] - at[ids]


_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """This worker's codec over the shipped file ``name``."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(map_arrays(SparkFiles.get(name)))
    return _codecs[name]


# --- Spark ------------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, text: str, classes_file: str) -> DataFrame:
    """word (binary) and its count over all texts; each task adds up its own words before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = map_arrays(SparkFiles.get(classes_file))["classes"]
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def merged() -> pa.RecordBatch:
            h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            words = pa.concat_arrays([x[2] for x in held])
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)
            held[:] = [(u, total, words.take(pa.array(first)))]
            return pa.RecordBatch.from_arrays([held[0][2], pa.array(total)], ["word", "n"])

        size = 0
        for batch in batches:
            buf, offsets = K.buffers(batch.column(0))
            for a, b in K.slices(offsets):
                part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts = split_words(part, at, classes)
                lengths = np.diff(np.append(starts, len(part)))
                keep = lengths <= MAX_WORD_BYTES
                starts, lengths = starts[keep], lengths[keep]
                if not len(starts):
                    continue
                u, first, n = np.unique(K.span_hashes(part, starts, starts + lengths), return_index=True, return_counts=True)
                held.append((u, n, K.binary_array(part, starts[first], lengths[first])))
                size += len(u)
                if size > 1_000_000:
                    merged()
                    size = len(held[0][0])
                    if size > 700_000:
                        yield merged()
                        held.clear()
                        size = 0
        if held:
            yield merged()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ship_lexicon(docs: DataFrame, vocabulary_path: str, text: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> str:
    """Compile the ``max_words`` most frequent words of ``docs`` and ship the file; returns its name for :func:`codec`."""
    spark = docs.sparkSession
    classes = ship_file(spark, "classes", pack_arrays({"classes": character_classes()}))
    counts = written(word_counts(docs, text, classes).filter(F.col("n") >= min_count), "words")
    # the words at or above the count that keeps them within max_words, found from a short histogram of counts
    step = F.floor(F.log2("n") * 32).cast("int")
    need, room = None, max_words
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # at most 32 * 64 rows
        if r["words"] > room:
            break
        need, room = r["step"], room - r["words"]
    words = [bytes(r[0]) for r in counts.filter(step >= need).select("word").collect()] if need is not None else []  # at most max_words
    dropped(counts)
    return ship_file(spark, "lexicon", compile_lexicon(Vocabulary(vocabulary_path), words))


def encode(docs: DataFrame, lexicon: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array column ``ids`` of token ids."""
    docs = docs.drop(ids)
    schema = extended(docs.schema, f"`{ids}` array<int>")
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(lexicon)
        for batch in batches:
            buf, offsets = K.buffers(batch.column(k))
            for a, b in K.slices(offsets):
                out, at = c.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, column], [*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, lexicon: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array column of ids; broken UTF-8 is replaced as in Python's ``errors="replace"``."""
    rows = rows.drop(text)
    schema = extended(rows.schema, f"`{text}` string")
    k = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(lexicon)
        for batch in batches:
            texts = [c.decode(np.asarray(x, np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(k).to_pylist() for x in [x or []]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (ids as little-endian unsigned 32 bits) and decoded_sha256 (UTF-8)."""
    frame = docs.select(key, F.col(text).cast("string").alias("text"))
    schema = extended(frame.select(key).schema, "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(lexicon)
        for batch in batches:
            buf, offsets = K.buffers(batch.column(1))
            for a, b in K.slices(offsets):
                ids, at = c.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.concatenate([[0], np.cumsum(c.decoded_sizes(ids))])[at]
                raw, text_ = memoryview(ids.astype("<u4").tobytes()), memoryview(c.decode(ids).tobytes())
                id_sums, text_sums = [], []
                for p, q, s, e in zip(at[:-1].tolist(), at[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                    id_sums.append(hashlib.sha256(raw[4 * p : 4 * q]).hexdigest())
                    body = text_[s:e]
                    try:
                        str(body, "utf-8")
                    except UnicodeDecodeError:
                        body = str(body, "utf-8", "replace").encode()
                    text_sums.append(hashlib.sha256(body).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(id_sums), pa.array(text_sums)], schema.names)

    return frame.mapInArrow(run, schema)
