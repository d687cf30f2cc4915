"""Near-duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures, bands, exact verification.

A text is the multiset of its runs of five lower-cased words; a shingle's weight is its count. For each shingle, Poisson
processes run over the weight ranges (0, 1], (1, 2], (2, 4], (4, 8] and so on. Each point has a time, a register and, within its
range, a cell found by halving; it counts if the cell lies below the weight. A register keeps its earliest time. Two
texts agree on a register with their weighted Jaccard similarity as probability, and points after the time by which all
registers are filled are never made.

Texts that share a band of registers are candidates. Equal texts are one node, named by a 64-bit hash of the text. In a
bucket, all members are first held against one of them, then, where the bucket still has several components, against
another one of its own: work that is linear in the members and does for groups of copies and near copies. What then lies
in different components is compared within the bucket's blocks, signature by signature: pairs go on that agree on as many
of the registers, and of a longer signature, as all but some one in a hundred thousand do at the similarity asked for; each
goes on from the first band it shares. So the classes are told without multiplying out a group of near copies: they are the
components of all links, found by a spanning part of them. All links are verified on the whole multisets.

``all_links`` compares the members of one component in the same way and counts each text's links, which takes work that is
quadratic in the members of a group of near copies, in tasks of bounded size.

Defined cases: a null text is empty; empty texts are copies of each other; a text of one to four words is one shingle;
rows with a null key are alone in their class; ties of keys go to the smallest, then to the smallest hash of the text;
unlike texts under one key are documents of their own, whose classes, if the key names both, differ in ``class_hash``;
keys are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import textkernels as K
from terrace.llm.components import components
from terrace.llm.shared import dropped, extended, written

WIDTH, SIMILARITY = 5, 0.8
#: Registers of a band, the share of pairs of the similarity asked for whose bands may all differ, and registers of the longer signature.
ROWS, MISSED, LONG = 5, 5e-5, 1000
#: Members of a block of a bucket, and points of Poisson processes made at once.
BLOCK, POINTS = 1024, 1 << 18
_U = np.uint64
_TICKS = float(1 << 32)
_STEP, _RANGE = _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7)


def bands_for(similarity: float) -> int:
    """Bands by which all but MISSED pairs of the similarity share one."""
    return math.ceil(math.log(MISSED) / math.log1p(-(similarity**ROWS))) if similarity < 1 else 1


def agreeing(registers: int, similarity: float) -> int:
    """Registers that pairs of the similarity agree on at least, but for some one in a hundred thousand: 4.5 standard deviations below the mean."""
    return max(math.floor(registers * similarity - 4.5 * math.sqrt(registers * similarity * (1 - similarity))), 1)


def weighted_shingles(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle hash and weight of each row's distinct shingles."""
    words, rows = K.word_hashes(buf, offsets)
    h, bounds = K.shingle_hashes(words, rows, width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    _, first, weight = np.unique(h ^ K.mix(row.astype(_U) + _U(1)), return_index=True, return_counts=True)
    return row[first], h[first], weight


def _points(seed: np.ndarray, k: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Waiting time (of rate 1, in whole ticks, so that sums are exact in any order), register bits and cell bits of each process's k-th point."""
    x = K.mix(seed + np.asarray(k, np.int64).astype(_U) * _STEP)
    wait = (-np.log(((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) * _TICKS).astype(np.int64)
    y = K.mix(x ^ _STEP)
    return wait, y >> _U(32), y & _U(0xFFFFFFFF)


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """Earliest time of each register for each row; rows without shingles keep infinity."""
    out = np.full((n_rows, size), np.inf)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    top = np.floor(np.log2(np.maximum(weight, 1))).astype(np.int64)
    ranges = top + 1 + ((1 << top) < weight)
    element = np.repeat(np.arange(len(row)), ranges)
    j = K.ragged_positions(np.zeros(len(row), np.int64), ranges)
    low = np.where(j == 0, 0, 1 << np.maximum(j - 1, 0))
    wide = np.maximum(low, 1)
    seed = K.mix(h[element] + j.astype(_U) * _RANGE)
    rate, cells, owner = wide.astype(float), np.minimum(weight[element] - low, wide), row[element]
    pending = np.flatnonzero(total > 0)
    horizon = np.zeros(n_rows)
    horizon[pending] = size * (np.log(size) + 4) / total[pending]
    while len(pending):
        chosen = np.zeros(n_rows, bool)
        chosen[pending] = True
        e = np.flatnonzero(chosen[owner])
        mean = horizon[owner[e]] * rate[e]
        for some in (e[mean <= 16], e[mean > 16]):
            if not len(some):
                continue
            if len(e) and horizon[owner[some[0]]] * rate[some[0]] > 16:
                # few processes with many points each: all points of a process at once, of some processes at a time
                expect = horizon[owner[some]] * rate[some]
                n = (expect + 6 * np.sqrt(expect) + 10).astype(np.int64)
                for a, b in K.slices(np.concatenate([[0], np.cumsum(n)]), POINTS):
                    p, few = np.repeat(some[a:b], n[a:b]), n[a:b]
                    wait, register, cell = _points(seed[p], K.ragged_positions(np.zeros(b - a, np.int64), few))
                    run = np.cumsum(wait)
                    first = np.cumsum(few) - few
                    t = run - np.repeat(np.where(first > 0, run[first - 1], 0), few)
                    _keep(out, owner[p], register, cell, t / (_TICKS * rate[p]), horizon, cells[p], wide[p], size)
                continue
            # many processes with few points each: the next point of every process that is not past its row's horizon
            ticks, k = np.zeros(len(some), np.int64), 0
            while len(some):
                wait, register, cell = _points(seed[some], k)
                ticks = ticks + wait
                t = ticks / (_TICKS * rate[some])
                near = t <= horizon[owner[some]]
                some, t, ticks = some[near], t[near], ticks[near]
                _keep(out, owner[some], register[near], cell[near], t, horizon, cells[some], wide[some], size)
                k += 1
        pending = pending[~np.isfinite(out[pending]).all(1)]
        horizon[pending] *= 2
    return out


def _keep(out: np.ndarray, row: np.ndarray, register: np.ndarray, cell: np.ndarray, t: np.ndarray, horizon: np.ndarray, cells: np.ndarray, wide: np.ndarray, size: int) -> None:
    inside = (t <= horizon[row]) & (((cell * wide.astype(_U)) >> _U(32)).astype(np.int64) < cells)
    register = ((register * _U(size)) >> _U(32)).astype(np.int64)
    np.minimum.at(out.reshape(-1), (row * size + register)[inside], t[inside])


def band_hashes(times: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = times.shape[1] // rows
    bits = times.astype(np.float32).view(np.uint32).astype(_U).reshape(len(times), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(times), bands))
    for k in range(rows):
        h = K.mix(h * _STEP + bits[:, :, k])
    return h.view(np.int64)


def _nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, node (the hash of the text) and text of every row."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(own).alias("node"), own.alias("text"))


def signed(docs: DataFrame, key: str, text: str, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: key, node and the hashes of its bands (none where it has no words)."""
    bands_ = bands_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.buffers(batch.column(2))
            for a, b in K.slices(offsets):
                part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                times = signatures(*weighted_shingles(part, at, width), b - a, bands_ * ROWS)
                full = np.isfinite(times[:, 0])
                spots = np.concatenate([[0], np.cumsum(full * bands_)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(spots), pa.array(band_hashes(times[full]).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), bands], ["key", "node", "bands"])

    return _nodes(docs, key, text).mapInArrow(run, "key long, node long, bands array<long>")


def overlaps(row_a: np.ndarray, h_a: np.ndarray, w_a: np.ndarray, row_b: np.ndarray, h_b: np.ndarray, w_b: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of each of n pairs of multisets."""
    key_a, key_b = (h ^ K.mix(row.astype(_U) + _U(1)) for row, h in ((row_a, h_a), (row_b, h_b)))
    _, i, j = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    common = np.bincount(row_a[i], weights=np.minimum(w_a[i], w_b[j]), minlength=n)
    both = np.bincount(row_a, weights=w_a, minlength=n) + np.bincount(row_b, weights=w_b, minlength=n)
    return common / np.maximum(both - common, 1)


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are at least so similar, with their similarity."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (buf_a, at_a), (buf_b, at_b) = K.buffers(batch.column(2)), K.buffers(batch.column(3))
            for s, e in K.slices(at_a + at_b):
                a = weighted_shingles(buf_a[at_a[s] : at_a[e]], at_a[s : e + 1] - at_a[s], width)
                b = weighted_shingles(buf_b[at_b[s] : at_b[e]], at_b[s : e + 1] - at_b[s], width)
                found = overlaps(*a, *b, e - s)
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), pa.array(found)], ["a", "b", "similarity"])
                yield part.filter(pa.array(found >= similarity))

    return both.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, all_links: bool = True) -> DataFrame:
    """Per row: key, class_id (the smallest key of its class), class_hash (the hash of the text of that key) and kept (whether
    it is that text under that key); with ``all_links`` also n_links, how many other texts its text is so similar to.
    """
    rows = written(signed(docs, key, text, width, similarity), "signatures")
    classes = rows.filter("key IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.min("key").alias("key"))
    nodes = written(classes, "texts")
    members = nodes.select("node", "key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket")
    buckets = written(members.join(shared, "bucket"), "buckets")
    involved = buckets.select("node", "key").distinct()
    # of copies, only the text under the smallest key is moved
    texts = written(_nodes(docs, key, text).join(involved, ["key", "node"]).dropDuplicates(["node"]).select("node", "text"), "candidates")

    links = tried = roots = None  # no roots: each node is its own
    spent = [buckets, texts]
    for turn in range(3):
        mixed = _mixed(buckets, roots)
        if turn < 2:
            # first the text of the smallest key, of which the others are the likeliest to be copies, then any
            rank = F.struct((F.col("key") if turn == 0 else F.xxhash64("bucket", "node")).alias("h"), "node", "root")
            centre = mixed.groupBy("bucket").agg(F.min(rank).alias("c"))
            pairs = mixed.join(centre, "bucket").filter(F.col("root") != F.col("c.root")).select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        else:
            mixed = written(mixed, "mixed")
            spent.append(mixed)
            pairs = _agreeing(mixed, texts, width, similarity)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        spent.append(pairs)
        if pairs.isEmpty():
            break
        found = written(verified(pairs, texts, width, similarity), "links")
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            roots = components(links)
    if all_links and links is not None:
        # texts of one class as well: every node is a root of its own
        many = buckets.groupBy("bucket").agg(F.count("*").alias("members"))
        pairs = _agreeing(written(buckets.join(many, "bucket").withColumn("root", F.col("node")), "whole"), texts, width, similarity)
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.union(written(verified(pairs, texts, width, similarity), "links"))
    dropped(*spent)  # what is left to read are signatures, texts' keys, links and components
    return _classes(rows, nodes, links if all_links else None, roots, key, all_links)


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows with ``root``, the node itself where it has no links."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """bucket, node and root of the members of buckets that reach into several components."""
    placed = _rooted(buckets, roots)
    several = placed.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("members")).filter("r1 < r2")
    return placed.join(several.select("bucket", "members"), "bucket")


def _agreeing(mixed: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of different roots that share a bucket and agree on enough registers, each once.

    A bucket's members are dealt to blocks, and every two blocks meet in one task of at most 2 * BLOCK members or so.
    """
    size = bands_for(similarity) * ROWS
    least, least_long = agreeing(size, similarity), agreeing(LONG, similarity)
    wanted = texts.join(mixed.select("node").distinct(), "node").select("node", "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.buffers(batch.column(1))
            for a, b in K.slices(offsets):
                found = weighted_shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                times = np.hstack([signatures(*found, b - a, n).astype(np.float32) for n in (size, LONG)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([t.tobytes() for t in times], pa.binary())], ["node", "signature"])

    signed_ = wanted.mapInArrow(sign, "node long, signature binary")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = mixed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root").join(signed_, "node")

    def compare(table: pa.Table) -> pa.Table:
        node, root, own = (table.column(n).to_numpy() for n in ("node", "root", "own"))
        times = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(node), -1)
        flat, more = np.ascontiguousarray(times[:, :size]), times[:, size:]
        hashes, bucket = band_hashes(flat.view(np.float32)), table.column("bucket")[0].as_py()
        band = int(np.flatnonzero(hashes[0] == bucket)[0])
        one_block = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, right = (np.arange(len(node)),) * 2 if one_block else (np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max()))
        out_a, out_b = [], []
        for at in range(0, len(left), 64):
            x = left[at : at + 64]
            agree = np.zeros((len(x), len(right)), np.uint16)
            for k in range(flat.shape[1]):
                agree += flat[x, k][:, None] == flat[right, k][None, :]
            i, j = np.nonzero((agree >= least) & (root[x][:, None] != root[right][None, :]))
            i, j = x[i], right[j]
            fresh = np.ones(len(i), bool)
            if one_block:
                fresh = i < j
            fresh &= ~(hashes[i][:, :band] == hashes[j][:, :band]).any(1)
            i, j = i[fresh], j[fresh]
            for k in range(0, len(i), 4096):
                near = (more[i[k : k + 4096]] == more[j[k : k + 4096]]).sum(1) >= least_long
                out_a.append(node[i[k : k + 4096][near]])
                out_b.append(node[j[k : k + 4096][near]])
        a, b = np.concatenate([*out_a, np.empty(0, np.int64)]), np.concatenate([*out_b, np.empty(0, np.int64)])
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def _classes(rows: DataFrame, nodes: DataFrame, links: DataFrame | None, roots: DataFrame | None, key: str, all_links: bool) -> DataFrame:
    named = _rooted(nodes.select("node", F.col("key").alias("first")), roots)
    named = named.join(named.groupBy("root").agg(F.min(F.struct("first", "node")).alias("c")), "root").select("node", F.col("c.first").alias("class_id"), F.col("c.node").alias("class_hash"))
    counts = [F.lit(0).cast("long").alias("n_links")]
    if links is not None:
        named = named.join(links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links")), "node", "left")
        counts = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    out = rows.select("key", "node").join(named, "node", "left")
    lone = F.col("key").isNull()
    where = [F.when(~lone, F.col(c)).alias(c) for c in ("class_id", "class_hash")]
    kept = lone | ((F.col("key") == F.col("class_id")) & (F.col("node") == F.col("class_hash")))
    return out.select(F.col("key").alias(key), *where, *(counts if all_links else []), kept.alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates, that with the smallest key; of rows that repeat key and text one stays, and rows without key stay."""
    classes = near_duplicates(docs, key, text, width, similarity, all_links=False)
    kept = classes.filter(F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("_kept"), F.col("class_hash").alias("_node")).distinct()
    named = docs.filter(F.col(key).isNotNull()).withColumns({"_kept": F.col(key).cast("long"), "_node": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    first = named.join(kept, ["_kept", "_node"], "left_semi").dropDuplicates(["_kept", "_node"]).select(docs.columns)
    return first.unionByName(docs.filter(F.col(key).isNull()))
