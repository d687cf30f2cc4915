"""Media columns: payloads in content-defined chunks, stored once each, and rebuilt and verified from ordered lists.

A rolling gear hash over the last bytes marks cuts, so that equal passages make equal chunks wherever they stand. Chunk
digests alone are grouped by Spark to find those that occur more than once. These go to the chunk store, each once; all
other chunks stay with their payload's list of chunks, which is joined with the store by digest when it is read. Every chunk
read is checked against its digest, every payload against its own. So a payload's own bytes are stored where it is written,
and cross the network only to meet the chunks that it shares. Which chunks may be shared is asked of a Bloom filter; a false
answer costs a way through the store, nothing else.

A medium is a head (magic, sample bits, rate, number of chunks), the list of chunk lengths and digests, and the chunks as
unsigned 8-bit samples. Defined cases: a null text is empty; an empty text is 64 zero bytes; repeated rows and equal texts
give equal values; keys may repeat or be null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import bloom
from terrace.llm import textkernels as K
from terrace.llm.shared import extended, released, shared_dir

#: Chunk bytes: least, most, and the mean distance of cuts beyond the least as a power of two.
LEAST, MOST, SPREAD_BITS = 256, 4096, 10
BLOCK = 64
DIGEST = 16
HEAD = struct.Struct("<4sBxHI")
_GEAR = K.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def cut_marks(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of the last 32 bytes has its upper bits zero.

    The hash doubles and adds a table value for each byte; sums over 2, 4, ... 32 bytes are built from halves.
    """
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        shifted = h.copy()
        shifted[width:] += h[:-width] << np.uint32(width)
        h = shifted
    return np.flatnonzero(h >> np.uint32(32 - SPREAD_BITS) == 0) + 1


def chunk_ends(size: int, marks: list[int]) -> list[int]:
    """Ends of a payload's chunks: at the first mark past the least length, at the most length else."""
    out, start = [], 0
    for m in marks:
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST and m < size:
            start = m
            out.append(start)
    while size - start > MOST:
        start += MOST
        out.append(start)
    return [*out, size]


def payloads(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with zero bytes up to a positive multiple of 64, and their offsets."""
    sizes = np.diff(offsets)
    padded = np.maximum(-(-sizes // BLOCK), 1) * BLOCK
    at = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(int(at[-1]), np.uint8)
    out[K.ragged_positions(at[:-1], sizes)] = buf
    return out, at


def split(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[memoryview, list[int], list[bytes]]]:
    """Each payload, its chunk ends and digests."""
    data, at = payloads(buf, offsets)
    marks, whole = cut_marks(data), memoryview(data.tobytes())
    spots = np.searchsorted(marks, at + 1)
    for k in range(len(at) - 1):
        s, e = int(at[k]), int(at[k + 1])
        # marks whose window reaches over the payload's begin lie before the least length
        ends = chunk_ends(e - s, (marks[spots[k] : spots[k + 1]] - s).tolist())
        body = whole[s:e]
        yield body, ends, [hashlib.blake2b(body[a:b], digest_size=DIGEST).digest() for a, b in zip([0, *ends], ends)]


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64)[::2]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes payloads; gives (media, chunks). media: key, n_bytes, digest of the payload, ends, digests, and data where no
    chunk is shared, else common (which chunks are) and rest (the others' bytes); chunks: digest and data of shared ones, once."""
    spark = docs.sparkSession
    frame = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.buffers(batch.column(0))
            for a, b in K.slices(offsets):
                found = [d for _, _, ds in split(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for d in ds]
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(found))], ["h"])

    # a chunk's first eight digest bytes stand for it here: at worst an unshared chunk passes for a shared one
    shared = frame.select("text").mapInArrow(digests, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    seen = spark.sparkContext.broadcast(bloom.build(shared, "h"))
    schema = extended(frame.select("key").schema, "n_bytes long, digest binary, ends array<int>, digests array<binary>, data binary, common array<boolean>, rest binary, joint boolean")

    def media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = seen.value
        for batch in batches:
            buf, offsets = K.buffers(batch.column(1))
            for a, b in K.slices(offsets):
                rows = list(split(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                hits = bloom.may_hold(words, _hashes([d for _, _, ds in rows for d in ds]).view(np.uint64))
                first = np.cumsum([0, *(len(ds) for _, _, ds in rows)])[:-1]
                joint = np.logical_or.reduceat(hits, first)
                common = [hits[f : f + len(ds)].tolist() for f, (_, _, ds) in zip(first, rows)]
                rest = [b"".join(body[s:e] for s, e, c in zip([0, *ends], ends, cs) if not c) if j else None for (body, ends, _), cs, j in zip(rows, common, joint)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(offsets[a : b + 1])),
                        pa.array([hashlib.sha256(body).digest() for body, _, _ in rows], pa.binary()),
                        pa.array([ends for _, ends, _ in rows], pa.list_(pa.int32())),
                        pa.array([ds for _, _, ds in rows], pa.list_(pa.binary())),
                        pa.array([None if j else bytes(body) for (body, _, _), j in zip(rows, joint)], pa.binary()),
                        pa.array([c if j else None for c, j in zip(common, joint)], pa.list_(pa.bool_())),
                        pa.array(rest, pa.binary()),
                        pa.array(joint),
                    ],
                    schema.names,
                )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = seen.value
        for batch in batches:
            buf, offsets = K.buffers(batch.column(0))
            for a, b in K.slices(offsets):
                rows = list(split(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                hits = iter(bloom.may_hold(words, _hashes([d for _, _, ds in rows for d in ds]).view(np.uint64)).tolist())
                found = {d: bytes(body[s:e]) for body, ends, ds in rows for s, e, d in zip([0, *ends], ends, ds) if next(hits)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "data"])

    folder = shared_dir(spark, "media")
    frame.mapInArrow(media, schema).write.option("compression", "zstd").partitionBy("joint").parquet(folder)
    chunks_at = shared_dir(spark, "chunks")
    with released(spark):
        frame.select("text").mapInArrow(pieces, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data")).write.option("compression", "zstd").parquet(chunks_at)
    return spark.read.schema(schema).parquet(folder).drop("joint"), spark.read.schema("digest binary, data binary").parquet(chunks_at)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, share of zero crossings about the middle, and entropy in bits of 8-bit samples."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    high = samples >= 128
    return f"mean={samples.mean():.4f};dev={samples.std():.4f};cross={np.count_nonzero(high[1:] != high[:-1]) / len(samples):.4f};bits={-(p * np.log2(p)).sum():.4f}"


def medium(ends: list[int], digests: list[bytes], data: bytes) -> bytes:
    """The stored form of a payload."""
    sizes = np.diff([0, *ends])
    return HEAD.pack(b"CHNK", 8, 8000, len(ends)) + b"".join(struct.pack("<I", n) + d for n, d in zip(sizes.tolist(), digests)) + data


def assembled(ends: list[int], common: list[bool] | None, rest: bytes | None, parts: list[bytes]) -> bytes:
    """A payload from the chunks that it shares, in order, and the bytes of its own ones."""
    if common is None:
        return b"".join(parts)
    out, at, shared = [], 0, iter(parts)
    for s, e, c in zip([0, *ends], ends, common):
        out.append(next(shared) if c else rest[at : at + e - s])
        at += 0 if c else e - s
    return b"".join(out)


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Verified values of rows with digest, ends, digests, common, rest and parts (shared chunks in order, or the whole data)."""
    schema = extended(rows.select(*keep).schema, _FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for digest, ends, digests, common, rest, parts in zip(*(column[n] for n in ("digest", "ends", "digests", "common", "rest", "parts"))):
                ends, digests = ends.as_py(), digests.as_py()
                data = assembled(ends, common.as_py(), rest.as_py(), parts.as_py())
                for a, b, d in zip([0, *ends], ends, digests):
                    if hashlib.blake2b(memoryview(data)[a:b], digest_size=DIGEST).digest() != d:
                        raise ValueError("a stored chunk differs from its digest")
                if hashlib.sha256(data).digest() != digest.as_py():
                    raise ValueError("a rebuilt payload differs from its digest")
                form = medium(ends, digests, data)
                for column_, x in zip(out, (len(data), digest.as_py().hex(), zlib.crc32(data[-BLOCK:]), len(form), hashlib.sha256(form).hexdigest(), feature(np.frombuffer(data, np.uint8)))):
                    column_.append(x)
            yield pa.RecordBatch.from_arrays([*(column[n] for n in keep), *(pa.array(x, pa.int64() if i in (0, 2, 3) else pa.string()) for i, x in enumerate(out))], schema.names)

    return rows.mapInArrow(run, schema)


def rebuild(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """digest, ends, digests, common, rest and parts, the ordered shared chunks, of each distinct payload that has some."""
    names = ("ends", "digests", "common", "rest")
    lists = media.groupBy("digest").agg(F.first(F.struct(*names)).alias("m")).select("digest", *[F.col(f"m.{n}") for n in names])
    places = media.dropDuplicates(["digest"]).select(F.col("digest").alias("payload"), F.posexplode(F.arrays_zip("digests", "common")).alias("place", "c")).filter("c.common")
    wanted = places.select("payload", "place", F.col("c.digests").alias("digest"))
    found = wanted.join(chunks, "digest").groupBy("payload").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("c"))
    return lists.join(found.select(F.col("payload").alias("digest"), F.col("c.data").alias("parts")), "digest")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text's payload, read it back and describe it."""
    media, chunks = store(docs, key, text)
    own = _described(media.filter("data IS NOT NULL").select("key", "n_bytes", "digest", "ends", "digests", "common", "rest", F.array("data").alias("parts")), ["key", "n_bytes"])
    joint = media.filter("data IS NULL")
    values = _described(rebuild(joint, chunks), ["digest"])
    named = joint.select("key", "n_bytes", "digest").join(values, "digest").drop("digest")
    return own.unionByName(named).withColumnRenamed("key", key)
