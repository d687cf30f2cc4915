"""Splitting texts into chunks, and ingesting documents and chunks that are new by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.errors import DataError
from terrace.functions.binding import bound


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _starts(n: Column, size: int, overlap: int) -> Column:
    """Chunk starts: every step of size - overlap (one at least), up to the first chunk that reaches the end."""
    step = max(size - overlap, 1)
    every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.filter(every, lambda s: (s == 0) | (s - step + size < n))).otherwise(F.array().cast("array<int>"))


def chunk_tokens(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """Chunks of ``size`` words, as an array of texts."""
    if size <= 0:
        return F.array().cast("array<string>")
    return bound(lambda words: F.transform(_starts(F.size(words), size, overlap), lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " ")), tokens(text))


def chunk_chars(text: Column, size: int, overlap: int = 0) -> Column:
    """Chunks of ``size`` characters."""
    if size <= 0:
        return F.array().cast("array<string>")
    return F.transform(_starts(F.char_length(text), size, overlap), lambda s: F.substring(text, s + 1, F.lit(size)))


def chunk_paragraphs(text: Column, size: int, repeat: bool = False) -> Column:
    """Paragraphs, packed while they and the blank line fit into ``size`` characters. With ``repeat``, a paragraph that
    opens a chunk also stands alone before it."""
    if size <= 0:
        return F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(acc: Column, p: Column) -> Column:
        over = (F.char_length(acc["held"]) + F.char_length(p) + 2 > size) & (acc["held"] != "")
        flushed = F.concat(acc["out"], F.array(acc["held"], p) if repeat else F.array(acc["held"]))
        joined = F.when(acc["held"] == "", p).otherwise(F.concat(acc["held"], F.lit("\n\n"), p))
        return F.struct(F.when(over, flushed).otherwise(acc["out"]).alias("out"), F.when(over, p).otherwise(joined).alias("held"))

    return F.aggregate(F.split(text, "\n\n"), start, step, lambda a: F.when(a["held"] != "", F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))


def chunks(text: Column, by: str = "tokens", size: int = 200, overlap: int = 40) -> Column:
    if by == "tokens":
        return chunk_tokens(text, size, overlap)
    if by == "chars":
        return chunk_chars(text, size, overlap)
    if by == "paragraphs":
        return chunk_paragraphs(text, size)
    raise DataError(f"can't chunk by {by!r}")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def new_by_content(documents: DataFrame, known: DataFrame | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """Documents whose content is neither known nor that of a document with a smaller key; adds content_hash.

    Contents are compared by hash; only hashes and keys are grouped. Contents are moved once, by hash and key, so that the
    copies of one content do not meet.
    """
    hashed = documents.withColumn("content_hash", content_hash(F.col(content)))
    if known is not None:
        hashed = hashed.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    first = hashed.groupBy("content_hash").agg(F.min(key).alias(key)).filter(F.col(key).isNotNull())
    return hashed.join(first, ["content_hash", key], "left_semi").dropDuplicates(["content_hash", key])


def ingest_chunks(documents: DataFrame, known: DataFrame | None = None, by: str = "tokens", size: int = 200, overlap: int = 40, key: str = "path", content: str = "content") -> DataFrame:
    """New chunks of documents: path `<path>#chunk_<i>`, content, metadata and content_hash."""
    pieces = documents.select(F.col(key).cast("string").alias("source"), chunks(F.col(content), by, size, overlap).alias("pieces"))
    each = pieces.select("source", F.size("pieces").alias("n"), F.posexplode("pieces").alias("i", "content"))
    rows = each.select(
        F.concat("source", F.lit("#chunk_"), F.col("i").cast("string")).alias("path"),
        "content",
        F.create_map(F.lit("source_path"), F.col("source"), F.lit("chunk_index"), F.col("i").cast("string"), F.lit("chunk_count"), F.col("n").cast("string"), F.lit("chunking"), F.lit(by)).alias("metadata"),
    )
    return new_by_content(rows, known)
