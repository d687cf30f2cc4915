"""Threshold-scaled document fingerprints, in DataFrame functions only.

A text's shingles are the runs of five lower-cased words. Their 64-bit hashes are spread evenly, so keeping every hash
below a fixed fraction of the range keeps about that fraction of any text's shingles, whatever its length. Sketches of
parts merge into the sketch of the whole, and the share of one sketch found in another estimates containment even when
one text is far longer. The smallest hash is kept where no hash is below the threshold, so that short texts have one.

Defined cases: a null text is empty; an empty text has an empty fingerprint, as like to another empty one as can be (1)
and unlike all others (0); a text of one to four words is one shingle. Rows with equal keys follow each other by the hash
of their text, null keys before all others. A table with one row is its own next. Keys are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.shared import count_slices
from terrace.operators.relational import place_among, quantile_cuts

WIDTH = 5
#: Kept share of all hashes: one in eight.
SCALE = 8
#: Stretches of neighbouring rows for each shuffle partition; a window holds one.
PARTS = 4
_WHITE = r"[\x20\x09-\x0D]+"


def _threshold(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale


def with_sketch(df: DataFrame, text: str, out: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Adds the sorted array of kept hashes of the column ``text``."""
    words = F.filter(F.split(F.lower(F.col(text)), _WHITE), lambda w: w != "")
    df = df.withColumn(f"_{out}_w", F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col(f"_{out}_w")
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    df = df.withColumn(f"_{out}_s", F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))).drop(f"_{out}_w")
    df = df.withColumn(f"_{out}_k", F.filter(f"_{out}_s", lambda x: x < F.lit(_threshold(scale))))
    kept = F.when((F.size(f"_{out}_k") == 0) & (F.size(f"_{out}_s") > 0), F.array(F.array_min(f"_{out}_s"))).otherwise(F.col(f"_{out}_k"))
    return df.withColumn(out, F.array_sort(F.array_distinct(kept))).drop(f"_{out}_s", f"_{out}_k")


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda x: x < F.lit(_threshold(scale)))
    return F.array_sort(F.when((F.size(low) == 0) & (F.size(both) > 0), F.array(F.array_min(both))).otherwise(low))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def _chunks(df: DataFrame, key: str, text: str) -> Column:
    """Number of a stretch of rows in the order of key and text's hash, growing with it.

    Quantiles of the keys cut all rows into PARTS stretches for each shuffle partition, whatever the keys' range. A key that
    takes several stretches, as one that repeats may, and the null key are cut further by the text's hash.
    """
    number, parts = F.col(key).cast("long"), PARTS * count_slices(df.sparkSession)
    every, nulls = df.select(F.count("*"), F.count_if(number.isNull())).first()
    cuts = quantile_cuts(df, number, parts)
    distinct = sorted(set(cuts))
    share = (F.xxhash64(text).cast("double") / 2.0**64 + 0.5).cast("double")  # grows with the signed hash, from 0 to 1
    i = place_among(number, distinct)
    pieces = F.when(F.get(F.lit(distinct), i) == number, F.get(F.lit([cuts.count(c) for c in distinct]), i)).otherwise(1) if distinct else F.lit(1)
    inside = F.least(F.floor(share * pieces), pieces - 1)
    lone = F.least(F.floor(share * (1 + nulls * parts // max(every, 1))), F.lit(nulls * parts // max(every, 1)))
    return F.when(number.isNull(), lone).otherwise((i + 1) * F.lit(1 << 32) + inside).cast("long")


def with_next(df: DataFrame, key: str, text: str, carried: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Adds ``next_text`` and ``next_sketch``: text and column ``carried`` of the row with the next larger key."""
    df = df.withColumn("_chunk", _chunks(df, key, text))
    near = Window.partitionBy("_chunk").orderBy(F.col(key).asc_nulls_first(), F.xxhash64(text))
    after = df.withColumn("_next", F.lead(F.struct(F.col(text).alias("t"), F.col(carried).alias("s"))).over(near))
    firsts = df.groupBy("_chunk").agg(F.min_by(text, F.struct(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), F.xxhash64(text))).alias("_first"))
    # stretches are few: one row for each is ordered here, and the last is followed by the first
    every = Window.orderBy("_chunk")
    round_ = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select("_chunk").select(F.col("_chunk").alias("_before"), F.coalesce(F.lead("_chunk").over(every), F.first("_chunk").over(round_)).alias("_chunk"))
    heads = with_sketch(follows.join(firsts, "_chunk").select(F.col("_before").alias("_chunk"), "_first"), "_first", "_first_s", width, scale)
    joined = after.join(heads, "_chunk", "left")
    inside = F.col("_next").isNotNull()
    return joined.withColumn("next_text", F.when(inside, F.col("_next.t")).otherwise(F.col("_first"))).withColumn("next_sketch", F.when(inside, F.col("_next.s")).otherwise(F.col("_first_s"))).drop("_chunk", "_next", "_first", "_first_s")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Per row: key and ``sketch``, the array of kept shingle hashes."""
    return with_sketch(docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "text", "sketch", width, scale).drop("text")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the beginning of the next document."""
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_sketch(base, "text", "own"), "key", "text", "own")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "other")
    return rows.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("other").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_sketch")).alias("near_next"),
    )
