"""Extensions that the data layer lacks: as-of and range joins, roll-ups, running figures and set operations over Datasets.

Hash, sort-merge, semi and anti joins, cubes and windows are Spark's own and are used directly on ``Dataset.df``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the last right row of the same key at or before their time; null if none.

    Both sides are put under one another and swept in order of time: one shuffle by key, no pairs.
    """
    names = left.columns
    a = left.select(F.struct(*names).alias("_row"), *by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *by, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    sweep = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(sweep)).filter("_side = 1")
    return met.select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


#: Rows of a cell that a block of a range join takes from either side; pairs to try for each of its tasks; most tasks.
BLOCK_ROWS, TASK_PAIRS, MOST_TASKS = 4096, 1 << 24, 1 << 14


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the intervals [low, high) they lie in, by an equi-join on cells of ``width``.

    Intervals enter each cell they touch, so the width should be near their usual length. The points and the intervals of a
    full cell are dealt by hash to parts of about BLOCK_ROWS, and each part meets each in a block of its own: pairs grow with the
    product of both sides, but no task has more of them than its share, and rows are copied once for BLOCK_ROWS of their pairs.
    Equal rows share a part.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    cells = intervals.filter(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    placed = points.withColumn("_cell", cell(at)).filter("_cell IS NOT NULL")
    parts = lambda df, name: df.groupBy("_cell").agg(F.count("*").alias(name))
    full = parts(placed, "_n").join(parts(cells, "_m"), "_cell")
    pairs = full.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(pairs // TASK_PAIRS), MOST_TASKS))
    grid = full.select("_cell", *[F.ceil(F.col(c) / BLOCK_ROWS).alias(c) for c in ("_n", "_m")])

    def dealt(df: DataFrame, columns: list[str], own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*columns), F.col(own)).alias(own_part)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other_part)
        return df.join(grid, "_cell").select(*df.columns, part, every).repartition(tasks, "_cell", "_point_part", "_interval_part")

    plain = lambda df: [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    block = ["_cell", "_point_part", "_interval_part"]
    left = dealt(placed, plain(points), "_n", "_m", "_point_part", "_interval_part")
    right = dealt(cells, plain(intervals), "_m", "_n", "_interval_part", "_point_part")
    return left.join(right, block).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop(*block)


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hint: str | None = None) -> DataFrame:
    """Equi-join of any kind; ``hint`` is broadcast, merge, shuffle_hash or none, where Spark's sizes and statistics decide."""
    return left.join(right.hint(hint) if hint else right, on, how)


def grouped(df: DataFrame, by: list[str], value: str, distinct: str) -> DataFrame:
    """Rows, sum of ``value`` and different values of ``distinct`` for each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.countDistinct(distinct).alias("kinds"))


def rollup(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.rollup(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.grouping_id().alias("level"))


def cube(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.cube(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.grouping_id().alias("level"))


def running(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds place, running total and the value before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"place": F.row_number().over(w), "running": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag(value).over(w)})


def quantile_cuts(df: DataFrame, number: Column, parts: int) -> list:
    """Approximate quantiles that cut the rows into so many stretches of about equal size: a short sorted list, with repeats
    where one value holds more than a stretch; nulls are left out."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], F.lit(10 * parts))).first()[0]
    return sorted(found or [])


def place_among(number: Column, cuts: list) -> Column:
    """How many of the sorted cuts are below the value, by halving; null for null."""
    if not cuts:
        return F.when(number.isNotNull(), F.lit(0))
    held = F.lit(cuts)
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        above = F.get(held, middle) < number
        go = a["low"] < a["high"]
        return F.struct(F.when(go & above, middle + 1).otherwise(a["low"]).alias("low"), F.when(go & ~above, middle).otherwise(a["high"]).alias("high"))

    steps = F.lit(list(range(len(cuts).bit_length() + 1)))
    return F.when(number.isNotNull(), F.aggregate(steps, start, halve, lambda a: a["low"]))


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``, the running sum of ``value`` by key in an order whose first column is a number or a time.

    Approximate quantiles of that column cut all rows into stretches, as many as there are shuffle partitions; sums of whole
    stretches give each its start, and rows are swept only inside their key's stretch, so a key with a third of all rows is
    swept by many tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(order[0])
    number = F.unix_micros(at) if dict(df.dtypes)[order[0]] == "timestamp" else at
    cuts = sorted(set(quantile_cuts(df, number, parts)))
    rows = df.withColumn("_stretch", F.coalesce(place_among(number, cuts), F.lit(-1)))  # nulls come first
    sums = rows.groupBy(*by, "_stretch").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_stretch").alias("_own"), before.alias("_before"))
    same = F.col("_stretch") == F.col("_own")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.sum(value).over(Window.partitionBy(*by, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(F.col("_before").isNull(), inside).when(inside.isNull(), F.col("_before")).otherwise(inside + F.col("_before"))
    return rows.join(starts, same).withColumn(out, total).drop("_stretch", "_own", "_before", *[f"_{c}" for c in by])


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(b.columns).intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(b.columns).exceptAll(b)
