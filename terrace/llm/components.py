"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; nodes of one component, and no others, share a root.

    Each round every node joins its neighbour (or itself) of the smallest hash, and links between joined nodes become
    links between those they joined. The hash makes the order random, so that chains shrink by a constant factor a round
    and stars at once. Rounds are written to the shared folder; nothing is gathered but whether links are left.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    edges = written(edges, "links")
    spent = [edges]
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        best = both.groupBy(F.col("a").alias("u")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        joins = written(best.select("u", F.least(own, F.col("m"))["v"].alias("v")), "joins")
        spent.append(joins)
        labels = labels.join(joins.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("v", "root").alias("root"))
        edges = edges.join(joins.withColumnRenamed("u", "a").withColumnRenamed("v", "va"), "a").join(joins.withColumnRenamed("u", "b").withColumnRenamed("v", "vb"), "b")
        edges = written(edges.select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b")).filter("a <> b").distinct(), "links")
        spent.append(edges)
    out = written(labels, "components")
    dropped(*spent)
    return out
