"""Scores of texts against texts, and of search hits against keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.binding import bound
from terrace.operators.chunking import tokens


def bleu(candidate: Column, reference: Column) -> Column:
    """Share of the candidate's words that the reference has, each as often at most as there; one-word, unsmoothed."""

    def share(c: Column, r: Column) -> Column:
        hits = F.aggregate(F.array_distinct(r), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(c, lambda x: x == w)), F.size(F.filter(r, lambda x: x == w))))
        return F.when(F.size(c) > 0, hits / F.size(c)).otherwise(0.0)

    return bound(share, tokens(candidate), tokens(reference))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, row by row of the table as an array."""
    zero = F.transform(b, lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("left"), F.lit(0).alias("corner"))

        def cell(acc: Column, pair: Column) -> Column:
            best = F.when(pair["y"] == x, acc["corner"] + 1).otherwise(F.greatest(acc["left"], pair["up"]))
            return F.struct(F.concat(acc["out"], F.array(best)).alias("out"), best.alias("left"), pair["up"].alias("corner"))

        return F.aggregate(F.zip_with(b, before, lambda y, up: F.struct(y.alias("y"), up.alias("up"))), start, cell, lambda acc: acc["out"])

    last = F.aggregate(a, zero, row)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(last, -1)).otherwise(0)


def rouge_l(candidate: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of words."""
    f1 = lambda n, c, r: F.when(n > 0, 2.0 * n / (F.size(c) + F.size(r))).otherwise(0.0)
    return bound(lambda c, r: bound(lambda n: f1(n, c, r), common_subsequence(c, r)), tokens(candidate), tokens(reference))


def _hits(hits: Column, keywords: Column, k: int) -> tuple[Column, Column]:
    top = F.transform(F.slice(hits, 1, k), lambda h: F.lower(h))
    return top, F.transform(keywords, lambda w: F.lower(w))


def precision_at_k(hits: Column, keywords: Column, k: int) -> Column:
    """Share of the first k hits that contain a keyword."""
    top, words = _hits(hits, keywords, k)
    good = F.size(F.filter(top, lambda h: F.exists(words, lambda w: F.contains(h, w))))
    return F.when(F.size(top) > 0, good / F.size(top)).otherwise(0.0)


def recall_at_k(hits: Column, keywords: Column, k: int) -> Column:
    """Share of the keywords that one of the first k hits contains."""
    top, words = _hits(hits, keywords, k)
    found = F.size(F.filter(words, lambda w: F.exists(top, lambda h: F.contains(h, w))))
    return F.when(F.size(words) > 0, found / F.size(words)).otherwise(0.0)


def f1_at_k(hits: Column, keywords: Column, k: int) -> Column:
    p, r = precision_at_k(hits, keywords, k), recall_at_k(hits, keywords, k)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
