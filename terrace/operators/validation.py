"""Scores of generated texts: relevance, similarity, contradictions, claims, consensus and combined judgements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.errors import DataError
from terrace.functions.binding import bound
from terrace.operators.chunking import tokens

# Phrases that make a text suspicious.
SUSPICIOUS = ("according to recent studies", "research has shown", "experts claim", "it has been proven that", "statistical data shows")
# Words that contradict each other when one stands in either sentence.
OPPOSITES = (("yes", "no"), ("true", "false"), ("correct", "incorrect"), ("possible", "impossible"), ("increases", "decreases"), ("better", "worse"), ("fast", "slow"), ("large", "small"))
# A part of the first sentence that contradicts a part of the second.
NEGATIONS = (("no is", "is"), ("no can", "can"), ("never", "always"))
# Patterns of claims that can be checked.
CLAIMS = (r"the \d+% of", r"according to.*,", r"in the year \d+", r"studies show", r"research indicates", r"data reveals", r"statistics confirm")


def _shared(x: Column, y: Column) -> Column:
    """How many of x's words, repeats counted, y has, those over three bytes only."""
    return F.size(F.filter(x, lambda w: (F.octet_length(w) > 3) & F.array_contains(y, w)))


def _words(a: Column, b: Column) -> tuple[Column, Column]:
    return tokens(F.lower(a)), tokens(F.lower(b))


def relevance(prompt: Column, response: Column) -> Column:
    """Share of the prompt's words that the response has; 0 if either is empty."""
    return bound(lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), _shared(x, y) / F.size(x)).otherwise(0.0), *_words(prompt, response))


def _ratio(x: Column, y: Column) -> Column:
    def of(both: Column) -> Column:
        union = F.size(x) + F.size(y) - both
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(union == 0, 1.0).otherwise(both / union)

    return bound(of, _shared(x, y))


def similarity(a: Column, b: Column) -> Column:
    """Common words of the first over the words of both; 0 if either is empty."""
    return bound(_ratio, *_words(a, b))


def contradicts(a: Column, b: Column) -> Column:
    """Whether the second sentence contradicts the first, by parts of words."""
    x, y = F.lower(a), F.lower(b)
    out = F.lit(False)
    for u, v in OPPOSITES:
        out = out | (F.contains(x, F.lit(u)) & F.contains(y, F.lit(v))) | (F.contains(x, F.lit(v)) & F.contains(y, F.lit(u)))
    for u, v in NEGATIONS:
        out = out | (F.contains(x, F.lit(u)) & F.contains(y, F.lit(v)))
    return out


def sentences(text: Column) -> Column:
    return F.split(text, r"\. ")


def contradictions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Per key: number of ordered pairs of its sentences of which the second contradicts the first.

    Which of the rules' words a sentence has is found once for each sentence; pairs are then counted from how many
    sentences have each combination of words, so a long text is not squared.
    """
    words = sorted({w for pair in (*OPPOSITES, *NEGATIONS) for w in pair})
    low = F.lower("sentence")
    each = texts.select(key, F.explode(sentences(F.col(text))).alias("sentence"))
    marks = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(i)) for i, w in enumerate(words)]))
    kinds = each.select(key, marks.alias("marks")).groupBy(key, "marks").agg(F.count("*").alias("n")).filter(F.size("marks") > 0)
    place = {w: i for i, w in enumerate(words)}
    rules = [(place[u], place[v]) for u, v in OPPOSITES] + [(place[v], place[u]) for u, v in OPPOSITES] + [(place[u], place[v]) for u, v in NEGATIONS]

    def clash(a: Column, b: Column) -> Column:
        out = F.lit(False)
        for u, v in rules:
            out = out | (F.array_contains(a, u) & F.array_contains(b, v))
        return out

    held = kinds.groupBy(key).agg(F.collect_list(F.struct("marks", "n")).alias("k"))
    total = F.aggregate(
        "k",
        F.lit(0).cast("long"),
        lambda acc, x: acc + F.aggregate(F.filter("k", lambda y: clash(x["marks"], y["marks"])), F.lit(0).cast("long"), lambda a, y: a + x["n"] * (y["n"] - F.when(x["marks"] == y["marks"], 1).otherwise(0))),
    )
    return texts.select(key).join(held.select(key, total.alias("contradictions")), key, "left").select(key, F.coalesce("contradictions", F.lit(0).cast("long")).alias("contradictions"))


def claims(text: Column) -> Column:
    """The first five claims: sentences that meet a pattern, and once more those over 20 bytes with a digit."""

    def of(s: Column) -> Column:
        low = F.lower(s)
        pattern = F.lit(False)
        for p in CLAIMS:
            pattern = pattern | F.rlike(low, F.lit(p))
        digit = F.rlike(s, F.lit("[0-9]")) & (F.octet_length(s) > 20)
        return F.concat(F.when(pattern, F.array(F.trim(s))).otherwise(F.array().cast("array<string>")), F.when(digit, F.array(F.trim(s))).otherwise(F.array().cast("array<string>")))

    return F.slice(F.flatten(F.transform(sentences(text), of)), 1, 5)


def _clamped(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def basic_validation(rows: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """Per key: confidence, 1 less 0.1 a suspicious phrase, 0.2 a contradiction and 0.3 for a relevance under a half; valid from 0.8."""
    low, suspicious = F.lower(response), F.lit(0)
    for p in SUSPICIOUS:
        suspicious = suspicious + F.contains(low, F.lit(p)).cast("int")
    scored = rows.select(key, suspicious.alias("suspicious"), relevance(F.col(prompt), F.col(response)).alias("relevance")).join(contradictions(rows, key, response), key)
    confidence = F.round(_clamped(1.0 - 0.1 * F.col("suspicious") - 0.2 * F.col("contradictions") - F.when(F.col("relevance") < 0.5, 0.3).otherwise(0.0)), 9)
    return scored.withColumn("confidence", confidence).withColumn("is_valid", F.col("confidence") >= 0.8)


def response_pairs(responses: DataFrame, group: str, number: str, text: str) -> DataFrame:
    """Ordered pairs of a group's responses with their similarity and whether the texts are equal.

    A group is the answers to one prompt, a few by nature: its pairs are its square. Texts are cut to words once each, and
    words and a digest are joined, not texts.
    """
    own = responses.select(group, number, tokens(F.lower(text)).alias("_words"), F.sha2(text, 256).alias("_digest"))
    other = own.select(group, F.col(number).alias("other"), F.col("_words").alias("_other_words"), F.col("_digest").alias("_other_digest"))
    pairs = own.join(other, group).filter(F.col(number) != F.col("other"))
    return pairs.select(group, number, "other", _ratio(F.col("_words"), F.col("_other_words")).alias("similarity"), (F.col("_digest") == F.col("_other_digest")).alias("equal"))


def _agreement(responses: DataFrame, group: str, number: str, text: str) -> DataFrame:
    """Per group: the best response's number and text, its score, and how many of the group's pairs are under 0.6."""
    pairs = response_pairs(responses, group, number, text)
    mean = F.sum(F.when(~F.col("equal"), F.col("similarity")).otherwise(0.0)) / F.count("*")
    scores = pairs.groupBy(group, number).agg(mean.alias("score"), F.count_if(F.col("similarity") < 0.6).alias("low"))
    all_ = responses.select(group, number, text).join(scores, [group, number], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col(number).alias("n"), F.col(text).alias("t")))
    found = all_.groupBy(group).agg(best.alias("b"), F.coalesce(F.sum("low"), F.lit(0)).alias("low"))
    return found.select(group, F.col("b.n").alias(number), F.col("b.t").alias("consensus"), (-F.col("b.s") + 0.0).alias("score"), "low")


def consensus(responses: DataFrame, group: str, number: str, text: str) -> DataFrame:
    """Per group: the response most similar to the others on average; equal texts add nothing, ties go to the first."""
    return _agreement(responses, group, number, text).drop("low")


def ensemble_validation(responses: DataFrame, group: str, number: str, text: str) -> DataFrame:
    """Per group: confidence, 1 less 0.1 for each ordered pair under 0.6; valid from 0.7; content is the consensus."""
    confidence = F.round(_clamped(1.0 - 0.1 * F.col("low")), 9)
    return _agreement(responses, group, number, text).select(group, confidence.alias("confidence"), (confidence >= 0.7).alias("is_valid"), "consensus")


def fact_validation(verdicts: DataFrame, group: str, verdict: str) -> DataFrame:
    """Per group of checked claims: 1 less 0.2 for each FALSE, 0.1 for each UNCERTAIN, 0.05 for each missing answer."""
    v = F.upper(verdict)
    loss = F.when(F.col(verdict).isNull(), 0.05).when(F.startswith(v, F.lit("FALSE")), 0.2).when(F.startswith(v, F.lit("UNCERTAIN")), 0.1).otherwise(0.0)
    return verdicts.groupBy(group).agg(F.round(_clamped(1.0 - F.sum(loss)), 9).alias("confidence")).withColumn("is_valid", F.col("confidence") >= 0.8)


def comprehensive_score(basic: Column, ensemble: Column, fact: Column) -> Column:
    return basic * 0.3 + ensemble * 0.4 + fact * 0.3


def best_attempt(attempts: DataFrame, group: str, number: str, confidence: str, most: int = 3) -> DataFrame:
    """Per group: of the first attempts, the first valid one (0.8), else the one of the best confidence."""
    valid = F.col(confidence) >= 0.8
    order = F.struct((~valid).alias("bad"), F.when(valid, F.col(number)).otherwise(0).alias("n1"), (-F.col(confidence)).alias("c"), F.col(number).alias("n2"))
    first = attempts.filter(F.col(number) <= most).groupBy(group).agg(F.min(order).alias("o"))
    return first.select(group, F.col("o.n2").alias(number), (-F.col("o.c")).alias(confidence), (~F.col("o.bad")).alias("is_valid"))


def combine(responses: DataFrame, group: str, number: str, text: str, how: str = "majority") -> DataFrame:
    """Per group, one text: majority (the most frequent, ties to the first), first, weighted, best_of_n (longest, ties to the last) or synthesize."""
    if how == "majority":
        votes = responses.groupBy(group, text).agg(F.count("*").alias("v"), F.min(number).alias("n"))
        return votes.groupBy(group).agg(F.min(F.struct((-F.col("v")).alias("v"), "n", F.col(text).alias("t"))).alias("m")).select(group, F.col("m.t").alias("combined"))
    if how == "first":
        return responses.groupBy(group).agg(F.min(F.struct(number, text)).alias("m")).select(group, F.col(f"m.{text}").alias("combined"))
    if how == "best_of_n":
        return responses.groupBy(group).agg(F.coalesce(F.max_by(text, F.when(F.col(text).isNotNull(), F.struct(F.octet_length(text).alias("n"), number))), F.lit("")).alias("combined"))
    # these two are made of all responses of a group, which are the answers to one prompt
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(number, text))), lambda r: r[text])
    held = responses.groupBy(group).agg(ordered.alias("r"))
    n = F.size("r")
    number_of = lambda i: (i + 1).cast("string")
    if how == "weighted":
        out = F.array_join(F.transform("r", lambda r, i: F.concat(F.lit("Response "), number_of(i), F.lit(" (weight: "), F.format_string("%.2f", 1.0 / n), F.lit("): "), r)), "\n\n")
    elif how == "synthesize":
        out = F.array_join(F.transform("r", lambda r, i: F.concat(F.lit("From response "), number_of(i), F.lit(": "), F.get(F.split(r, r"\."), F.lit(0)))), ". ")
    else:
        raise DataError(f"unknown way to combine: {how!r}")
    return held.select(group, out.alias("combined"))


def answered(prompts: DataFrame, responder: Callable, prompt: str = "prompt", out: str = "response") -> DataFrame:
    """Prompts with the responder's answers; it takes and gives pandas series, batch by batch."""
    return prompts.withColumn(out, F.pandas_udf(responder, "string")(F.col(prompt)))


def ranked_providers(candidates: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Candidates (order, weight, failure_rate, capacity, spent, cost, budget) with score and place; one without capacity
    or whose budget the call would exceed has no score and comes last."""
    over = (F.col("capacity") <= 0) | (F.col("spent") + F.col("cost") > F.coalesce("budget", F.lit(float("inf"))))
    score = F.when(~over, F.col("weight") * (1 - F.coalesce("failure_rate", F.lit(0.0))))
    place = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), "order")
    return candidates.withColumn("score", score).withColumn("place", F.row_number().over(place))
