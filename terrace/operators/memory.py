"""Structured memory: objects in named spaces, ranked for a topic or a kind by one of four strategies.

Objects are rows (id, space, path, kind, raw, summary_micro, summary_short, summary_long, tags, metadata, relevance, pinned,
created_at, updated_at). Every ranking works on all spaces at once; token counts of a space are joined, not collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("basic", "patricia", "raptor", "hybrid")
_KEY = ["space", "id"]


@dataclass(frozen=True)
class Recall:
    """Options: rows a space (at most 20), raw snippets (at most 5), what to include and what to prefer."""

    limit: int = 5
    raw_limit: int = 2
    include_raw: bool = False
    include_metadata: bool = False
    prefer_kinds: tuple[str, ...] = field(default=())
    prefer_tags: tuple[str, ...] = field(default=())
    require_high_relevance: bool = False
    freeze_clock: str | None = None

    @property
    def rows(self) -> int:
        return min(max(self.limit, 0), 20)

    @property
    def snippets(self) -> int:
        return min(max(self.raw_limit, 0), 5)


def space_name(raw: Column) -> Column:
    """Lower case, blanks as underscores, only a-z, 0-9, /, _ and -; `default` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"\s", "_"), r"[^a-z0-9/_-]", "")
    return F.when(kept == "", "default").otherwise(kept)


def strategy(name: str) -> str:
    name = {"graphrag": "hybrid"}.get(name.lower(), name.lower())
    return name if name in STRATEGIES else "basic"


def _tags() -> Column:
    return F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))


# The weights of the basic score.
def basic_score(topic: str, options: Recall = Recall()) -> Column:
    """Relevance 5, 2.5 or 1; pinned 4; the topic in path 3, short summary 2, raw text 1.5; preferred kind 1, tag 0.8 each."""
    level = F.lower("relevance")
    score = F.when(level == "high", 5.0).when(level == "medium", 2.5).otherwise(1.0) + F.when(F.col("pinned"), 4.0).otherwise(0.0)
    if topic:
        for column, weight in (("path", 3.0), ("summary_short", 2.0), ("raw", 1.5)):
            score = score + F.when(F.contains(F.lower(column), F.lit(topic.lower())), weight).otherwise(0.0)
    for kind in options.prefer_kinds:
        score = score + F.when(F.lower("kind") == kind, 1.0).otherwise(0.0)
    for tag in options.prefer_tags:
        score = score + F.when(F.array_contains(_tags(), tag), 0.8).otherwise(0.0)
    return score


def prefix_depth(topic: str) -> Column:
    """How many leading parts of the path are those of the topic."""
    parts = [p.lower() for p in topic.replace("/", " ").split()]
    path = F.filter(F.split(F.lower("path"), "/"), lambda p: p != "")
    depth, same = F.lit(0), F.lit(True)
    for i, p in enumerate(parts):
        same = same & F.coalesce(F.get(path, F.lit(i)) == p, F.lit(False))
        depth = depth + F.when(same, 1).otherwise(0)
    return depth


def overlap(words: tuple[str, ...]) -> Column:
    """1.5 for each word that is a tag or part of the long summary."""
    score = F.lit(0.0)
    for w in words:
        score = score + F.when(F.array_contains(_tags(), w) | F.contains(F.lower("summary_long"), F.lit(w)), 1.5).otherwise(0.0)
    return score


def _split(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s/_-]+"), lambda t: t != "")


def entity_tokens() -> Column:
    """Parts of path and metadata values, and tags."""
    values = F.coalesce(F.map_values("metadata"), F.array().cast("array<string>"))
    return F.concat(_split(F.col("path")), _tags(), F.flatten(F.transform(values, _split)))


def graph_scores(objects: DataFrame, topic: str) -> DataFrame:
    """space, id, graph (the hybrid strategy's bonus) and centrality (sum of 1 / frequency of the object's tokens)."""
    tokens = objects.select("space", "id", "pinned", F.explode(entity_tokens()).alias("token"))
    facts = tokens.groupBy("space", "token").agg(F.count("*").alias("freq"), F.max("pinned").alias("by_pinned"))
    known = tokens.join(facts, ["space", "token"])
    asked = F.lit(0)
    for t in [x for x in topic.lower().replace("/", " ").replace("_", " ").replace("-", " ").split()]:
        asked = asked + F.when(F.col("token") == t, 1).otherwise(0)
    once = known.groupBy(*_KEY, "token", "freq", "by_pinned").agg(F.count("*").alias("n"))
    bonus = F.sum(asked * 2.5 / F.col("freq") + F.when(F.col("by_pinned"), 1.5).otherwise(0.0))
    return once.groupBy(*_KEY).agg(bonus.alias("graph"), F.sum(F.col("n") / F.col("freq")).alias("centrality"))


def rank_topic(objects: DataFrame, topic: str, backend: str = "basic", options: Recall = Recall()) -> DataFrame:
    """Objects with score and place (from 1) in their space. If the relevance gate leaves a space nothing, all its objects
    are ranked by the basic score."""
    backend = strategy(backend)
    base = basic_score(topic, options)
    rows, score = objects, base
    if backend == "patricia":
        score = base + prefix_depth(topic) * 2.0
    elif backend == "raptor":
        score = base + F.greatest(overlap(tuple(topic.lower().split())), overlap(options.prefer_tags))
    elif backend == "hybrid":
        rows = objects.join(graph_scores(objects, topic), _KEY, "left")
        score = base + F.coalesce("graph", F.lit(0.0))
    rows = rows.withColumn("_base", base).withColumn("score", score).drop("graph", "centrality")
    if options.require_high_relevance:
        passes = F.lower("relevance") == "high"
        some = objects.groupBy("space").agg(F.max(passes.cast("int")).alias("_gate"))  # a row for each space, whatever its size
        rows = rows.join(some.withColumnRenamed("space", "_space"), F.col("space").eqNullSafe(F.col("_space")), "left")
        rows = rows.withColumn("_some", F.coalesce(F.col("_gate") == 1, F.lit(False))).drop("_gate", "_space").filter(~F.col("_some") | passes).withColumn("score", F.when(F.col("_some"), F.col("score")).otherwise(F.col("_base"))).drop("_some")
    place = Window.partitionBy("space").orderBy(F.desc("score"), F.desc("updated_at"), "id")
    return rows.drop("_base").withColumn("place", F.row_number().over(place))


def rank_kind(objects: DataFrame, kind: str, backend: str = "basic", options: Recall = Recall()) -> DataFrame:
    """Objects of a kind with score and place in their space."""
    backend = strategy(backend)
    rows = objects.filter(F.lower("kind") == kind.lower())
    millis = F.unix_millis(F.col("updated_at").cast("timestamp")) / 1e9
    pinned = F.col("pinned").cast("int")
    if backend == "basic":
        score = F.unix_millis(F.col("updated_at").cast("timestamp")).cast("double")
    elif backend == "patricia":
        liked = F.arrays_overlap(_tags(), F.array(*[F.lit(t) for t in options.prefer_tags])).cast("int") if options.prefer_tags else F.lit(0)
        score = F.lit(1.0) / F.size(F.split("path", "/")) + pinned * 2.0 + liked
    elif backend == "raptor":
        score = millis + overlap(options.prefer_tags) + pinned * 5.0
    else:
        rows = rows.join(graph_scores(objects, ""), _KEY, "left")
        score = F.coalesce("centrality", F.lit(0.0)) + millis + pinned * 5.0
    place = Window.partitionBy("space").orderBy(F.desc("score"), F.desc("updated_at"), "id")
    return rows.withColumn("score", score).drop("graph", "centrality").withColumn("place", F.row_number().over(place))


def clamp(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def recall_context(objects: DataFrame, topic: str, backend: str = "basic", options: Recall = Recall()) -> DataFrame:
    """A bundle for each space: sections, raw snippets, and a summary of the first six."""
    best = rank_topic(objects, topic, backend, options).filter(F.col("place") <= options.rows)
    section = [F.col(c) for c in ("id", "path", "kind", "summary_micro", "summary_short")] + [clamp(F.col("summary_long"), 1000).alias("summary_long")] + [F.col(c) for c in ("relevance", "pinned", "tags", "updated_at")]
    if options.include_metadata:
        section.append(F.col("metadata"))
    row = F.struct("place", F.struct(*section).alias("section"), F.struct("path", clamp(F.col("raw"), 1200).alias("raw"), "kind").alias("raw"))
    held = best.groupBy("space").agg(F.array_sort(F.collect_list(row), lambda x, y: x["place"] - y["place"]).alias("r"))  # metadata, a map, has no order
    snippets = F.transform(F.filter("r", lambda x: x["place"] <= (options.snippets if options.include_raw else 0)), lambda x: x["raw"])
    lines = F.transform(F.slice("r", 1, 6), lambda x: F.concat(F.lit("• "), x["section"]["path"], F.lit(" — "), F.coalesce(x["section"]["summary_micro"], F.lit(""))))
    head = F.concat(F.lit(f"Context bundle for '{topic}' ("), F.size("r").cast("string"), F.lit(" items):"))
    clock = F.lit(options.freeze_clock) if options.freeze_clock else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return held.select(
        "space",
        F.lit(topic).alias("topic"),
        clock.alias("generated_at"),
        F.array_join(F.concat(F.array(head), lines), "\n").alias("global_summary"),
        F.transform("r", lambda x: x["section"]).alias("sections"),
        snippets.alias("raw"),
        F.lit(options.rows).alias("limit"),
    )


def recall_kind(objects: DataFrame, kind: str, backend: str = "basic", options: Recall = Recall()) -> DataFrame:
    return rank_kind(objects, kind, backend, options).filter(F.col("place") <= options.rows)


def space_summaries(objects: DataFrame) -> DataFrame:
    """Objects, pinned ones and last change of each space."""
    return objects.groupBy("space").agg(F.count("*").alias("objects"), F.count_if("pinned").alias("pinned"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def remember(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Objects with ``new`` put in by space and id; summaries that lack are made of the raw text, tags sorted, and the space
    noted in the metadata. Of several new ones with an id the last updated stays."""
    text = F.coalesce("raw", F.lit(""))
    short = F.coalesce("summary_short", F.substring(text, 1, 200))
    filled = new.withColumns(
        {
            "space": space_name(F.col("space")),
            "summary_micro": F.coalesce("summary_micro", F.substring(short, 1, 80)),
            "summary_short": short,
            "summary_long": F.coalesce("summary_long", F.substring(text, 1, 1000)),
            "tags": F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))),
            "metadata": F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "space"), F.create_map(F.lit("space"), space_name(F.col("space")))),
            "relevance": F.coalesce("relevance", F.lit("medium")),
            "pinned": F.coalesce("pinned", F.lit(False)),
        }
    )
    last = Window.partitionBy(*_KEY).orderBy(F.desc("updated_at"), F.desc(F.xxhash64("raw", "path")))
    filled = filled.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n").select(objects.columns)
    return objects.join(filled.select(*_KEY), _KEY, "left_anti").select(objects.columns).unionByName(filled)


def set_pinned(objects: DataFrame, space: str, which: str, pinned: bool = True) -> DataFrame:
    """Pin or unpin the object with this id or path."""
    hit = (F.col("space") == space) & ((F.col("id").cast("string") == which) | (F.col("path") == which))
    return objects.withColumn("pinned", F.when(hit, F.lit(pinned)).otherwise(F.col("pinned")))


def reset_space(objects: DataFrame, space: str) -> DataFrame:
    return objects.filter(F.col("space") != space)


def expire(objects: DataFrame, ttl_days: int, now: Column | None = None) -> DataFrame:
    """Objects changed within the last days, and pinned ones."""
    now = now if now is not None else F.current_timestamp()
    return objects.filter(F.col("pinned") | (F.col("updated_at") >= now - F.make_dt_interval(F.lit(ttl_days))))


def merged_metadata(base: Column, over: Column) -> Column:
    """Both maps; the second one's values win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
