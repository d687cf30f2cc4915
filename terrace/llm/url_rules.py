"""URL allow and block rules by a sort-merge range join, in DataFrame functions only.

A host's labels, reversed and each closed by a dot, make a key under which a rule's host and all its subdomains are one
interval: `example.net` begins at `net.example.` and ends before `net.example/`. Such intervals nest or are apart. URLs
and the starts of the rules' intervals are sorted together; the sweep carries the last started rule with the stack of
the rules that enclose it, and a URL keeps those of the stack whose interval it is still in and whose path begins its
own. The longest rule decides.

URLs are dealt to slices by row number, so no host, however frequent, loads one task; the rules, a policy list that does
not grow with the data, are repeated in each slice. Defined cases: a null URL or one without `://` has an empty host and
path and gets the default verdict; of equally long rules the last by text, then block before allow, decides; repeated
URLs are judged each.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.shared import count_slices

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?` or `#`; A-Z lower-cased) and path (from there up to `?` or `#`)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def stacks(rules: DataFrame) -> DataFrame:
    """Per rule host: its key and the rules of it and of all hosts that enclose it."""
    own = rules.select(
        host_key(F.translate("host", _UPPER, _LOWER)).alias("key"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.concat("host", "path").alias("rule"),
            "verdict",
            "path",
        ).alias("entry"),
    ).select("key", F.col("entry").withField("lo", F.col("key")).alias("entry"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    inside = own.select("key").distinct().select(
        "key",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("outer"),
    )
    return inside.join(own.withColumnRenamed("key", "outer"), "outer").groupBy("key").agg(F.collect_list("entry").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per row: the kept columns, host, path, rule (null if none fits) and verdict."""
    n = 8 * count_slices(pages.sparkSession)
    host, path = host_and_path(F.col(url).cast("string"))
    row = F.struct(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keep)], host.alias("host"), path.alias("path"))
    points = pages.select(row.alias("row"), F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int").alias("slice"))
    points = points.select("slice", host_key(F.col("row.host")).alias("key"), F.lit(1).alias("kind"), "row")
    starts = stacks(rules).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"), "key", F.lit(0).alias("kind"), "stack")
    events = points.unionByName(starts, allowMissingColumns=True)
    sweep = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    active = F.filter("stack", lambda r: F.startswith(F.col("key"), r["lo"]) & F.startswith(F.col("row.path"), r["path"]))
    best = F.array_max(F.transform(active, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    judged = swept.select("row", best.alias("best"))
    return judged.select(
        *[F.col(f"row.c{i}").alias(k) for i, k in enumerate(keep)],
        "row.host",
        "row.path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow") -> str:
    """The same in DuckDB's SQL, by testing every rule against every URL."""
    table = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, host, path) AS (VALUES {table}),
m AS (SELECT p.page_id, max({{'n': length(r.host) + length(r.path), 'rule': r.host || r.path, 'verdict': r.verdict}}) AS best
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.best.rule AS rule, coalesce(m.best.verdict, '{default}') AS verdict FROM p LEFT JOIN m USING (page_id)"""
