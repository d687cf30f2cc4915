"""Paths into nested rows, flattening, schema inference and validation, all as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.errors import DataError, ValidationError

_STEP = re.compile(r"\.\.|\.(\*)|\.([A-Za-z_][\w-]*)|\[\s*(?:(\*)|(\d+)|'([^']*)'|\"([^\"]*)\")\s*\]")


def parse_path(path: str) -> list[str | int]:
    """Steps of a path: names, indexes, and "*" for all elements or members."""
    text = path.strip()
    if not text.startswith("$"):
        raise DataError(f"a path begins with $: {path!r}")
    steps, at = [], 1
    while at < len(text):
        m = _STEP.match(text, at)
        if not m or m[0] == "..":
            raise DataError(f"can't read the path {path!r} at {text[at:]!r}")
        steps.append("*" if m[1] or m[3] else int(m[4]) if m[4] else next(x for x in (m[2], m[5], m[6]) if x is not None))
        at = m.end()
    return steps


def path_values(kind: T.DataType, value: Column, steps: list[str | int]) -> tuple[Column, T.DataType] | None:
    """Array of the values that a path reaches in ``value`` (none where the type has no such member); a null value of a
    member is a match, what lies below it is not."""
    nodes, many = F.array(value), kind
    for step in steps:
        below = F.filter(nodes, lambda x: x.isNotNull())
        if isinstance(many, T.StructType):
            if step == "*":
                kinds = {f.dataType.simpleString() for f in many.fields}
                if len(kinds) != 1:
                    return None
                nodes = F.flatten(F.transform(below, _members(many.names)))
                many = many.fields[0].dataType
            elif step in many.names:
                nodes = F.transform(below, _member(step))
                many = many[step].dataType
            else:
                return None
        elif isinstance(many, T.ArrayType):
            if step == "*":
                nodes = F.flatten(below)
            elif isinstance(step, int):
                nodes = F.transform(F.filter(below, _longer(step)), _element(step))
            else:
                return None
            many = many.elementType
        elif isinstance(many, T.MapType) and isinstance(step, str) and step != "*":
            nodes = F.transform(F.filter(below, _has(step)), _entry(step))
            many = many.valueType
        else:
            return None
    return nodes, many


# Spark counts a lambda's parameters, so steps are bound by these instead of by defaults.


def _member(name: str):
    return lambda x: x.getField(name)


def _members(names: list[str]):
    return lambda x: F.array(*[x.getField(n) for n in names])


def _longer(i: int):
    return lambda x: F.size(x) > i


def _element(i: int):
    return lambda x: F.get(x, F.lit(i))


def _has(key: str):
    return lambda x: F.map_contains_key(x, key)


def _entry(key: str):
    return lambda x: F.element_at(x, key)


def filter_jsonpath(df: DataFrame, path: str) -> DataFrame:
    """Rows in which the path, from the row's object, reaches at least one value."""
    steps = parse_path(path)
    if not steps:
        return df
    found = path_values(df.schema, F.struct(*[F.col(f"`{c}`") for c in df.columns]), steps)
    return df.filter(F.size(found[0]) > 0) if found else df.filter(F.lit(False))


def as_json(value: Column, kind: T.DataType) -> Column:
    """A value as JSON text; null is `null`."""
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        text = F.to_json(value, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.StringType):
        whole = F.to_json(F.array(value))
        text = F.substring(whole, F.lit(2), F.length(whole) - 2)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)


def select_jsonpath(df: DataFrame, path: str) -> DataFrame:
    """One column `result`: each value that the path reaches in the array of all rows, as JSON. The path begins `$[*]`."""
    steps = parse_path(path)
    if not steps or steps[0] != "*":
        raise DataError("rows have no order: the path begins with $[*]")
    found = path_values(df.schema, F.struct(*[F.col(f"`{c}`") for c in df.columns]), steps[1:])
    if not found:
        return df.limit(0).select(F.lit("").alias("result"))
    nodes, kind = found
    return df.select(F.explode(nodes).alias("value")).select(as_json(F.col("value"), kind).alias("result"))


def flatten_json(df: DataFrame, separator: str = ".", mode: str = "deep") -> DataFrame:
    """``deep``: a column for each leaf of nested structs, named with its path; ``compat``: struct columns renamed only."""
    if mode == "compat":
        return df.select(*[F.col(f"`{f.name}`").alias(f"{f.name}{separator}flattened" if isinstance(f.dataType, T.StructType) else f.name) for f in df.schema.fields])
    if mode != "deep":
        raise DataError(f"unknown mode {mode!r}")

    def leaves(kind: T.StructType, value: Column | None, name: str) -> Iterator[Column]:
        for f in kind.fields:
            inner = F.col(f"`{f.name}`") if value is None else value.getField(f.name)
            full = f"{name}{separator}{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, inner, full)
            else:
                yield inner.alias(full)

    return df.select(*leaves(df.schema, None, ""))


def json_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.NullType):
        return "null"
    return "string"


def null_counts(df: DataFrame) -> DataFrame:
    """One row for each column, and each member of nested structs: path, type, rows and nulls; one aggregation."""
    paths: list[tuple[str, Column, T.DataType]] = []

    def walk(kind: T.StructType, value: Column | None, name: str) -> None:
        for f in kind.fields:
            inner = F.col(f"`{f.name}`") if value is None else value.getField(f.name)
            full = f"{name}.{f.name}" if name else f.name
            paths.append((full, inner, f.dataType))
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, inner, full)

    walk(df.schema, None, "")
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, (_, c, _) in enumerate(paths)])
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(json_type(k)).alias("type"), F.col("n").alias("rows"), (F.col("n") - F.col(f"c{i}")).alias("nulls")) for i, (p, _, k) in enumerate(paths)])
    return counted.select(F.inline(rows))


def infer_schema(df: DataFrame) -> dict[str, Any]:
    """Draft-07 JSON Schema of the rows: members without nulls are required, members that are always null left out."""
    counts = {r["path"]: (r["rows"], r["nulls"]) for r in null_counts(df).collect()}  # a row for each column

    def of(kind: T.DataType, path: str) -> dict[str, Any]:
        if isinstance(kind, T.StructType):
            inside = [(f, f"{path}.{f.name}" if path else f.name) for f in kind.fields]
            kept = [(f, p) for f, p in inside if counts[p][0] == 0 or counts[p][1] < counts[p][0]]
            return {"type": "object", "properties": {f.name: of(f.dataType, p) for f, p in kept}, "required": [f.name for f, p in kept if counts[p][1] == 0]}
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": {"type": json_type(kind.elementType)}}
        return {"type": json_type(kind)}

    return {"$schema": "http://json-schema.org/draft-07/schema#", **of(df.schema, "")}


_KEYWORDS = {"$schema", "$id", "title", "description", "default", "type", "properties", "required", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "items", "minItems", "maxItems", "additionalProperties"}


def violations(kind: T.DataType, value: Column, schema: dict[str, Any], path: str = "") -> list[tuple[str, str, Column]]:
    """Path, message and condition of each way in which ``value`` can break ``schema``."""
    odd = set(schema) - _KEYWORDS
    if odd:
        raise DataError(f"unsupported schema keywords: {sorted(odd)}")
    out: list[tuple[str, str, Column]] = []
    wanted = schema.get("type")
    if wanted is not None:
        names = [wanted] if isinstance(wanted, str) else list(wanted)
        own = json_type(kind)
        fits = own in names or (own == "integer" and "number" in names)
        bad = value.isNotNull() if not fits else F.lit(False)
        if own == "number" and "integer" in names and "number" not in names:
            bad = value.isNotNull() & (value != F.floor(value))
        out.append((path, f"is not of type {'/'.join(names)}", bad))
    here = value.isNotNull()
    if "enum" in schema:
        out.append((path, "is not one of the listed values", here & ~value.isin(*schema["enum"])))
    if "const" in schema:
        out.append((path, "is not the fixed value", here & (value != F.lit(schema["const"]))))
    if isinstance(kind, T.NumericType):
        for word, text, test in (("minimum", "is less than", lambda x: value < x), ("maximum", "is greater than", lambda x: value > x), ("exclusiveMinimum", "is not greater than", lambda x: value <= x), ("exclusiveMaximum", "is not less than", lambda x: value >= x)):
            if word in schema:
                out.append((path, f"{text} {schema[word]}", here & test(F.lit(schema[word]))))
    if isinstance(kind, T.StringType):
        if "minLength" in schema:
            out.append((path, f"is shorter than {schema['minLength']}", F.char_length(value) < schema["minLength"]))
        if "maxLength" in schema:
            out.append((path, f"is longer than {schema['maxLength']}", F.char_length(value) > schema["maxLength"]))
        if "pattern" in schema:
            out.append((path, f"does not match {schema['pattern']}", here & ~value.rlike(schema["pattern"])))
    if isinstance(kind, T.ArrayType):
        if "minItems" in schema:
            out.append((path, f"has fewer than {schema['minItems']} items", here & (F.size(value) < schema["minItems"])))
        if "maxItems" in schema:
            out.append((path, f"has more than {schema['maxItems']} items", here & (F.size(value) > schema["maxItems"])))
        if isinstance(schema.get("items"), dict):
            inner = schema["items"]
            for k, (p, message, _) in enumerate(violations(kind.elementType, F.lit(None).cast(kind.elementType), inner, f"{path}[]")):
                out.append((p, message, F.exists(value, _breaks(kind.elementType, inner, k))))
    if isinstance(kind, T.StructType):
        for name in schema.get("required", []):
            full = f"{path}.{name}" if path else name
            missing = here & value.getField(name).isNull() if name in kind.names else here
            out.append((full, "is required", missing))
        for name, inner in schema.get("properties", {}).items():
            if name in kind.names:
                out += violations(kind[name].dataType, value.getField(name), inner, f"{path}.{name}" if path else name)
    return out


def _breaks(kind: T.DataType, schema: dict[str, Any], k: int):
    return lambda x: F.coalesce(violations(kind, x, schema)[k][2], F.lit(False))


def validate_incremental(df: DataFrame, schema: dict[str, Any], row_key: str) -> DataFrame:
    """All violations: row (the key), path and message."""
    found = violations(df.schema, F.struct(*[F.col(f"`{c}`") for c in df.columns]), schema)
    errors = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for path, message, bad in found])
    return df.select(F.col(row_key).alias("row"), F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("e")).select("row", "e.path", "e.message")


def is_valid(kind: T.StructType, schema: dict[str, Any]) -> Column:
    """Whether a row of this type meets the schema."""
    out = F.lit(True)
    for _, _, bad in violations(kind, F.struct(*[F.col(f"`{c}`") for c in kind.names]), schema):
        out = out & ~F.coalesce(bad, F.lit(False))
    return out


def value_is_valid(spark: SparkSession, path: str, schema: dict[str, Any]) -> bool:
    """Whether the JSON values of a file or folder all meet the schema; text that is no JSON does not."""
    df = spark.read.json(path, multiLine=True, columnNameOfCorruptRecord="_no_json")
    return "_no_json" not in df.columns and df.filter(~is_valid(df.schema, schema)).isEmpty()


def validate_strict(df: DataFrame, schema: dict[str, Any], row_key: str) -> None:
    """Raises on the violation of the smallest row key."""
    first = validate_incremental(df, schema, row_key).orderBy("row", "path", "message").limit(1).collect()
    if first:
        raise ValidationError(f"row {first[0]['row']}: {first[0]['path']} {first[0]['message']}")
