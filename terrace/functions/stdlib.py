"""Scalar and array functions, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.expressions import compile_expression

# --- strings


def length(s: Column) -> Column:
    return F.char_length(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def split(s: Column, separator: str) -> Column:
    return F.split(s, re.escape(separator))


def join(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def starts_with(s: Column, prefix: str) -> Column:
    return F.startswith(s, F.lit(prefix))


def substring(s: Column, start: int, size: int | None = None) -> Column:
    """From the 0-based start; to the end without a size."""
    return F.substring(s, F.lit(start + 1), F.lit(size) if size is not None else F.greatest(F.char_length(s) - start, F.lit(0)))


def concat(*parts: Column) -> Column:
    """Texts put together; other values as their text."""
    return F.concat(*[p.cast("string") for p in parts])


# --- encodings and digests


def base64_encode(s: Column) -> Column:
    return F.base64(s.cast("binary"))


def base64_decode(s: Column) -> Column:
    return F.unbase64(s).cast("string")


def hex_encode(s: Column) -> Column:
    return F.lower(F.hex(s.cast("binary")))


def hex_decode(s: Column) -> Column:
    return F.unhex(s).cast("string")


def url_encode(s: Column) -> Column:
    return F.url_encode(s)


def url_decode(s: Column) -> Column:
    return F.url_decode(s)


def sha256(s: Column) -> Column:
    return F.sha2(s, 256)


# --- numbers, patterns, time


def sqrt(x: Column) -> Column:
    return F.sqrt(x.cast("double"))


def power(x: Column, y: Column) -> Column:
    return F.pow(x.cast("double"), y.cast("double"))


def minimum(x: Column, y: Column) -> Column:
    return F.least(x, y)


def maximum(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def clamp(x: Column, low: Column, high: Column) -> Column:
    """Within the bounds; as it is if they are crossed."""
    return F.when(low > high, x).otherwise(F.least(F.greatest(x, low), high))


def format_number(x: Column, decimals: int = 2) -> Column:
    """Fixed decimals, without marks between thousands."""
    return F.format_string(f"%.{decimals}f", x.cast("double"))


def whole_quotient(a: Column, b: Column) -> Column:
    """Quotient of whole numbers, cut towards zero; null for a divisor of 0."""
    return F.when(b != 0, F.expr("1") * F.floor(F.abs(a) / F.abs(b)) * F.sign(a.cast("double")) * F.sign(b.cast("double"))).cast("long")


def regex_match(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def regex_replace(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, pattern, new)


def now_iso8601() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- JSON values (VARIANT)


def json_parse(s: Column) -> Column:
    return F.try_parse_json(s)


def json_text(v: Column) -> Column:
    return F.to_json(v)


def json_get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def json_index(v: Column, i: int, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$[{i}]", kind)


def pointer_path(pointer: str) -> str:
    """JSON Pointer as a path: numbers are taken as indexes."""
    if not pointer:
        return "$"
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.lstrip("/").split("/")]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)


def json_path(v: Column, pointer: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, pointer_path(pointer), kind)


def json_as_string(v: Column) -> Column:
    """The text of a value that is a text, else null."""
    return F.when(type_name(v) == "string", F.try_variant_get(v, "$", "string"))


def json_keys(text: Column) -> Column:
    return F.json_object_keys(text)


def json_length(text: Column) -> Column:
    """Elements of an array, members of an object, characters of a text."""
    return F.coalesce(F.json_array_length(text), F.size(F.json_object_keys(text)), F.char_length(F.try_variant_get(F.try_parse_json(text), "$", "string")))


def type_name(v: Column) -> Column:
    """int, float, bool, string, array, object or null of a VARIANT."""
    kind = F.lower(F.schema_of_variant(v))
    return (
        F.when(kind.rlike("^(bigint|int|smallint|tinyint)"), "int").when(kind.rlike("^(double|float|decimal)"), "float").when(kind == "boolean", "bool").when(kind.rlike("^array"), "array").when(kind.rlike("^(object|struct)"), "object").when(kind == "void", "null").otherwise("string")
    )


# --- results


def ok(value: Column) -> Column:
    return F.struct(F.lit(True).alias("ok"), value.alias("value"), F.lit(None).cast("string").alias("error"))


def error(message: Column, kind: str = "string") -> Column:
    return F.struct(F.lit(False).alias("ok"), F.lit(None).cast(kind).alias("value"), message.alias("error"))


def is_ok(result: Column) -> Column:
    return result["ok"]


def is_error(result: Column) -> Column:
    return ~result["ok"]


def unwrap(result: Column) -> Column:
    """The value; raises where the result is an error."""
    return F.when(result["ok"], result["value"]).otherwise(F.raise_error(F.coalesce(result["error"], F.lit("error"))))


# --- arrays


def array_map(a: Column, expression: str, whole: bool = False) -> Column:
    """Each element by an expression in x."""
    return F.transform(a, lambda x: compile_expression(expression, {"x": x}, {"x"} if whole else set()))


def array_filter(a: Column, expression: str) -> Column:
    return F.filter(a, lambda x: compile_expression(expression, {"x": x}))


def array_reduce(a: Column, start: Column, expression: str) -> Column:
    """Fold by an expression in acc and x."""
    return F.aggregate(a, start, lambda acc, x: compile_expression(expression, {"acc": acc, "x": x}))


def array_count(a: Column, expression: str | None = None) -> Column:
    return F.size(array_filter(a, expression) if expression else a)


def array_find(a: Column, expression: str) -> Column:
    return F.get(array_filter(a, expression), F.lit(0))


def array_sort(a: Column, order: str = "asc") -> Column:
    return F.sort_array(a, asc=order != "desc")


def enumerate_array(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("value")))


def number_range(start: Column, end: Column, step: int = 1) -> Column:
    """From start up to, and without, end (down for a negative step); empty if there is nothing between."""
    some = start < end if step > 0 else start > end
    last = end - 1 if step > 0 else end + 1
    return F.when(some, F.sequence(start, F.when(some, last).otherwise(start), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def chunk_array(a: Column, n: int) -> Column:
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(a, s + 1, F.lit(n)))


def zip_arrays(a: Column, b: Column) -> Column:
    """Pairs, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))


def unique(a: Column) -> Column:
    return F.array_distinct(a)


def flatten(a: Column) -> Column:
    return F.flatten(a)


def reverse(a: Column) -> Column:
    return F.reverse(a)


# --- texts


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """`{{name}}` replaced by each name's value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d{1,3}[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]?\d{4}"


def pii_redact(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, EMAIL, "[EMAIL]"), PHONE, "[PHONE]")


def free_of_pii(s: Column) -> Column:
    return ~(s.rlike(EMAIL) | s.rlike(PHONE))
