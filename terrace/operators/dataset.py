"""A named DataFrame with the fluent operations of the data layer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.errors import DataError
from terrace.operators import jsonops, predicate


@dataclass(frozen=True)
class Dataset:
    """Immutable: every operation gives a new one over a longer plan; nothing runs before a sink or an action."""

    name: str
    df: DataFrame
    metadata: dict[str, str] = field(default_factory=dict)

    def over(self, df: DataFrame) -> Dataset:
        return replace(self, df=df)

    def filter(self, condition: str) -> Dataset:
        """Rows that meet a textual condition (see :mod:`terrace.operators.predicate`)."""
        return self.over(self.df.filter(predicate.compile_condition(self.df.schema, condition)))

    def select(self, *fields: str) -> Dataset:
        """Fields by name; a dotted name reaches into structs and stays the column's name."""
        for f in fields:
            predicate.field_type(self.df.schema, f)
        return self.over(self.df.select(*[predicate.field_column(f).alias(f) for f in fields]))

    def take(self, n: int, order_by: list[str] | None = None) -> Dataset:
        """First n rows in the order of ``order_by``; without it any n rows."""
        return self.over((self.df.orderBy(*order_by) if order_by else self.df).limit(n))

    def slice(self, offset: int, n: int, order_by: list[str]) -> Dataset:
        return self.over(self.df.orderBy(*order_by).offset(offset).limit(n))

    def flatten_json(self, separator: str = ".", mode: str = "deep") -> Dataset:
        return self.over(jsonops.flatten_json(self.df, separator, mode))

    def filter_jsonpath(self, path: str) -> Dataset:
        return self.over(jsonops.filter_jsonpath(self.df, path))

    def select_jsonpath(self, path: str) -> Dataset:
        return self.over(jsonops.select_jsonpath(self.df, path))

    def transform(self, options: dict[str, Any]) -> Dataset:
        """``select``, then ``take`` (with ``order_by``), then ``flatten_json`` (a separator or true)."""
        odd = set(options) - {"select", "take", "order_by", "flatten_json", "mode"}
        if odd:
            raise DataError(f"unknown options {sorted(odd)}")
        out = self
        if options.get("select"):
            out = out.select(*options["select"])
        if options.get("take") is not None:
            out = out.take(int(options["take"]), options.get("order_by"))
        if options.get("flatten_json"):
            out = out.flatten_json(options["flatten_json"] if isinstance(options["flatten_json"], str) else ".", options.get("mode", "deep"))
        return out

    def infer_schema(self) -> dict[str, Any]:
        return jsonops.infer_schema(self.df)

    def validate(self, schema: dict[str, Any], row_key: str, mode: str = "strict") -> DataFrame | None:
        """``strict`` raises on the first violation; ``incremental`` gives all as row, path, message."""
        if mode == "incremental":
            return jsonops.validate_incremental(self.df, schema, row_key)
        if mode != "strict":
            raise DataError(f"unknown mode {mode!r}")
        jsonops.validate_strict(self.df, schema, row_key)
        return None

    def batches(self, rows: int) -> Iterator[list[dict[str, Any]]]:
        """Rows by batches, fetched one partition at a time in one pass over the plan."""
        held: list[dict[str, Any]] = []
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(recursive=True))
            if len(held) >= rows:
                yield held
                held = []
        if held:
            yield held

    def rows_json(self) -> DataFrame:
        """Each row as JSON text."""
        return self.df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    @staticmethod
    def from_json(name: str, texts: DataFrame, schema: str, text: str = "value") -> Dataset:
        """Rows from JSON text, one object each; text that is no object of the schema raises."""
        return Dataset(name, texts.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))

    def to_string(self, order_by: list[str] | None = None) -> str:
        """Name, size, schema and the first five rows."""
        n = self.df.count()
        head = (self.df.orderBy(*order_by) if order_by else self.df).limit(5).collect()
        lines = [f"Dataset: {self.name}", f"Rows: {n}, Columns: {len(self.df.columns)}", "Schema:"]
        lines += [f"  {f.name}: {f.dataType.simpleString()}" for f in self.df.schema.fields]
        lines += [str(r.asDict(recursive=True)) for r in head]
        return "\n".join(lines + ([f"... and {n - 5} more"] if n > 5 else []))
