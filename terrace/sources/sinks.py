"""Writers: folders of part files for data of any size, and single small files on the driver's side."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.errors import DataError
from terrace.operators.dataset import Dataset


def export(data: Dataset | DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """csv (with header), parquet or json. The target is a folder of part files, written by all tasks.

    JSON goes by the path: `.ndjson` and `.jsonl` hold lines; other names hold one array, pretty where the name ends in
    `.pretty.json`, built in one task and so for small results.
    """
    df = data.df if isinstance(data, Dataset) else data
    if kind == "csv":
        df.write.mode(mode).csv(path, header=True)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "json":
        if path.endswith((".ndjson", ".jsonl")):
            df.write.mode(mode).option("ignoreNullFields", "false").json(path)
        else:
            options = {"ignoreNullFields": "false", "pretty": str(path.endswith(".pretty.json")).lower()}
            rows = df.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("rows"))
            rows.select(F.to_json("rows", options)).write.mode(mode).text(path)
    else:
        raise DataError(f"unsupported export format {kind!r}")


def save_csv(data: Dataset | DataFrame, path: str) -> bool:
    export(data, path, "csv")
    return True


def save_parquet(data: Dataset | DataFrame, path: str) -> bool:
    export(data, path, "parquet")
    return True


def save_json(value: Any, path: str) -> bool:
    """A dataset as :func:`export` does; any other value as a pretty file."""
    if isinstance(value, (Dataset, DataFrame)):
        export(value, path, "json")
    else:
        write_text(path, json.dumps(value if isinstance(value, (dict, list)) else {"value": value}, indent=2, ensure_ascii=False, default=str), unescape=False)
    return True


def write_text(path: str, content: str, unescape: bool = True) -> None:
    """A small text file; with ``unescape`` the marks backslash n, r and t become the characters."""
    if unescape:
        content = content.replace("\\n", "\n").replace("\\r", "\r").replace("\\t", "\t")
    folder = os.path.dirname(path)
    if folder:
        os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


def save_file(content: str, path: str) -> None:
    write_text(path, content)


def save_binary(content: bytes, path: str, limit: int = 10 << 20, retries: int = 0) -> int:
    """A binary file of at most ``limit`` bytes; returns its size."""
    if len(content) > limit:
        raise DataError(f"{len(content)} bytes exceed the limit of {limit}")
    for attempt in range(retries + 1):
        try:
            with open(path, "wb") as f:
                f.write(content)
            return len(content)
        except OSError:
            if attempt == retries:
                raise
            time.sleep(0.05 * (attempt + 1))
    raise AssertionError


def save_binary_stream(content: bytes, path: str, cancelled: Callable[[], bool] = lambda: False, step: int = 64 << 10) -> Iterator[dict[str, int]]:
    """Writes step by step and gives the progress of each; stops, and removes the file, once cancelled."""
    with open(path, "wb") as f:
        for at in range(0, max(len(content), 1), step):
            if cancelled():
                f.close()
                os.remove(path)
                return
            part = content[at : at + step]
            f.write(part)
            yield {"offset": at, "length": len(part), "total": len(content)}


def write_metrics(metrics: dict[str, float], path: str) -> None:
    write_text(path, json.dumps(metrics, indent=2, sort_keys=True), unescape=False)


def write_call_log(calls: DataFrame, path: str) -> None:
    """Add a log of calls to those below ``path``, a JSON line for each."""
    calls.write.mode("append").option("ignoreNullFields", "false").json(path)


def prometheus_lines(counters: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Rows of counters in the text exposition format."""
    tags = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), F.col(k).cast("string"), F.lit('"')) for k in labels])
    return counters.select(F.concat(F.lit(name + "{"), tags, F.lit("} "), F.col(value).cast("string")).alias("value"))
