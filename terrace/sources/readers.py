"""Readers: files by suffix, JSON values, whole texts and binary files, and gated downloads."""

from __future__ import annotations

import os
import time
import urllib.request
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.errors import DataError
from terrace.operators.dataset import Dataset

#: Environment variable that must be 1 before anything is fetched over HTTP.
HTTP_GATE = "TERRACE_ALLOW_HTTP"
#: Only whole timestamps are read as such; Spark's own rule would take a bare "T1" for a time of day.
_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]"
OUTPUT_TYPE = "struct<primary_text:string,files:array<struct<name:string,mime_type:string,size:bigint,content:binary>>,metadata:map<string,string>>"


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] if "." in name else ""


def load(spark: SparkSession, path: str, name: str | None = None, schema: str | None = None, **options: Any) -> Dataset:
    """csv, json (an array of objects), ndjson, jsonl or parquet, by suffix. A schema spares the inference pass.

    CSV takes ``header`` (true) and ``delimiter`` (comma); both hold however the file is read.
    """
    suffix = _suffix(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == "csv":
        df = reader.csv(path, header=options.get("header", True), sep=options.get("delimiter", ","), inferSchema=schema is None, timestampFormat=_TIMESTAMP)
    elif suffix in ("ndjson", "jsonl"):
        df = reader.json(path, mode="FAILFAST")
    elif suffix == "json":
        df = reader.json(path, multiLine=True, mode="FAILFAST")
    elif suffix == "parquet":
        df = reader.parquet(path)
    else:
        raise DataError(f"unsupported file format: {path}")
    return Dataset(name or path, df, {"source": path})


def load_parquet(spark: SparkSession, name: str, path: str) -> Dataset:
    return Dataset(name, spark.read.parquet(path), {"source": path})


def load_csv(spark: SparkSession, path: str, **options: Any) -> Dataset:
    if path.startswith(("http://", "https://")):
        path = fetch(path, options.pop("folder"), timeout_ms=options.pop("timeout_ms", 5000), retries=options.pop("retries", 0))
    return load(spark, path, **options)


def load_fixture(spark: SparkSession, folder: str, name: str, **options: Any) -> Dataset:
    """A file of a folder of fixtures, by its suffix as :func:`load`."""
    return load(spark, f"{folder.rstrip('/')}/{name}", name, **options)


def load_json_value(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """One row for each file with the file's value as VARIANT; text that is no JSON becomes `{"raw": text}`.

    An address is fetched into ``folder`` first, with ``timeout_ms`` and ``retries``, where HTTP is on.
    """
    if path.startswith(("http://", "https://")):
        path = fetch(path, options.pop("folder"), timeout_ms=options.pop("timeout_ms", 5000), retries=options.pop("retries", 0))
    text = spark.read.text(path, wholetext=True)
    raw = F.to_variant_object(F.struct(F.col("value").alias("raw")))
    return text.select(F.coalesce(F.try_parse_json("value"), raw).alias("value"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def load_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as multi-part outputs: no text, one file each."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    one = F.struct(name.alias("name"), F.lit("application/octet-stream").alias("mime_type"), F.col("length").alias("size"), "content")
    return files.select(F.struct(F.lit("").alias("primary_text"), F.array(one).alias("files"), F.create_map().cast("map<string,string>").alias("metadata")).cast(OUTPUT_TYPE).alias("output"))


def fetch(url: str, folder: str, timeout_ms: int = 5000, retries: int = 0) -> str:
    """Download to a file in ``folder``, which must be one that executors share; returns its path."""
    if os.environ.get(HTTP_GATE) != "1":
        raise DataError(f"HTTP is off; set {HTTP_GATE}=1")
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout_ms / 1000) as source:
                target = os.path.join(folder, url.rstrip("/").rsplit("/", 1)[-1] or "download")
                with open(target, "wb") as out:
                    while part := source.read(1 << 20):
                        out.write(part)
                return target
        except OSError:
            if attempt == retries:
                raise
            time.sleep(0.1 * (attempt + 1))
    raise AssertionError


class DatasetCache:
    """Datasets kept by path and options; a changed file is read again after :meth:`forget`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def load(self, path: str, **options: Any) -> Dataset:
        key = (path, tuple(sorted(options.items())))
        if key not in self.held:
            d = load(self.spark, path, **options)
            self.held[key] = d.over(d.df.persist())
        return self.held[key]

    def forget(self, path: str) -> None:
        for key in [k for k in self.held if k[0] == path]:
            self.held.pop(key).df.unpersist()
