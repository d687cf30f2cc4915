"""Places and names that several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terrace.sources.folders import shared_folder as shared_dir


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of what runs inside as soon as it has ended: its result lies elsewhere."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads survive lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    with released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing reads any more."""
    for t in tables:
        removed(t.sparkSession, t._folder)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Put bounded ``data`` where every worker can map it; returns the name for ``SparkFiles.get``.

    The file is written through Hadoop's file system into the shared folder, from which each executor, late ones too,
    fetches its own copy.
    """
    folder = shared_dir(spark, name)
    unique = folder.rsplit("/", 1)[1] + ".bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{unique}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return unique


def count_slices(spark: SparkSession) -> int:
    """Partitions to deal rows to: as many as the session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` and the columns of ``ddl`` after it."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
