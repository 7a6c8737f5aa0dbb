"""Intermediate tables written to shared storage, so work is done once and survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIR = "spark.checkpoint.dir"
# A Java virtual machine only compiles methods of up to this many bytes. One method for a whole stage of
# wide expressions is longer and would be interpreted; Spark then makes several short ones.
_METHOD_LIMIT, _COMPILED = "spark.sql.codegen.hugeMethodLimit", "8000"
# A stage dealt by size starts with so many shuffle partitions, whatever the session's number is; adaptive execution
# joins neighbours up to this size and files are read in parts of that: tasks become more with the input, not larger.
PARTITIONS, PARTITION_BYTES, FILE_BYTES = 1024, 8 << 20, 32 << 20
_FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_FILE_PARTS = "spark.sql.files.maxPartitionBytes"
# What is broadcast goes through the driver. A few columns of a compressed file count as a few bytes a row, however long
# their ids are, so millions of rows would pass for small. Only sizes measured at a shuffle decide.
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
_MEASURED_BROADCAST = "spark.sql.adaptive.autoBroadcastJoinThreshold"
# Shuffle files are removed once the write that made them has ended, not when the driver next collects garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Ids are digests in hex, of which this codec needs half the bytes.
_CODEC, _DENSE = "spark.sql.parquet.compression.codec", "zstd"

# Folders staged within the innermost ``scratch``; none are noted outside of one.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stage_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a session inside one process (``local``, ``local[n]``), as in tests, may fall back to a
    folder of its own; executors in processes of their own never share it.
    """
    folder = spark.conf.get(_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_DIR} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="ledgerloom-stage-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of a schema, known as such to the optimizer: joins with it are not run, nor any Python task."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).select(*columns).filter(F.lit(False))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the writes within."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_settings(spark: SparkSession) -> dict[str, str]:
    """Settings of a write that leaves no shuffle files behind and broadcasts by measured size only."""
    asked = spark.conf.get(_MEASURED_BROADCAST, None) or spark.conf.get(_BROADCAST)
    return {_METHOD_LIMIT: _COMPILED, _CLEANED: "true", _CODEC: _DENSE, _BROADCAST: "-1", _MEASURED_BROADCAST: asked}


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are removed at the end: by then, all that is made of them has to be written."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for folder in made:
            _remove(spark, folder)


def drop_staged(table: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more; other tables are left alone."""
    spark = table.sparkSession
    name = re.compile(re.escape(stage_folder(spark).removeprefix("file:").rstrip("/")) + r"/[^/]+-[0-9a-f]{32}\Z")
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if name.search(folder):
            _remove(spark, folder)


def staged(df: DataFrame, name: str, by_size: bool = False) -> DataFrame:
    """Write a frame as Parquet under a fresh path and read it back with its own schema.

    ``by_size``: the shuffles of this write have as many partitions as their size asks for.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    wanted = write_settings(spark)
    if by_size:
        wanted |= {_FIRST: str(PARTITIONS), _ADVISED: f"{PARTITION_BYTES}b", _FILE_PARTS: f"{FILE_BYTES}b"}
    with settings(spark, wanted):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
