"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.stage import stage_folder, staged

__all__ = ["keyed_text", "local_path", "shared_folder", "staged", "text_batches", "typed_ids",
           "union_all", "worded_ids"]


def keyed_text(raw_pages: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; page text null becomes empty. Other columns never clash."""
    picked = [
        F.coalesce(F.col(c), F.lit("")).alias(c) if c == "page_text" else F.col(c)
        for c in columns
    ]
    return raw_pages.select(*picked)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def shared_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def local_path(uri: str):
    """(file system, path) of a shared folder; works on file, hdfs and object store addresses."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_batches(
    batches: Iterator[pa.RecordBatch], limit: int = 4 << 20
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, UTF-8 bytes of all their page texts, offset of each text) in pieces of about ``limit``.

    A single longer text comes alone and whole.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("page_text")).cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[
            column.offset:column.offset + len(column) + 1
        ] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(column))
            yield (batch.slice(first, last - first), data[at[first]:at[last]],
                   at[first:last + 1] - at[first])
            first = last


def worded_ids(frame: DataFrame, *names: str) -> DataFrame:
    """Ids as text: pandas keeps text beside nulls as it is, where whole numbers become floats."""
    return frame.withColumns({name: F.col(name).cast("string") for name in names})


def typed_ids(frame: DataFrame, **like: DataFrame) -> DataFrame:
    """Ids back in the type that the named column of an input has."""
    return frame.withColumns({
        name: F.col(name).cast(source.schema[name].dataType) for name, source in like.items()})
