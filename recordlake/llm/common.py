"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, work_folder

__all__ = ["ASCII_LOWER", "WHITE", "cut_lineage", "fresh", "give_back", "id_and_text", "in_batches", "short_batches", "sole", "table", "text_key", "work_folder"]

#: The white space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\v\f\r"
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark, rows: int = 2000) -> None:
    """Long texts: let the session send at most ``rows`` rows to Python at once, which keeps executors and their workers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) < 1:
        spark.conf.set(key, rows)


_in_use: list[dict] = []


def sole(cache: dict) -> dict:
    """The cache, once those of other operators in this worker are emptied: workers go on from one operator to the next."""
    if not _in_use or _in_use[0] is not cache:
        for other in _in_use:
            other.clear()
        if _in_use:
            give_back()
        _in_use[:] = [cache]
    return cache


def give_back() -> None:
    """Return freed memory of this process to the machine, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it decides itself


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have in any case of letters."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` and ``text``."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_key(text: str = "text") -> Column:
    """Tells rows apart that share an id; rows equal in both are the same document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def in_batches(schema: T.StructType, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of the given Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(arrow, held)
            held = []
    if held:
        yield _batch(arrow, held)


def _batch(arrow: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=f.type) for values, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow
    )
