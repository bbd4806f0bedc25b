"""Delimited register files: preview, reading, row positions, header layouts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import canonical_records, suggest_mapping

POSITION = "ingest_seq"


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True, sep: str = ","
) -> DataFrame:
    """All columns as trimmed text, blank lines skipped, plus ``source_path`` and ``ingest_seq``.

    Every file must have the same header; a differing one raises instead of
    shifting values (see :func:`read_layouts` for mixed headers). With
    ``multi_line`` a quoted cell may hold line breaks, but a file is then one
    task; turn it off to split very large files.
    """
    raw = (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("sep", sep)
        .csv(paths)
    )
    return with_row_position(with_file_split(raw))


def with_file_split(raw: DataFrame) -> DataFrame:
    """Add the file and the file split each row was read from."""
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("_split"),
    )


def with_row_position(split_rows: DataFrame) -> DataFrame:
    """1-based position of each row in its file, from file splits instead of a global sort."""
    placed = split_rows.withColumn("_row", F.monotonically_increasing_id())
    splits = placed.groupBy("source_path", "_split").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy("source_path").orderBy("_split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.select(
        "source_path", "_split", "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    # One row per file split: small, so adaptive execution broadcasts it by its measured size.
    joined = placed.join(offsets, ["source_path", "_split"])
    position = (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias(POSITION)
    kept = [x for x in split_rows.columns if x not in ("source_path", "_split")]
    return joined.select(*[F.col(f"`{x}`") for x in kept], "source_path", position)


@dataclass(frozen=True)
class Preview:
    headers: list[str]
    sample: DataFrame
    rows: int
    mapping: dict[str, str]


def preview(spark: SparkSession, path: str, sample_rows: int = 5) -> Preview:
    """Headers, first rows, row count and suggested mapping of one file."""
    df = read_delimited(spark, path)
    headers = [c for c in df.columns if c not in ("source_path", POSITION)]
    sample = df.where(F.col(POSITION) <= sample_rows).orderBy(POSITION).select(headers)
    return Preview(headers, sample, df.count(), suggest_mapping(headers))


# ----------------------------------------------------------- mixed layouts
def header_lines(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, header) of every file, read on the executors without reading the files."""
    paths = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path")
    )

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pyarrow import fs

        for batch in batches:
            headers = []
            for path in batch["path"]:
                store, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1)
                                                      if path.startswith("file:/") and not path.startswith("file:///")
                                                      else path)
                with store.open_input_stream(inner) as stream:
                    text = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace")
                    headers.append(next((line.strip("\r\n") for line in text if line.strip()), ""))
            yield pd.DataFrame({"path": batch["path"], "header": headers})

    return paths.mapInPandas(first_lines, "path string, header string")


@dataclass(frozen=True)
class Layout:
    """Files that share one header, how to map it and what their batch is called."""

    paths: Sequence[str]
    mapping: Mapping[str, str] = field(default_factory=dict)
    metadata: Mapping[str, str] = field(default_factory=dict)
    batch_id: str | None = None


def find_layouts(spark: SparkSession, folder: str, **defaults) -> list[Layout]:
    """One layout per distinct header line in a folder (file paths only reach the driver)."""
    by_header: dict[str, list[str]] = {}
    for row in header_lines(spark, folder).toLocalIterator():
        by_header.setdefault(row["header"], []).append(row["path"])
    return [Layout(sorted(paths), **defaults) for _, paths in sorted(by_header.items())]


def read_layouts(spark: SparkSession, layouts: Sequence[Layout]) -> DataFrame:
    """Records of many files with different headers, one scan per distinct header."""
    out = None
    for layout in layouts:
        rows = read_delimited(spark, list(layout.paths))
        rows = rows.withColumnRenamed("source_path", "source_file_id")
        rows = rows.withColumn("batch_id", F.lit(layout.batch_id).cast("string"))
        part = canonical_records(rows, layout.mapping, layout.metadata)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no layouts given")
    return out
