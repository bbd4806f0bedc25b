"""Incremental ingestion of register files and running a stream to a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import check_batch
from ..operators.records import canonical_records
from ..session import cut_lineage, work_folder
from ..sources.tabular import with_file_split, with_row_position


def ingest_files(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    table: str,
    checkpoint: str,
    mapping: Mapping[str, str] | None = None,
    metadata: Mapping[str, str] | None = None,
    batch_id: str = "stream",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Read new CSV files of a folder into a record table, checking every micro-batch.

    Each micro-batch overwrites its own partition of ``table``, so a retried
    one leaves no duplicates. ``columns`` is the header the files share.
    """
    schema = ", ".join(f"`{x}` string" for x in columns)
    rows = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )

    def store(batch: DataFrame, number: int) -> None:
        placed = with_row_position(batch).withColumnRenamed("source_path", "source_file_id")
        placed = placed.withColumn("batch_id", F.lit(batch_id))
        # The checks read the drafts several times, so they are stored once first.
        drafts = cut_lineage(canonical_records(placed, mapping, metadata), "drafts")
        checked = check_batch(drafts)
        checked.where(~F.col("dropped")).drop("dropped").write.mode("overwrite").parquet(
            f"{table}/micro_batch={number}"
        )

    return (
        with_file_split(rows)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table read as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    # A glob that matches only this table, whether it is one file or a folder of part files.
    pattern = f"{folder}/{name[:-1]}[{name[-1]}]"
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    )


def run_to_table(stream: DataFrame, purpose: str) -> DataFrame:
    """Process everything that is there now and return the rows written."""
    spark = stream.sparkSession
    base = work_folder(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
