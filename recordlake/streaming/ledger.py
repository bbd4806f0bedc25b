"""Ingestion that takes every file content once, whatever it is called and however often it is delivered.

A record table has two folders. ``files`` is the ledger: one row per delivered file with
the hash of its content and what became of it. ``records`` holds the rows. Both are partitioned
by micro-batch. A micro-batch writes its records first and its part of the ledger last; only
records of micro-batches with a finished part of the ledger count. So a micro-batch that was cut off
leaves nothing behind that readers see, and its repetition overwrites its own folders alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import blank_to_null, normalize_id_code
from ..operators.keyed import attach_by_key, key_stats
from ..operators.quality import STORED_ID, check_batch
from ..operators.records import canonical_records
from ..session import cut_lineage
from ..sources.tabular import read_delimited
from .progress import counted

c = F.col

#: What becomes of a delivered file.
STORED, SAME_CONTENT = "STORED", "SAME_CONTENT"
LEDGER = "source_path string, file_hash_sha256 string, file_size_bytes bigint, outcome string, first_path string, n_records bigint"
_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def _partitions(spark: SparkSession, path: str, done: bool) -> list[int]:
    """Numbers of the micro-batches with a folder below ``path``; ``done``: with a finished one."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("micro_batch=")]
    return sorted(
        int(p.getName().split("=")[1]) for p in found if not done or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    )


def _read(spark: SparkSession, path: str, numbers: list[int], schema: T.StructType | None = None) -> DataFrame | None:
    if not numbers:
        return None
    reader = spark.read.option("basePath", path)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.parquet(*[f"{path}/micro_batch={n}" for n in numbers])


def ledger(spark: SparkSession, table: str) -> DataFrame:
    """Delivered files of all finished micro-batches: see ``LEDGER``, and ``micro_batch``."""
    schema = T._parse_datatype_string(f"{LEDGER}, micro_batch int")
    found = _read(spark, f"{table}/files", _partitions(spark, f"{table}/files", True), schema)
    return spark.createDataFrame([], schema) if found is None else found


def stored_records(spark: SparkSession, table: str) -> DataFrame:
    """Records of all finished micro-batches."""
    done = _partitions(spark, f"{table}/files", True)
    found = _read(spark, f"{table}/records", sorted(set(done) & set(_partitions(spark, f"{table}/records", False))))
    if found is None:
        raise FileNotFoundError(f"no finished micro-batch in {table}")
    return found


def new_contents(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """Arrived files with ``outcome`` and ``first_path``: of each content not in ``known``, the first path is to be stored.

    ``arrived`` has source_path, file_hash_sha256 and file_size_bytes; ``known`` file_hash_sha256 and first_path.
    """
    before = known.groupBy("file_hash_sha256").agg(F.min("first_path").alias("_known"))
    here = arrived.groupBy("file_hash_sha256").agg(F.min("source_path").alias("_here"))
    firsts = here.join(before, "file_hash_sha256", "left")
    judged = arrived.join(firsts, "file_hash_sha256")
    fresh = c("_known").isNull() & (c("source_path") == c("_here"))
    return judged.select(
        "source_path", "file_hash_sha256", "file_size_bytes",
        F.when(fresh, STORED).otherwise(SAME_CONTENT).alias("outcome"), F.coalesce("_known", "_here").alias("first_path"),
    )


_STORED_ORDER = ("micro_batch", "ingest_seq", "source_file_id", "record_id")


def _id_key() -> Column:
    return F.upper(blank_to_null(normalize_id_code(c("id_code"))))


def checked_against_store(drafts: DataFrame, stored: DataFrame | None) -> DataFrame:
    """A batch with its rules checked, and against the records stored before it.

    An id code that is stored already makes a record a DUPLICATE of the first record stored with it, in ``duplicate_of``, and
    gives it one more issue; the stored record stays as it is. Of the store only ids and positions are read.
    """
    checked = check_batch(drafts).where(~c("dropped")).drop("dropped")
    none = F.lit(None).cast("string")
    if stored is None:
        return checked.withColumn("duplicate_of", none)
    # Repeats within the batch are flagged by its rules; here only stored records count.
    new = checked.withColumn("_key", _id_key())
    held = stored.select(_id_key().alias("_key"), F.struct(*_STORED_ORDER).alias("_at")).join(
        new.select("_key").where(c("_key").isNotNull()).distinct(), "_key", "left_semi"
    )
    firsts = key_stats(held, ["_key"], {"_first": F.min("_at")["record_id"]})
    joined = attach_by_key(new, firsts, ["_key"], ["_first"], ["record_id"])
    issue = F.struct(
        F.lit(STORED_ID).alias("code"), F.lit("id_code").alias("field"), F.lit("WARNING").alias("severity"),
        F.lit(1.0).alias("confidence"), F.concat(F.lit("id code "), c("id_code"), F.lit(" is stored as "), c("_first")).alias("message"),
    )
    repeated = c("_first").isNotNull()
    changed = {
        "status": F.when(repeated, "DUPLICATE").otherwise(c("status")),
        "issues": F.when(repeated, F.array_append("issues", issue)).otherwise(c("issues")),
    }
    return joined.select(*[changed.get(x, c(x)).alias(x) for x in checked.columns], c("_first").alias("duplicate_of"))


def store_files(
    arrived: DataFrame, number: int, table: str,
    mapping: Mapping[str, str] | None = None, metadata: Mapping[str, str] | None = None, batch_id: str = "stream",
) -> None:
    """Store one micro-batch of files (source_path, file_hash_sha256, file_size_bytes); repeating it gives the same table."""
    spark = arrived.sparkSession
    done = [n for n in _partitions(spark, f"{table}/files", True) if n < number]
    schema = T._parse_datatype_string(f"{LEDGER}, micro_batch int")
    before = _read(spark, f"{table}/files", done, schema)
    if before is None:
        before = spark.createDataFrame([], schema)
    files = cut_lineage(new_contents(arrived, before), "arrived-files")
    # As many paths as the source admits to a micro-batch.
    paths = [r.source_path for r in files.where(c("outcome") == STORED).select("source_path").collect()]
    counts = spark.createDataFrame([], "source_path string, n bigint")
    if paths:
        rows = read_delimited(spark, sorted(paths)).withColumnRenamed("source_path", "source_file_id")
        # A file is read by one task; its rows are then dealt to all, as records cost far more than reading.
        rows = rows.repartition("source_file_id", "ingest_seq")
        # The checks read the drafts several times, so they are stored once first.
        drafts = cut_lineage(canonical_records(rows.withColumn("batch_id", F.lit(batch_id)), mapping, metadata), "drafts")
        held = sorted(set(done) & set(_partitions(spark, f"{table}/records", False)))
        stored = _read(spark, f"{table}/records", held)
        place = f"{table}/records/micro_batch={number}"
        checked_against_store(drafts, stored).write.mode("overwrite").parquet(place)
        counts = spark.read.parquet(place).groupBy(c("source_file_id").alias("source_path")).agg(F.count(F.lit(1)).alias("n"))
    told = files.join(counts, "source_path", "left")
    told.withColumn("n_records", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n").write.mode("overwrite").parquet(
        f"{table}/files/micro_batch={number}"
    )


def ingest_once(
    spark: SparkSession, folder: str, table: str, checkpoint: str,
    mapping: Mapping[str, str] | None = None, metadata: Mapping[str, str] | None = None,
    batch_id: str = "stream", files_per_batch: int = 1000,
) -> StreamingQuery:
    """Read the CSV files that are new in a folder into a record table, each content once.

    Files are known by the hash of their content: a copy under another name, or delivered again, adds a line to the
    ledger and no record. The files of a micro-batch share one header. Hashes are made on the executors, and
    file contents go no further than that. A :class:`ProgressListener` sees the files and bytes of every micro-batch. A record whose id code was stored by an earlier micro-batch is a DUPLICATE.
    """
    found = (
        spark.readStream.format("binaryFile").schema(_BINARY)
        .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    arrived = found.select(
        c("path").alias("source_path"), F.sha2("content", 256).alias("file_hash_sha256"), c("length").alias("file_size_bytes")
    )
    arrived = counted(arrived, "files", n_bytes="file_size_bytes")
    return (
        arrived.writeStream.foreachBatch(lambda batch, number: store_files(batch, number, table, mapping, metadata, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
