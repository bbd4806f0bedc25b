"""A table of records with their history: from when to when each state was valid, and what was true at any time.

A history is a folder. ``data/version=v/bucket=b`` holds the states of the keys of one bucket as the change number v
left them, ``manifest/version=v`` tells which of these folders make up version v. A change rewrites the buckets of
its keys only and writes its manifest last, so a change that was cut off leaves the version before in force, and
earlier versions stay readable. Changes are applied one at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col

BUCKETS = 64
#: Tasks that share a bucket when it is written, so that a key with most of the states is split.
SPLITS = 4
_MANIFEST = "version int, bucket int, folder int, buckets int"


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing was applied so far


def _folders(spark: SparkSession, path: str, version: int | None = None, buckets: int | None = None) -> tuple[int, dict[int, int]]:
    """The version and bucket -> number of the folder that holds it; one entry per bucket."""
    stated = _versions(spark, path)
    if stated is None:
        return 0, {}
    last = stated.agg(F.max("version")).first()[0] or 0
    if version is not None and not 1 <= version <= last:
        raise ValueError(f"no version {version}: the last is {last}")
    at = last if version is None else version
    rows = stated.where(c("version") == at).collect()
    if buckets is not None and any(r.buckets != buckets for r in rows):
        raise ValueError(f"this history has {rows[0].buckets} buckets")
    return at, {r.bucket: r.folder for r in rows}


def _read(spark: SparkSession, path: str, folders: dict[int, int], schema: T.StructType | None = None) -> DataFrame:
    paths = [f"{path}/data/version={f}/bucket={b}" for b, f in sorted(folders.items())]
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def _valid_to(states: DataFrame, key: str) -> DataFrame:
    """The next state's beginning: looked up within a day, then among the days of a key, so no key is one task's work."""
    dated = states.withColumn("_day", F.date_trunc("day", "valid_from"))
    in_day = Window.partitionBy(key, "_day").orderBy("valid_from")
    later = dated.withColumn("_next", F.lead("valid_from").over(in_day))
    days = dated.groupBy(key, "_day").agg(F.min("valid_from").alias("_start"))
    following = days.select(key, "_day", F.lead("_start").over(Window.partitionBy(key).orderBy("_day")).alias("_later"))
    joined = later.join(following, [key, "_day"])
    return joined.select(*states.columns, F.coalesce("_next", "_later").alias("valid_to"))


def apply_changes(
    changes: DataFrame, path: str, key: str, at: str, deleted: Column | None = None, buckets: int = BUCKETS, splits: int = SPLITS
) -> int:
    """Apply a table of changes, each the whole state of ``key`` from the time ``at`` on; returns the new version.

    Changes may come late, before states already stored. Of two states of one key and time the later version's
    holds, within one table that of the greater columns, left to right; so applying changes again alters nothing but
    the version. Rows where ``deleted`` is true end the record. A null key or time is an error. An empty table of
    changes makes no version. All tables of changes must have the same columns, and one history the same ``buckets``.
    """
    spark = changes.sparkSession
    version, folders = _folders(spark, path, buckets=buckets)
    values = [x for x in changes.columns if x not in (key, at)]
    clash = {"valid_from", "valid_to", "deleted", "version", "bucket"} & {x.lower() for x in [*values, key]}
    if clash:
        raise ValueError(f"columns {sorted(clash)} have a meaning of their own here")

    def stated(name: str, kind: str) -> Column:
        return F.coalesce(c(f"`{name}`"), F.raise_error(F.lit(f"a change without {name}")).cast(kind)).cast(kind)

    new = changes.select(
        stated(key, changes.schema[key].dataType.simpleString()).alias(key),
        stated(at, "timestamp").alias("valid_from"),
        F.coalesce(deleted if deleted is not None else F.lit(False), F.lit(False)).alias("deleted"),
        F.lit(version + 1).alias("version"),
        *[c(f"`{v}`") for v in values],
    ).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    # at most one row per bucket
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    if not touched:
        return version
    states = new
    held = {b: folders[b] for b in touched if b in folders}
    if held:
        schema = T.StructType([f for f in new.schema.fields if f.name != "bucket"] + [T.StructField("valid_to", T.TimestampType())])
        old = _read(spark, path, held, schema).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        states = old.select(*new.columns).unionByName(new)
    rest = F.struct("version", *[f"`{v}`" for v in values], "deleted")
    last = states.groupBy("bucket", key, "valid_from").agg(F.max(rest).alias("_s"))
    once = last.select("bucket", key, "valid_from", "_s.*").select(*new.columns)
    split = F.pmod(F.xxhash64(key, "valid_from"), F.lit(splits))
    out = _valid_to(once, key).repartition(len(touched) * splits, "bucket", split).sortWithinPartitions("bucket", key, "valid_from")
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version + 1}")
    listed = [(b, f, buckets) for b, f in (folders | dict.fromkeys(touched, version + 1)).items()]
    spark.createDataFrame(listed, "bucket int, folder int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version + 1}")
    return version + 1


def history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All states with valid_from, valid_to (null: still valid) and deleted, as a version had them."""
    at, folders = _folders(spark, path, version)
    if not at:
        raise ValueError(f"no history at {path}")
    return _read(spark, path, folders)


def as_of(spark: SparkSession, path: str, time: str, version: int | None = None) -> DataFrame:
    """The records as they were at a time: a filter that reaches the scan, no exchange."""
    states = history(spark, path, version)
    moment = F.lit(time).cast("timestamp")
    valid = (c("valid_from") <= moment) & (c("valid_to").isNull() | (c("valid_to") > moment)) & ~c("deleted")
    return states.where(valid)
