"""Raw file registration, signature checks and page splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import sanitize_filename, stored_name


def register_files(spark: SparkSession, path: str, batch_id: str, glob: str = "*") -> DataFrame:
    """One row per raw file: content hash, size, type by extension, storage name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    sha = F.sha2("content", 256)
    name = F.regexp_extract("path", "[^/]+$", 0)
    return files.select(
        sha.alias("file_hash_sha256"),
        F.col("path").alias("source_path"),
        F.lit(batch_id).alias("batch_id"),
        sanitize_filename(name).alias("original_filename"),
        file_type(name).alias("file_type"),
        F.col("length").alias("file_size_bytes"),
        stored_name(sha, name).alias("storage_name"),
    ).withColumn("source_file_id", F.sha2(F.concat_ws("|", "batch_id", "source_path"), 256))


def file_type(name: Column) -> Column:
    """Kind of file by its extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (
        F.when(ext == "csv", "CSV")
        .when(ext.isin("xlsx", "xls"), "XLSX")
        .when(ext.isin("png", "jpg", "jpeg", "webp"), "IMAGE")
        .otherwise("PDF")
    )


def signature_verdict(content: Column, expected: Column) -> Column:
    """struct(is_valid, detected_mime, problem) from the leading bytes of a file."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    head = F.hex(F.substring(content, 1, 5))
    # Hex digits come in pairs; a NUL byte is a "00" that starts on an even digit.
    nul = F.hex(F.substring(content, 1, 1024)).rlike("^(?:[0-9A-F]{2})*?00")
    problem = (
        F.when(size == 0, "file is empty")
        .when(size > fixed.MAX_FILE_BYTES, "file exceeds 50 MB")
        .when((expected == "PDF") & (head != fixed.PDF_MAGIC_HEX), "missing PDF signature")
        .when((expected == "XLSX") & (F.left(head, F.lit(8)) != fixed.ZIP_MAGIC_HEX), "missing ZIP signature")
        .when((expected == "CSV") & nul, "NUL byte in text")
    )
    mime = (
        F.when((size == 0) | (size > fixed.MAX_FILE_BYTES), "unknown")
        .when(problem.isNotNull(), fixed.MIME_BYTES)
        .when(expected == "PDF", fixed.MIME_PDF)
        .when(expected == "XLSX", fixed.MIME_XLSX)
        .when(expected == "CSV", fixed.MIME_CSV)
        .otherwise(fixed.MIME_BYTES)
    )
    return F.struct(
        problem.isNull().alias("is_valid"), mime.alias("detected_mime"), problem.alias("problem")
    )


def split_pages(df: DataFrame, text: str, separator: str = "\f") -> DataFrame:
    """One row per page of a document text: adds ``page_no`` (from 1) and ``page_text``."""
    pages = F.split(F.col(text), F.lit("\\Q" + separator + "\\E"))
    return df.select("*", F.posexplode(pages).alias("_pos", "page_text")).select(
        *df.columns, (F.col("_pos") + 1).alias("page_no"), "page_text"
    )
