"""The corpus pipeline: documents that survive each stage go on, and the last stage packs them for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.llm import decontaminate, line_dedup, near_duplicates, packing, resampling
from recordlake.llm.common import cut_lineage, short_batches, table
from recordlake.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling; documents that are not drawn go."""
    short_batches(spark)
    model = resampling.fit(docs, resampling.judgements(table(spark, sf_dir, "labels")))
    out, how = resampling.resample(docs, model)
    return out.where(how["selected"]).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated over documents are taken out of all but the last; n_chars follows where it is there."""
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity 0.8)."""
    return near_duplicates.drop_near_duplicates(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in windows of 2048 ids; workers that ran the stages before keep few words."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=1, keep_pieces=200_000)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_copies),
    ("decontamination", benchmark),
    ("packing", packed),
]

#: The first stage counts and draws with hashes, the third compares sets found by hashes: not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
