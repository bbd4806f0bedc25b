"""A stored inverted index: postings by term, built once, added to batch by batch, searched by BM25, by tf-idf and by phrase.

An index is a folder with two tables. ``postings`` has one row per term and document with the term's
places in the text, partitioned by a bucket of the term; ``texts`` has the number of words of each document.
Both are partitioned by ``batch`` too. Only the buckets of the searched terms are read, and within
these the row groups that may hold them, as every file is sorted by term.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import cut_lineage
from .similarity import tokens

c = F.col

BUCKETS = 64
# The constants of the BM25 score.
K1, B = 1.2, 0.75
#: Tasks that share the postings of one bucket of a batch, so a term of every document is split.
SPLITS = 4


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def term_places(words: Column) -> Column:
    """array<struct(term, places)> of the words of one text: places sorted by term and cut where the term changes."""

    def cut(found: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(found) - 1)
        first = F.filter(at, lambda i: (i == 0) | (F.get(found, i)["term"] != F.get(found, i - 1)["term"]))

        def of_term(starts: Column) -> Column:
            def entry(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(found))
                places = F.transform(F.slice(found, start + 1, end - start), lambda x: x["place"])
                return F.struct(F.get(found, start)["term"].alias("term"), places.alias("places"))

            return F.transform(starts, entry)

        return let(first, of_term)

    def of_text(every: Column) -> Column:
        placed = F.transform(every, lambda w, i: F.struct(w.alias("term"), i.alias("place")))
        return F.when(F.size(every) > 0, let(F.sort_array(placed), cut))

    return let(words, of_text)


def add_batch(docs: DataFrame, path: str, batch: str, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, splits: int = SPLITS) -> None:
    """Add the documents of a batch, or replace the batch of that name; other batches are not touched.

    Words are those of the token search. Places count from 0. A document without words is
    counted and has no postings. Ids must be unique over all batches.
    """
    # Texts are read once. The postings of a text are made in its row, so they are all that is exchanged.
    found = docs.select(c(doc_id).alias("doc_id"), term_places(tokens(c(text))).alias("found"))
    found = cut_lineage(found, "term-places")
    n_words = F.aggregate("found", F.lit(0), lambda n, x: n + F.size(x["places"]))
    texts = found.select("doc_id", F.coalesce(n_words, F.lit(0)).alias("n_words"))
    texts.write.mode("overwrite").parquet(f"{path}/texts/batch={batch}")
    postings = found.select("doc_id", F.inline("found"))
    postings = postings.select("term", "doc_id", F.size("places").alias("tf"), "places", bucket_of(c("term"), buckets).alias("bucket"))
    split = F.pmod(F.xxhash64("doc_id"), F.lit(splits)).cast("int")
    # Every split of a bucket is a task of its own; by hash, some tasks had several and others none.
    dealt = postings.repartitionById(buckets * splits, c("bucket") * splits + split).sortWithinPartitions("bucket", "term", "doc_id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")


class Index:
    """An index to search; ``batches`` limits it to some of its batches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, batches: Sequence[str] | None = None) -> None:
        self.buckets = buckets
        texts = spark.read.parquet(f"{path}/texts").withColumn("batch", c("batch").cast("string"))
        postings = spark.read.parquet(f"{path}/postings").withColumn("batch", c("batch").cast("string"))
        if batches is not None:
            texts, postings = (x.where(c("batch").isin([str(b) for b in batches])) for x in (texts, postings))
        self.texts, self.all_postings = texts, postings

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """Postings of the terms: reads their buckets only."""
        buckets = sorted({_bucket(t, self.buckets) for t in terms})
        return self.all_postings.where(c("bucket").isin(buckets) & c("term").isin(list(terms)))

    def _weighted(self, terms: Sequence[str]) -> tuple[DataFrame, Column, Column]:
        found = self.postings(terms)
        per_term = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        # One entry per searched term.
        frequencies = per_term.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
        totals = self.texts.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean")))
        marked = found.withColumns({"_df": frequencies.scalar(), "_all": totals.scalar()})
        return marked, F.try_element_at("_df", c("term")), c("_all")

    def tf_idf(self, terms: Sequence[str]) -> DataFrame:
        """(doc_id, n_terms, score) of documents with any of the terms, as by scanning the texts."""
        found, df, every = self._weighted(_terms(terms))
        weight = F.log((1 + every["n"]) / (1 + df))
        return found.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_terms"), F.sum(c("tf") * weight).alias("score"))

    def bm25(self, terms: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
        """(doc_id, n_terms, score): rare terms count more, repeated ones less and less, long documents less."""
        found, df, every = self._weighted(_terms(terms))
        idf = F.log(1 + (every["n"] - df + 0.5) / (df + 0.5))
        sized = found.select("doc_id", "tf", idf.alias("idf"), every["mean"].alias("mean")).join(self.texts.select("doc_id", "n_words"), "doc_id")
        part = c("idf") * c("tf") * (k1 + 1) / (c("tf") + k1 * (1 - b + b * c("n_words") / c("mean")))
        return sized.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_terms"), F.sum(part).alias("score"))

    def phrase(self, words: Sequence[str]) -> DataFrame:
        """(doc_id, n_matches, first_place) of documents that hold the words one behind the other.

        Every place of the i-th word votes for the phrase beginning i places before; where all words vote, it is there.
        """
        words = [w.lower() for w in words]
        if not words:
            raise ValueError("a phrase needs a word")
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        found = self.postings(sorted(at))
        offsets = F.create_map(*(x for w, places in at.items() for x in (F.lit(w), F.array(*map(F.lit, places)))))
        starts = found.select("doc_id", F.explode(F.try_element_at(offsets, c("term"))).alias("i"), "places")
        votes = starts.select("doc_id", F.explode("places").alias("place"), "i").select("doc_id", (c("place") - c("i")).alias("start"))
        whole = votes.groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("n")).where(c("n") == len(words))
        return whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matches"), F.min("start").alias("first_place"))


def _terms(terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in terms))
