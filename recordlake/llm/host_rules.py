"""Quality rules per document and per host.

Rule failures are counted by host, each host's failure rate is drawn towards the
rate of all hosts by a beta prior fitted to the hosts' rates, and hosts whose rate
remains too high take all their documents with them.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, cut_lineage, in_batches

c = F.col
SYMBOLS = "#*$%&|<>"


def measures(text: str | None, n: int = 5) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, lines equal to an earlier line, words in repeated ``n``-word windows).

    Words are cut at white space (see ``common.WHITE``); lines without a word do not count.
    """
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + n - max(i, end)
                end = i + n
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def document_rules(
    docs: DataFrame, least_words: int = 10, most_repeated: int = 20,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """doc_id, host, the five measures and base_failed: too few words, or more than ``most_repeated`` percent repeated."""
    narrow = docs.select(
        c(f"`{id_col}`").alias("doc_id"), c(f"`{text_col}`").cast("string").alias("text"), c(f"`{host_col}`").cast("string").alias("host")
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType(
        [narrow.schema["doc_id"], T.StructField("host", T.StringType())] + [T.StructField(x, T.LongType()) for x in names]
    )

    def rows(batches):
        for b in batches:
            for doc, text, host in zip(*(x.to_pylist() for x in b.columns), strict=True):
                yield doc, host, *measures(text)

    found = narrow.mapInArrow(lambda it: in_batches(schema, rows(it)), schema)
    failed = (c("n_words") < least_words) | (100 * c("n_repeat_words") > most_repeated * c("n_words"))
    return found.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, most_failing: float = 0.5) -> DataFrame:
    """host, n, n_failed, rate and failing for every host that is not null.

    The prior is the beta distribution with the mean and variance of the hosts'
    plain rates (every host counts once). If those do not vary, or vary more than a beta
    distribution can, a prior of one failure-or-pass in all is used at that mean. Only
    the two moments come to the driver.
    """
    hosts = judged.where(c("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), F.sum(c("base_failed").cast("long")).alias("n_failed")
    )
    mean, var = hosts.select((c("n_failed") / c("n")).alias("r")).agg(F.avg("r"), F.var_pop("r")).first()
    mean, var = mean or 0.0, var or 0.0
    size = mean * (1 - mean) / var - 1 if var > 0 else 1.0
    size = size if size > 0 else 1.0
    rate = (c("n_failed") + mean * size) / (c("n") + size)
    return hosts.withColumn("rate", rate).withColumn("failing", c("rate") > most_failing)


def apply_rules(
    docs: DataFrame, most_failing: float = 0.5, least_words: int = 10, most_repeated: int = 20,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """Per document: doc_id, host, measures, base_failed, host_rate, kept.

    A document is kept when it passes its own rules and its host is not failing. Without a
    host only its own rules count. Null and empty texts have no words and fail. Every
    repeated row is judged, and counts for its host. No document: no row. Hosts are
    pre-aggregated before the shuffle; verdicts come back by a join whose document
    side the engine may split, so one host may hold any share of the rows.
    """
    judged = cut_lineage(document_rules(docs, least_words, most_repeated, id_col, text_col, host_col), "judged")
    hosts = host_verdicts(judged, most_failing).select("host", c("rate").alias("host_rate"), "failing")
    return judged.join(hosts, "host", "left").withColumn(
        "kept", ~c("base_failed") & ~F.coalesce("failing", F.lit(False))
    ).drop("failing")
