"""Periodic runs of words by an online sparse diagonal dynamic program.

A run is a stretch of words that repeats with some smallest period q at least ``times``
times and cannot be extended. On the diagonal of lag q the words of a run match those
q before them; the program moves over the words, lets earlier occurrences lengthen the
matches of their lags, and emits a run at the word where its diagonal ends.

What keeps it sparse: a word opens lag d only if d is the distance to the *nearest*
earlier place where the same w words begin, with w the power of two in [d, 2d). No run is
lost: were there a nearer place for w >= d words inside a run of smallest period d, the run
would have a smaller period (two periods d' < d over d + d' words have their common
divisor as period). By the same argument a stretch of constant nearest lag d of
sufficient length is extended as far as it goes and has no smaller period. So one diagonal per
power of two is active at a time, and a text of n words takes O(n log n) steps however often
its words occur. Windows of w words are numbered by pairs of windows of w / 2 words, exactly,
and only where both recur in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import word_arrays
from .common import fresh

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def nearest_lags(ids: np.ndarray, bounds: np.ndarray, times: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(w, positions, lags) for w = 1, 2, 4 ...: where the next w words begin at most w and more than w / 2 words before, nearest first."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    pos, rank, width = np.arange(len(ids)), ids.astype(np.int64), 1
    number = np.full(len(ids), -1, dtype=np.int64)
    while len(pos):
        order = np.argsort(rank, kind="stable")
        r, p = rank[order], pos[order]
        equal = r[1:] == r[:-1]
        same = equal & (text[p[1:]] == text[p[:-1]])
        lag = np.where(same, p[1:] - p[:-1], 0)
        take = (lag > width // 2) & (lag <= width)
        at, d = p[1:][take], lag[take]
        order = np.argsort(at)
        yield width, at[order], d[order]
        again = np.zeros(len(p), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        dense = np.concatenate([[0], np.cumsum(~equal)])
        number[p[again]] = dense[again]
        # a run of a lag above w needs ``times`` times as many words
        left = np.sort(p[again & (sizes[text[p]] >= times * (width + 1))])
        left = left[left + width < bounds[text[left] + 1]]
        pos = left[number[left + width] >= 0]
        rank = number[pos] * (dense[-1] + 1) + number[pos + width]
        number[p[again]] = -1
        width *= 2


def emit_runs(width: int, at: np.ndarray, lags: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the diagonals that ended with enough words, word after word."""

    def ended():
        words = matched + width - 1 + lag  # matched windows cover the words behind the first period
        if lag and words >= max(least, times * lag):
            yield last - matched + 1 - lag, words, lag

    last, lag, matched = -2, 0, 0
    for i, d in zip(at.tolist(), lags.tolist(), strict=True):
        if d == lag and i == last + 1:
            matched += 1
        else:
            yield from ended()
            lag, matched = d, 1
        last = i
    yield from ended()


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """All runs of texts given as word numbers: rows of place, length and period, by place, then period."""
    if times < 3:
        raise ValueError("runs of less than three periods are not found by nearest lags")
    found = [r for width, at, d in nearest_lags(ids, bounds, times) for r in emit_runs(width, at, d, least, times)]
    out = np.array(found, dtype=np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _part(texts: pa.Array, least: int, times: int) -> pa.RecordBatch:
    words, bounds = word_arrays.split(texts, word_arrays.not_white)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    runs = runs_of(ids, bounds, least, times)
    place = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    gone = np.zeros(len(ids) + 1, dtype=np.int64)  # +1 where a stretch of repetitions begins, -1 behind it
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(gone[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds].astype(np.int32)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), words.filter(pa.array(keep))), " ")
    columns = [pa.array(runs[:, 0] - bounds[place]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
    structs = pa.StructArray.from_arrays(columns, names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], bounds).astype(np.int32)), structs)
    return pa.RecordBatch.from_arrays([pa.array(np.diff(bounds)), lists, text.cast(pa.string())], names=["n", "runs", "text"])


def find(
    docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Per document: doc_id, n_words, runs, collapsed_text.

    ``runs`` lists (start, length, period) in words, by start, then period; a run has at
    least ``least`` words and ``times`` periods. The collapsed text has each run's first period
    only: the words no run repeats, joined by one blank. Null and empty texts have no
    words and no runs, and an empty collapsed text. Repeated rows and null ids are each
    searched; other columns are not read. No document: no row. Each text is searched
    whole, in memory that grows with its length; nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType())]
        + [T.StructField("runs", T._parse_datatype_string(f"array<{RUN}>"))]
        + [T.StructField("collapsed_text", T.StringType())] * with_text
    )
    arrow = to_arrow_schema(schema)

    def searched(batches):
        for b in batches:
            for begin, end in word_arrays.slices(b.column(1)):
                part = _part(b.column(1).slice(begin, end - begin), least, times)
                columns = [b.column(0).slice(begin, end - begin), *part.columns[: 2 + with_text]]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    given = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return given.mapInArrow(searched, schema)


def top_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period. Null without runs."""
    first = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("period"))
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.when(F.size(runs) > 0, F.aggregate(runs, first, better))


def with_loops(docs: DataFrame, every: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the ends of some texts turned into repetitions, chosen and placed by the crc32 of the id.

    With h the checksum of the decimal id and g = h / ``every`` rounded down, a text of n > 0 words with
    h divisible by ``every`` keeps its first a = g % n words; the rest repeats those from a on with
    period 1 + (n - a) / (3 + g % 8), rounded down. Such a text is its words joined by blanks. Other texts,
    null ids and null texts stay.
    """
    from ..functions.text import let

    text, h = F.col(f"`{text_col}`").cast("string"), F.crc32(F.col(f"`{id_col}`").cast("string"))
    g = F.floor(h / every).cast("bigint")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def looped(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        # a and the period are bound once: lambdas evaluate what they name at every word
        return let(
            F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).cast("bigint").alias("p")),
            lambda s: F.array_join(
                F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "
            ),
        )

    planted = F.when(h % every == 0, let(words, lambda w: F.when(F.size(w) > 0, looped(w)).otherwise(F.lit("")))).otherwise(text)
    name = fresh(docs, "looped_text")[0]
    return docs.withColumn(name, planted).drop(text_col).withColumnRenamed(name, text_col)
