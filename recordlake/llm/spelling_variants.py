"""Spelling variants: words one edit apart, found by dynamic programming over the sorted vocabulary.

A word is held against the sorted words behind it. The edit matrix is kept by depth, in a
band of three cells, so the next word begins with the rows of the prefix that it shares
with the word before (their longest common prefix, LCP); where a row exceeds one edit
all words with that prefix are skipped.

Two words one edit apart share the first k letters of the shorter one, or else its letters
behind these. So the vocabulary is sorted twice, as it is and with reversed words, and a scan ends
with the words that share such a part; a pair is taken from the reversed list only if the
first parts differ. k depends on the length: it is where the groups with equal parts are smallest
in a sample, about half of the length in ordinary text, more where many words begin alike. Each sorted
list is cut into blocks of like size, whatever its words share. A word goes on into the
blocks behind its own as long as these can hold words with its part, skipping a block
whose shared prefix already exceeds one edit. Pairs are counted where they are found, never written.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_arrays
from .common import cut_lineage

#: Words of a block at least, and blocks of each sorted list at most.
BLOCK, MOST_BLOCKS = 6000, 4096
#: Tasks that share the blocks at most.
MOST_TASKS = 2000
#: Words sampled for the places of the cuts, and characters of a cut.
SAMPLE, CUT_LENGTH = 40_000, 64


def _crc_table() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(0xEDB88320), v >> 1)
    return v


_CRC = _crc_table()


def crc32_after(seeds: np.ndarray, words: pa.Array) -> np.ndarray:
    """Checksums of words behind prefixes whose checksums are ``seeds``, all words a byte at a time."""
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and at[-1] else np.zeros(0, np.uint8)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, size = at[:-1][order], size[order]
    v = seeds[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for i in range(min(int(size[0]) if len(size) else 0, 64)):
        n = int(np.searchsorted(-size, -i, side="left"))  # words longer than i
        v[:n] = _CRC[(v[:n] ^ data[begin[:n] + i]) & 0xFF] ^ (v[:n] >> np.uint32(8))
    v ^= np.uint32(0xFFFFFFFF)
    for j in range(int(np.searchsorted(-size, -64, side="left"))):
        v[j] = zlib.crc32(data[begin[j] + 64 : begin[j] + size[j]], int(v[j]))
    out = np.empty_like(v)
    out[order] = v
    return out


def _counted(ids: pa.Array, texts: pa.Array, shortest: int, damage: int | None) -> pa.RecordBatch:
    words, bounds = word_arrays.split(texts, word_arrays.latin_letters)
    words = pc.ascii_lower(words)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    long = pc.greater_equal(pc.utf8_length(words), shortest)
    words, doc = words.filter(long), doc[long.to_numpy(zero_copy_only=False)]
    if damage:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        seeds = np.array([zlib.crc32(f"{x}:".encode()) for x in ids.to_pylist()], dtype=np.uint32)
        h = crc32_after(seeds[doc], words)
        hit = (h % damage == 0) & known[doc]
        cut = []
        for w, x in zip(words.filter(pa.array(hit)).to_pylist(), h[hit].tolist(), strict=True):
            i = x % len(w)
            if len(w) > shortest:
                cut.append(w[:i] + w[i + 1 :])
        words = pa.concat_arrays([words.filter(pa.array(~hit)), pa.array(cut, pa.string())])
    found = pc.value_counts(words)
    return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])


def vocabulary(
    docs: DataFrame, shortest: int = 5, least: int = 3, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, of ``shortest`` or more code points with ``least`` or more occurrences.

    With ``damage`` the runs of some documents lose a code point before they are counted, by the crc32 h of
    ``<id>:<run>``: where ``damage`` divides h, the one at h % length. Documents without an id lose none. Null and
    empty texts have no words; each repeated row counts. Counted in stretches of text first, then over all.
    """
    given = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))

    def own(batches):
        for b in batches:
            for begin, end in word_arrays.slices(b.column(1)):
                yield _counted(b.column(0).slice(begin, end - begin), b.column(1).slice(begin, end - begin), shortest, damage)

    found = given.mapInArrow(own, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least)


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def next_row(row: tuple[int, int, int], x: str, t: int, ch: str) -> tuple[int, int, int]:
    """The band of the edit matrix after one more character: distances to x[:t], x[:t + 1] and x[:t + 2], 2 for more than one edit."""
    a, b, c = row
    n = len(x)
    p = min(a + (t < 1 or t > n or x[t - 1] != ch), b + 1, 2) if t <= n else 2
    q = min(b + (x[t] != ch), c + 1, p + 1, 2) if t < n else 2
    r = min(c + (x[t + 1] != ch), q + 1, 2) if t + 1 < n else 2
    return p, q, r


def prefix_fits(x: str, prefix: str) -> bool:
    """Whether some word with this prefix may be within one edit of x."""
    t = shared(x, prefix)
    row = (1, 0, 1)
    while t < len(prefix):
        row = next_row(row, x, t, prefix[t])
        if min(row) > 1:
            return False
        t += 1
    return True


def best_parts(sample: list[str]) -> dict[int, int]:
    """For each length in the sample the k that makes the groups of equal first k letters and equal letters behind them smallest."""
    by_length: dict[int, list[str]] = {}
    for w in sample:
        for m in (len(w), len(w) - 1):
            by_length.setdefault(m, []).append(w)
    out = {}
    for m, words in by_length.items():
        def cost(k: int) -> tuple[int, int]:
            groups = [Counter(w[:k] for w in words), Counter(w[k - m :] for w in words)]
            return sum(n * n for g in groups for n in g.values()), abs(k - m // 2)  # noqa: B023

        out[m] = min(range(1, m), key=cost) if m > 1 else 0
    return out


def part_of(length: int, parts: dict[int, int], reverse: bool) -> int:
    """How many letters from its beginning (``reverse``: its end) a word shares with those near to it, at least."""
    ks = [(m, parts.get(m, m // 2)) for m in (length - 1, length)]
    return max(0, min(m - k if reverse else k for m, k in ks))


def scan(x: str, words: list[str], lcp: list[int], j: int, known: int, half: int) -> Iterator[int]:
    """Places from j on of words within one edit of x, up to the last that shares x[:half].

    ``lcp[i]`` is what words i - 1 and i share; ``known`` what x shares with word j, where j is the first word behind x.
    """
    rows, n, end = [(1, 0, 1)] * (known + 1), len(x), len(words)
    while j < end and known >= half:
        w, t = words[j], known
        del rows[t + 1 :]
        row = rows[t]
        while t < len(w):
            row = next_row(row, x, t, w[t])
            t += 1
            if row[0] > 1 and row[1] > 1 and row[2] > 1:
                break
            rows.append(row)
        else:
            d = n - t
            if -1 <= d <= 1 and row[d + 1] <= 1:
                yield j
            j += 1
            known = lcp[j] if j < end else -1
            continue
        # every word with this prefix is more than one edit away
        j += 1
        last = min(j + 8, end)
        while j < last and lcp[j] >= t:
            j += 1
        if j == last and j < end and lcp[j] >= t:
            j = bisect_right(words, w[:t] + "\U0010ffff", j, end)
        known = lcp[j] if j < end else -1


def near_in_block(
    keys: list[str], counts: list[int], guests: list[tuple[str, int]], reverse: bool, parts: dict[int, int]
) -> list[tuple[str, int, int, str]]:
    """(word, how many near, count and word of the best) of a sorted block's words and of those that come from blocks before it."""
    lcp = [0, *(shared(a, b) for a, b in zip(keys, keys[1:], strict=False))]
    plain = [k[::-1] for k in keys] if reverse else keys
    near: dict[str, list] = {}

    def credit(word: str, other: str, n: int) -> None:
        have = near.setdefault(word, [0, 0, ""])
        have[0] += 1
        if n > have[1] or (n == have[1] and other < have[2]):
            have[1:] = n, other

    def pairs(key: str, word: str, n: int, j: int, known: int) -> None:
        for i in scan(key, keys, lcp, j, known, part_of(len(key), parts, reverse)):
            other = plain[i]
            least = min(len(word), len(other))
            first = parts.get(least, least // 2)
            if (word[:first] == other[:first]) != reverse:
                credit(word, other, counts[i])
                credit(other, word, n)

    for i, key in enumerate(keys[:-1]):
        pairs(key, plain[i], counts[i], i + 1, lcp[i + 1])
    for key, n in guests:
        if keys:
            pairs(key, key[::-1] if reverse else key, n, 0, shared(key, keys[0]))
    return [(w, *v) for w, v in near.items()]


def homes(key: str, cuts: list[str], part: int) -> Iterator[int]:
    """The block of a word, then those behind it that may hold words near to it."""
    own = bisect_right(cuts, key)
    yield own
    half = key[:part]
    for b in range(own, len(cuts)):  # block b + 1 begins with cuts[b]
        if cuts[b][: len(half)] > half:
            return
        common = cuts[b][: shared(cuts[b], cuts[b + 1])] if b + 1 < len(cuts) else ""
        if prefix_fits(key, common):
            yield b + 1


def cuts_of(keys: list[str], blocks: int) -> list[str]:
    """At most ``blocks`` - 1 different cuts of a sorted sample into parts of like size."""
    return sorted({keys[len(keys) * i // blocks] for i in range(1, blocks)}) if keys else []


def near_words(words: DataFrame, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(word, n, n_near, form, form_n) for a table of different words and their counts, which is read several times.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. The
    form is the near word of the largest n (ties: smallest in code-point order), if that n is at
    least twice the word's own. Lists of at most ``most_blocks`` cuts of bounded length are sent to the tasks; the places
    of the cuts and the parts that are shared come from a sample by hash and only decide how the work is split. No word: no row.
    """
    total = words.count()
    blocks = max(1, min(most_blocks, -(-total // block)))
    place = F.shiftrightunsigned(F.xxhash64("word"), 11) / float(1 << 53)
    sample = words.where(place < F.lit(min(1.0, SAMPLE / max(total, 1)))) if blocks > 1 else words.limit(0)
    drawn = sample.select(F.substring("word", 1, CUT_LENGTH), F.substring(F.reverse("word"), 1, CUT_LENGTH)).toPandas()
    cuts = [cuts_of(sorted(drawn[x]), blocks) for x in drawn.columns]
    parts = best_parts([w for w in drawn.iloc[:, 0] if len(w) < CUT_LENGTH])
    told = words.sparkSession.sparkContext.broadcast((cuts, parts))

    def dealt(batches):
        cuts, parts = told.value
        for b in batches:
            rows = [
                (r, h, w[::-1] if r else w, n, k == 0)
                for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for r in (False, True)
                for k, h in enumerate(homes(w[::-1] if r else w, cuts[r], part_of(len(w), parts, r)))
            ]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["reverse", "block", "key", "n", "own"]).astype({"block": "int32"}))

    def near(group, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.own].sort_values("key")
        guests = pdf[~pdf.own]
        found = near_in_block(own.key.tolist(), own.n.tolist(), list(zip(guests.key, guests.n.tolist(), strict=True)), bool(group[0]), told.value[1])
        return pd.DataFrame(found, columns=["word", "near", "best_n", "best"])

    pieces = words.select("word", "n").mapInArrow(dealt, "reverse boolean, block int, key string, n long, own boolean")
    # a block a task: adaptive execution would join them by their size, not by their work
    pieces = pieces.repartition(min(2 * blocks, MOST_TASKS), "reverse", "block")
    found = pieces.groupBy("reverse", "block").applyInPandas(near, "word string, near long, best_n long, best string")
    none = F.lit(None)
    every = words.select("word", "n", F.lit(0).cast("long").alias("near"), none.cast("struct<o: bigint, w: string>").alias("best")).unionByName(
        found.select("word", none.cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("o"), F.col("best").alias("w")).alias("best"))
    )
    best = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.o") >= 2 * F.col("n")
    return best.select("word", "n", "n_near", F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.o")).alias("form_n"))


def with_roots(near: DataFrame) -> DataFrame:
    """``near`` with the root: the last word when forms are followed, the word itself without a form.

    Each step to a form doubles the count at least, so a path has fewer than 64 steps and six doublings reach its end.
    """
    links = cut_lineage(near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "links")
    for _ in range(6):
        up = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = links.join(up, "root", "left")
        links = cut_lineage(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        moved = not links.where("moved").isEmpty()
        links = links.drop("moved")
        if not moved:
            break
    return near.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(
    docs: DataFrame, shortest: int = 5, least: int = 3, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per word of the vocabulary: word, n, n_near, form, form_n, root. See :func:`vocabulary`, :func:`near_words` and :func:`with_roots`.

    Other columns are not read. The vocabulary and the near words are written once, as both are read several times.
    """
    words = cut_lineage(vocabulary(docs, shortest, least, damage, id_col, text_col), "vocabulary")
    return with_roots(cut_lineage(near_words(words), "near-words"))
