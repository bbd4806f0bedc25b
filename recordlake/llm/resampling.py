"""Quality by importance resampling: hashed n-gram models of wanted and of raw text, and a Gumbel top-k.

Each document is a bag of hashed features: words, word pairs, and triples of word
shapes. Two generative models over the buckets are counted, one of the wanted
documents and one of all documents. A document's log weight is the sum of the log
ratios of its features; adding a Gumbel variable to it and keeping the k largest is a
draw of k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fresh, id_and_text, sole

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
LARGE = 1e300
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DIGIT = re.compile(rb"[0-9]")
_known: dict[bytes, int] = {}


def _token(word: bytes) -> int:
    """Hash of the word with A-Z lower-cased, its last 16 bits the shape: 1 lower, 2 capitalised, 3 upper, 4 with digits, from 5 signs by their hash."""
    if len(_known) > 250_000:
        _known.clear()
    if word[0] < 128 and not word[:1].isalnum():
        shape = 5 + xxhash.xxh3_64_intdigest(word) % 1000
    elif _DIGIT.search(word):
        shape = 4
    elif word[:1].isupper():
        shape = 3 if len(word) > 1 and word.isupper() else 2
    else:
        shape = 1
    out = _known[word] = xxhash.xxh3_64_intdigest(word.lower()) >> 16 << 16 | shape
    return out


def features(text: str | None, bits: int) -> np.ndarray:
    """Buckets of all words (2 ** bits of them), then of word pairs and shape triples (2 ** (bits - 2)), of the whole text."""
    tokens = _TOKEN.findall(text.encode()) if text else []
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    get = sole(_known).get
    both = np.array([get(t) or _token(t) for t in tokens], dtype=np.uint64)
    with np.errstate(over="ignore"):
        shape = both & np.uint64(0xFFFF)
        word = both ^ shape
        same = np.zeros(len(word), dtype=np.uint64)
        same[1:] = word[1:] == word[:-1]
        shape = shape * np.uint64(2) + same
        two = word[:-1] * np.uint64(31) + word[1:]
        three = ((shape[:-2] * np.uint64(4099) + shape[1:-1]) * np.uint64(4099) + shape[2:]) ^ np.uint64(1 << 62)
        rest = np.concatenate([two, three])
        rest = (rest ^ (rest >> np.uint64(32))) * _MIX
        every = np.concatenate([word >> np.uint64(64 - bits), (rest >> np.uint64(66 - bits)) + np.uint64(1 << bits)])
    return every.astype(np.int64)


def n_buckets(bits: int) -> int:
    return (1 << bits) + (1 << (bits - 2))


@dataclass
class Ratios:
    """Log ratios of the wanted model to each raw one, and the log weights from which documents count as wanted.

    ``pairs``: (log ratio per bucket, cut, whether only words count, each once per document).
    """

    bits: int
    pairs: list[tuple[np.ndarray, float, bool]]

    def weights(self, text: str | None) -> list[float]:
        f = features(text, self.bits)
        words = f[f < 1 << self.bits]
        return [float(r[np.unique(words)].sum() if once else r[f].sum()) for r, _, once in self.pairs]

    def weight(self, text: str | None) -> float:
        """The least log weight over the raw models, each counted from its cut."""
        return min([w - cut for w, (_, cut, _) in zip(self.weights(text), self.pairs, strict=True)], default=0.0)


def counts(texts: DataFrame, bits: int, once: bool = False) -> np.ndarray:
    """How often each bucket occurs in all texts (``once``: in how many texts); partitions add up their own first."""
    schema = T._parse_datatype_string("bucket int, n long")

    def own(batches):
        total = np.zeros(n_buckets(bits), dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                f = features(text, bits)
                np.add.at(total, np.unique(f) if once else f, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(own, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_buckets(bits), dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def counts_by_fold(labelled: DataFrame, bits: int, folds: int) -> np.ndarray:
    """(fold, which, bucket): :func:`counts` of wanted texts whole, of wanted and of good but toxic texts by documents, in one pass."""
    schema = T._parse_datatype_string("fold int, which int, bucket int, n long")

    def own(batches):
        total = np.zeros((folds, 3, n_buckets(bits)), dtype=np.int64)
        for b in batches:
            for text, wanted, good, fold in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not good:
                    continue
                f = features(text, bits)
                if wanted:
                    np.add.at(total[fold, 0], f, 1)
                total[fold, 1 if wanted else 2, np.unique(f)] += 1
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x.astype(np.int32)) for x in at), pa.array(total[at])], names=["fold", "which", "bucket", "n"]
        )

    found = labelled.select("text", "wanted", "good", "fold").mapInArrow(own, schema)
    found = found.groupBy("fold", "which", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((folds, 3, n_buckets(bits)), dtype=np.int64)
    out[tuple(found.column(x).to_numpy() for x in ("fold", "which", "bucket"))] = found.column("n").to_numpy()
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smooth: float, errors: float) -> np.ndarray:
    """Log ratio of the two models per bucket.

    Both get ``smooth`` more in every bucket, at the size of the wanted one. The raw
    model is scaled so that the median feature of raw text has ratio 1; so the
    length of ordinary text does not count. A ratio is drawn towards 1 by ``errors``
    standard errors, so rare features, whose ratios are noise, do not add up either.
    """
    if not target.sum() or not raw.sum():
        return np.zeros(len(target))
    scaled = raw * (target.sum() / raw.sum())
    plain = np.log(target + smooth) - np.log(scaled + smooth)
    order = np.argsort(plain)
    mass = np.cumsum(scaled[order])
    scaled = scaled * np.exp(plain[order[np.searchsorted(mass, mass[-1] / 2)]])
    plain = np.log(target + smooth) - np.log(scaled + smooth)
    error = np.sqrt(1 / (target + smooth) + 1 / (raw + smooth))
    return np.sign(plain) * np.maximum(np.abs(plain) - errors * error, 0)


def fit(
    docs: DataFrame, labels: DataFrame, bits: int = 18, smooth: float = 2.0, most_labelled: int = 20_000,
    errors: float = 4.0, toxic_errors: float = 3.0, lost_weight: float = 20.0, id_col: str = "doc_id", text_col: str = "text",
    toxic_lost_weight: float = 5.0, folds: int = 4,
) -> Ratios:
    """Count the models and set the cuts.

    ``labels`` has doc_id, good and toxic (booleans) for some documents; of these, at most
    about ``most_labelled`` (those with the smallest hashes of their ids) are used, all of
    them in the models. Each cut is set where ``lost_weight`` (``toxic_lost_weight`` against toxic
    ones) times the share of wanted documents lost plus the share of others kept is least, with every
    document weighed by models of the other ``folds``. Wanted: good and not toxic. Two
    raw models stand against the wanted one: all documents, whole; and the toxic ones
    among the labelled, where a word counts once per document. See :func:`log_ratios`
    for ``smooth`` and the two numbers of errors. A model without documents, or a cut without both
    kinds of documents, rejects nothing.
    """
    texts = id_and_text(docs, id_col, text_col)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic"))
    n = known.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("labelled")), 11) / float(1 << 53)
    chosen = known.where(place < F.lit(min(1.0, most_labelled / max(n, 1)))).select(
        "doc_id", (F.col("good") & ~F.col("toxic")).alias("wanted"), "good", "toxic",
        F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold"),
    )
    labelled = cut_lineage(texts.join(chosen, "doc_id").select("text", "wanted", "good", "toxic", "fold"), "labelled")
    raw = counts(texts, bits).astype(float)
    parts = counts_by_fold(labelled, bits, folds).astype(float)

    def model_of(whole, once, toxic_once):
        toxic = log_ratios(once, toxic_once, smooth, toxic_errors)
        toxic[1 << bits :] = 0  # words only: word pairs are ten times as many and, measured on labels left out, catch fewer
        return Ratios(bits, [(log_ratios(whole, raw, smooth, errors), 0.0, False), (toxic, 0.0, True)])

    model = model_of(*parts.sum(0))
    shared = labelled.sparkSession.sparkContext.broadcast([model_of(*(parts.sum(0) - parts[i])) for i in range(folds)])

    def scored(batches):
        for b in batches:
            both = [shared.value[i].weights(t) for t, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([w[i] for w in both], pa.float64()) for i in (0, 1)), *b.columns[2:]],
                names=["w0", "w1", "wanted", "good", "toxic"],
            )

    given = labelled.select("text", "fold", "wanted", "good", "toxic")
    rows = given.mapInArrow(scored, "w0 double, w1 double, wanted boolean, good boolean, toxic boolean").toPandas()
    fine, pairs = rows.wanted.to_numpy(bool), []
    others = (~rows.good.to_numpy(bool), rows.toxic.to_numpy(bool))
    for (ratios, _, once), w, other, lost in zip(model.pairs, (rows.w0, rows.w1), others, (lost_weight, toxic_lost_weight), strict=True):
        use = fine | other
        pairs.append((ratios, best_cut(w.to_numpy(float)[use], fine[use], lost), once))
    return Ratios(bits, pairs)


def best_cut(weight: np.ndarray, wanted: np.ndarray, lost_weight: float) -> float:
    """The cut of least cost; in the middle between the two weights beside it."""
    if not len(weight) or wanted.all() or not wanted.any():
        return -LARGE
    order = np.argsort(weight, kind="stable")
    w, y = weight[order], wanted[order].astype(float)
    lost = np.concatenate([[0], np.cumsum(y)]) / y.sum()
    kept = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
    cost = lost_weight * lost + kept
    cost[1:-1][w[1:] == w[:-1]] = np.inf
    i = int(np.argmin(cost))
    return float((w[i - 1] + w[i]) / 2) if 0 < i < len(w) else (-LARGE if i == 0 else LARGE)


def gumbel(*of: Column | str, seed: int = 0) -> Column:
    """A Gumbel variable fixed by the values of the columns."""
    u = (F.shiftrightunsigned(F.xxhash64(*of, F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def weighted(
    docs: DataFrame, model: Ratios, id_col: str, text_col: str, seed: int, temperature: float, carry: list[str] | None = None
) -> tuple[DataFrame, str, str]:
    """The ``carry`` columns of ``docs`` with two more, whose names come back: log weight, and log weight plus noise.

    Only the text goes to Python, and only its weight comes back; the other columns stay where they are.
    """
    carry = docs.columns if carry is None else carry
    weight, noisy = fresh(docs, "log_weight", "noisy_weight")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.weight(x.as_py()) for x in texts], pa.float64())

    text = F.col(f"`{text_col}`")
    noise = gumbel(F.col(f"`{id_col}`"), text, seed=seed) * temperature
    out = docs.select(*(F.col(f"`{n}`") for n in carry), scored(text.cast("string")).alias(weight), noise.alias(noisy))
    return out.withColumn(noisy, F.col(weight) + F.col(noisy)), weight, noisy


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The exact k-th largest value, by counting bins and looking into the one that holds it."""
    v = F.col(column)
    low, high = df.agg(F.min(v), F.max(v)).first()
    above = 0
    while True:
        inside = df.where((v >= low) & (v <= high))
        if low == high:
            return low
        width = (high - low) / bins
        at = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
        rows = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        for r in sorted(rows, reverse=True):
            if above + r.n >= k:
                break
            above += r.n
        low, high = r.low, r.high
        if r.n <= few:
            values = sorted((x[0] for x in df.where((v >= low) & (v <= high)).select(v).collect()), reverse=True)
            return values[k - above - 1]


def resample(
    docs: DataFrame, model: Ratios, k: int | None = None, seed: int = 0, temperature: float = 0.1,
    id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
) -> tuple[DataFrame, dict]:
    """(``docs`` with log_weight, noisy_weight and selected; how it was drawn).

    k defaults to the number of documents whose log weight is 0 or more, counted from the cut.
    The k largest noisy weights are selected, counted exactly over all rows; a low
    ``temperature`` (the factor of the noise) keeps the draw close to the best k. The noise is a
    function of id, text and seed, so a repeated row draws the same number, and all
    rows tied at the limit are selected. Empty and null texts have no features. k of 0
    selects nothing. Each text is scored once: the scored rows, with the columns of
    ``docs`` named in ``carry`` (default: all), are written before the limit is sought.
    """
    every, weight, noisy = weighted(docs, model, id_col, text_col, seed, temperature, carry)
    every = cut_lineage(every, "weights")
    narrow = every.select(F.col(weight).alias("w"), F.col(noisy).alias("g"))
    n, above = narrow.agg(F.count("*"), F.coalesce(F.sum((F.col("w") >= 0).cast("long")), F.lit(0))).first()
    k = min(above if k is None else k, n)
    limit = kth_largest(narrow, "g", k) if k else None
    chosen = fresh(every, "selected")[0]
    selected = F.lit(False) if limit is None else F.col(noisy) >= F.lit(limit)
    return every.withColumn(chosen, selected), {
        "n": n, "k": k, "limit": limit, "weight": weight, "noisy": noisy, "selected": chosen,
    }


def judgements(labels: DataFrame) -> DataFrame:
    """Labels as doc_id, good and toxic; a null label is neither good nor free of toxic text."""
    return labels.select(
        "doc_id", (F.coalesce(F.col("quality"), F.lit(0)) == 1).alias("good"), (F.coalesce(F.col("toxic"), F.lit(1)) == 1).alias("toxic")
    )
