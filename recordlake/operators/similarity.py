"""Trigram similarity and ranked token search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LATIN_KEPT, fold_latin, let, normalize_devanagari, normalize_latin, outside
from ..session import cut_lineage
from . import search as S

c = F.col

# Thresholds and weights of the trigram score.
NAME_SIMILARITY, RELATION_SIMILARITY = 0.3, 0.25
W_ID, W_NAME, W_PREFIX, W_TRIGRAM, W_RELATION, W_HOUSE, W_WARD = 100, 60, 30, 40, 15, 10, 10
_BREAK = r"[^a-z0-9\u0900-\u097F]+"


def trigrams(text: Column) -> Column:
    """Distinct trigrams of every word, padded with two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of two trigram sets: |a and b| / |a or b|, 0 for empty sets."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity of two texts, 0 to 1."""
    return overlap(trigrams(a), trigrams(b))


def trigram_search(records: DataFrame, f: S.SearchFilters) -> DataFrame:
    """Records whose name is similar to (or contains) the query, with the weighted score."""
    name_words = (f.name or f.query or "").strip()
    words = S.literal_candidates(
        records.sparkSession,
        {k: v for k, v in {"name": name_words, "rel": (f.relation_name or "").strip()}.items() if v},
    )
    records = _where_equal(records, f)

    def literal_grams(text: str) -> Column:
        padded = [f"  {w} " for w in text.split()]
        grams = dict.fromkeys(p[i : i + 3] for p in padded for i in range(len(p) - 2))
        return F.array(*[F.lit(g) for g in grams]).cast("array<string>")

    zero = F.lit(0.0)
    score = zero
    keep = []
    if f.id_code:
        code = F.upper(F.coalesce("id_code", F.lit("")))
        score = score + F.when(code == f.id_code.upper(), W_ID).otherwise(0)
        keep.append(code.startswith(f.id_code.upper()))
    if name_words:
        lat = (words["name"]["lat"] or [""])[0]
        dev = (words["name"]["dev"] or [""])[0]
        name_lat, name_dev = F.coalesce("norm_name_lat", F.lit("")), F.coalesce("norm_name_dev", F.lit(""))
        same = F.lit(False)
        starts = F.lit(False)
        holds = F.lit(False)
        sims = [zero]
        for column, text in ((name_lat, lat), (name_dev, dev)):
            if text:
                same = same | (column == text)
                starts = starts | column.startswith(text)
                holds = holds | column.contains(text)
                sims.append(overlap(trigrams(column), literal_grams(text)))
        records = records.withColumn("name_similarity", F.greatest(*sims) if len(sims) > 1 else zero)
        score = score + F.when(same, W_NAME).otherwise(0) + F.when(starts, W_PREFIX).otherwise(0)
        score = score + c("name_similarity") * W_TRIGRAM
        keep.append((c("name_similarity") > NAME_SIMILARITY) | holds)
    else:
        records = records.withColumn("name_similarity", zero)
    if "rel" in words:
        lat = (words["rel"]["lat"] or [""])[0]
        dev = (words["rel"]["dev"] or [""])[0]
        rel_lat, rel_dev = F.coalesce("norm_rel_lat", F.lit("")), F.coalesce("norm_rel_dev", F.lit(""))
        part = (rel_lat.contains(lat) if lat else F.lit(False)) | (rel_dev.contains(dev) if dev else F.lit(False))
        similar = overlap(trigrams(rel_lat), literal_grams(lat)) > RELATION_SIMILARITY
        records = records.where(similar | part)
        score = score + F.when(part, W_RELATION).otherwise(0)
    if f.house:
        score = score + F.when(c("house_number") == f.house, W_HOUSE).otherwise(0)
    if f.ward:
        score = score + F.when(c("ward") == f.ward, W_WARD).otherwise(0)
    matched = records
    if keep:
        any_kept = keep[0]
        for k in keep[1:]:
            any_kept = any_kept | k
        matched = records.where(any_kept)
    return matched.withColumn("score", score)


def _where_equal(records: DataFrame, f: S.SearchFilters) -> DataFrame:
    exact = {"house_number": f.house, "ward": f.ward, "part": f.part, "gender": f.gender}
    for name, value in exact.items():
        if value is not None:
            records = records.where(c(name) == value)
    if f.min_age is not None:
        records = records.where(c("age") >= f.min_age)
    if f.max_age is not None:
        records = records.where(c("age") <= f.max_age)
    return records


def trigram_join(queries: DataFrame, values: DataFrame, threshold: float = NAME_SIMILARITY) -> DataFrame:
    """(query, value, similarity) above the threshold for two tables of texts.

    Texts are made distinct first. A pair above the threshold shares one of the
    globally rarest trigrams of either side (prefix filter), so only those are
    join keys; the exact similarity is computed for the pairs that meet.
    """

    def grams_of(df: DataFrame, name: str) -> DataFrame:
        text = normalize_latin(c(name))
        return df.where(c(name).isNotNull()).select(c(name)).distinct().withColumn("grams", trigrams(text))

    left, right = grams_of(queries, "query"), grams_of(values, "value")
    frequency = right.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def rare(df: DataFrame, name: str) -> DataFrame:
        # Per text a short list: as many entries as the text has trigrams.
        each = df.select(name, "grams", F.explode("grams").alias("gram")).join(frequency, "gram", "left")
        ordered = each.groupBy(name, "grams").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("o")
        )
        size = F.size("o")
        keep = size - F.ceil(size * threshold).cast("int") + 1
        return ordered.select(name, "grams", F.explode(F.slice("o", 1, keep)).alias("k")).select(
            name, "grams", c("k.gram").alias("gram")
        )

    a = rare(left, "query").withColumnRenamed("grams", "query_grams")
    b = rare(right, "value").withColumnRenamed("grams", "value_grams")
    # Two sets this alike are also alike in size.
    sized = (F.size("query_grams") >= F.size("value_grams") * threshold) & (
        F.size("value_grams") >= F.size("query_grams") * threshold
    )
    pairs = a.join(b, "gram").where(sized).select("query", "value", "query_grams", "value_grams").distinct()
    scored = pairs.select("query", "value", overlap(c("query_grams"), c("value_grams")).alias("similarity"))
    return scored.where(c("similarity") > threshold)


# ------------------------------------------------------------ token search
def tokens(text: Column) -> Column:
    """Words of a text in either script, lower case and accents folded."""
    latin = F.split(F.lower(fold_latin(F.coalesce(text, F.lit("")))), f"{outside(LATIN_KEPT)}+")
    dev = F.when(
        text.rlike(r"[\u0900-\u097F]"),
        F.split(normalize_devanagari(F.regexp_replace(text, outside(["\u0900-\u097F"]) + "+", " ")), " "),
    )
    none = F.array().cast("array<string>")
    return F.filter(F.concat(latin, F.coalesce(dev, none)), lambda w: w != "")


def token_search(docs: DataFrame, doc_id: str, text: str, terms: Sequence[str]) -> DataFrame:
    """Documents holding any of the terms, scored by sum of tf * ln((1 + docs) / (1 + df)).

    Texts are read once: of each, only the counts of the searched terms that occur are stored, for the
    two steps that need them.
    """
    wanted = list(dict.fromkeys(x.lower() for x in terms))
    # Texts without any of the terms are counted too.
    counted = cut_lineage(docs.select(c(doc_id), _term_counts(tokens(c(text)), wanted).alias("_found")), "term-counts")
    per_term = counted.select(F.inline("_found")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One entry per searched term.
    frequencies = per_term.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    n_docs = counted.agg(F.count(F.lit(1)).alias("n"))
    weighted = counted.select(c(doc_id), F.inline("_found")).withColumns({"_n": n_docs.scalar(), "_df": frequencies.scalar()})
    weight = F.log((1 + c("_n")) / (1 + F.try_element_at("_df", c("term"))))
    return weighted.groupBy(doc_id).agg(
        F.count(F.lit(1)).cast("int").alias("n_terms"), F.sum(c("tf") * weight).alias("score")
    )


def _term_counts(words: Column, wanted: Sequence[str]) -> Column:
    """array<struct(term, tf)> of the wanted terms that occur."""
    terms = F.array(*[F.lit(t) for t in wanted])

    def count(found: Column) -> Column:
        counts = F.transform(
            terms,
            lambda t: F.struct(t.alias("term"), F.size(F.filter(found, lambda w: w == t)).alias("tf")),
        )
        return F.filter(counts, lambda x: x["tf"] > 0)

    return let(F.filter(words, lambda w: w.isin(list(wanted))), count)
