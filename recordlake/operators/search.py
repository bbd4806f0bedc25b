"""Search over the whole record table: filters, match tiers, order, pages, facets.

One query is a single scan: its candidate texts are literals in the scoring
expression. Tables of queries are matched in :mod:`.search_batch`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import (
    joined,
    let,
    normalize_devanagari,
    normalize_house,
    normalize_id_code,
    normalize_latin,
    trim_ws,
)
from ..functions.translit import expand_query, query_script

c = F.col

# Scores and labels of the match tiers.
ID_EXACT, ID_PART = (100, "epic_exact"), (60, "epic_partial")
TEXT_ID_EXACT, TEXT_ID_PART = (100, "Matched EPIC"), (80, "Matched EPIC (Partial)")
NAME_EXACT = {"lat": (95, "Matched Name (Exact)"), "dev": (95, "Matched Name (Exact Devanagari)")}
NAME_JOINED = (85, "Matched Spaced Variant")
NAME_PREFIX = (75, "Matched Name (Prefix)")
NAME_PART = (70, "Matched Name (Partial)")
NAME_FUZZY = (65, "Matched Fuzzy Name (Typo Tolerant)")
REL_EXACT, REL_PART = 55, 45
HOUSE = (40, "Matched House Number")
NAME_FILTER = (70, "Matched Name (Filter)")
REL_FILTER = (65, "Matched Relation Name (Filter)")
NO_TEXT_SCORE = 50
MAX_EDITS = 2
FUZZY_LONGER_THAN = {"lat": 3, "dev": 2}
MAX_PAGE, DEFAULT_PAGE = 100, 20
FUZZY_MODES = ("all", "fuzzy")


@dataclass(frozen=True)
class SearchFilters:
    """One search; every field is optional."""

    query: str | None = None
    id_code: str | None = None
    name: str | None = None
    relation_name: str | None = None
    relation_type: str | None = None
    gender: str | None = None
    min_age: int | None = None
    max_age: int | None = None
    house: str | None = None
    ward: str | None = None
    part: str | None = None
    serial: int | None = None
    area: str | None = None
    constituency: str | None = None
    constituency_id: str | None = None
    poll_id: str | None = None
    mode: str = "all"  # exact and transliterated only switch the typo tier off
    page: int = 1
    limit: int = DEFAULT_PAGE
    sort_by: str = "relevance"
    descending: bool = True


@dataclass(frozen=True)
class SearchResult:
    """Lazy results of one search."""

    matches: DataFrame
    page: DataFrame
    facets: DataFrame
    candidates: dict[str, list[str]] = field(default_factory=dict)


# --------------------------------------------------------------- candidates
def candidate_columns(text: Column) -> tuple[Column, Column]:
    """(Latin, Devanagari) normalised candidate texts of a query, blanks left out."""
    texts = expand_query(text)

    def of(test, norm) -> Column:
        kept = F.filter(texts, test)
        return F.array_distinct(F.filter(F.transform(kept, norm), lambda t: t != ""))

    lat = of(lambda t: ~t.rlike(r"[\u0900-\u097F]"), normalize_latin)
    dev = of(lambda t: t.rlike(r"[\u0900-\u097F]"), normalize_devanagari)
    return lat, dev


def literal_candidates(spark: SparkSession, texts: dict[str, str]) -> dict[str, dict]:
    """Candidates, script, house and code forms of a few query texts, as Python values (one row)."""
    if not texts:
        return {}
    picked = []
    for name, text in texts.items():
        lit = trim_ws(F.lit(text))
        lat, dev = candidate_columns(lit)
        picked.append(
            F.struct(
                lat.alias("lat"), dev.alias("dev"), query_script(lit).alias("script"),
                normalize_house(lit).alias("house"), normalize_id_code(lit).alias("id_code"),
                F.upper(lit).alias("upper"),
            ).alias(name)
        )
    row = spark.range(1).select(*picked).first()
    return {name: row[name].asDict() for name in texts}


# -------------------------------------------------------------------- tiers
def _tier(test: Column, score_label: tuple[int, str]) -> tuple[Column, int, str]:
    return (test, score_label[0], score_label[1])


def name_tiers(name: Column, cand: Column, script: str, fuzzy: bool) -> list[tuple[Column, int, str]]:
    """Match tests of a normalised name against one candidate, best first."""
    whole, cand_whole = joined(name), joined(cand)
    tiers = [
        _tier(name == cand, NAME_EXACT[script]),
        _tier(whole == cand_whole, NAME_JOINED),
        # A spaced prefix is also a prefix once blanks are gone.
        _tier(whole.startswith(cand_whole), NAME_PREFIX),
        _tier(name.contains(cand), NAME_PART),
    ]
    if fuzzy:
        near = F.levenshtein(name, cand, MAX_EDITS) >= 0
        tiers.append(_tier((F.length(name) > FUZZY_LONGER_THAN[script]) & near, NAME_FUZZY))
    return tiers


def relation_label(relation_type: Column) -> Column:
    kind = (
        F.when(relation_type == "FATHER", "Father Name")
        .when(relation_type == "HUSBAND", "Husband Name")
        .when(relation_type == "MOTHER", "Mother Name")
        .otherwise("Relation Name")
    )
    return F.concat(F.lit("Matched "), kind)


def relation_tiers(rel: Column, cand: Column, relation_type: Column) -> list[tuple[Column, int, Column]]:
    label = relation_label(relation_type)
    return [
        (rel == cand, REL_EXACT, label),
        (rel.contains(cand), REL_PART, F.concat(label, F.lit(" (Partial)"))),
    ]


def best_tier(tiers: list[tuple[Column, int, object]]) -> Column:
    """struct(score, label) of the first test that holds, NULL when none does."""
    out = None
    for test, score, label in tiers:
        text = label if isinstance(label, Column) else F.lit(label)
        hit = F.struct(F.lit(score).alias("score"), text.alias("label"))
        out = F.when(test, hit) if out is None else out.when(test, hit)
    return out


def _text_hits(words: dict, fuzzy: bool) -> list[Column]:
    """Every possible hit of a free-text query on a record."""
    code = normalize_id_code(c("id_code"))
    upper = words["upper"]
    hits = [
        best_tier(
            [_tier((code != "") & (code == upper), TEXT_ID_EXACT), _tier(code.contains(upper), TEXT_ID_PART)]
        )
    ]
    for script, name, rel in (("lat", "norm_name_lat", "norm_rel_lat"), ("dev", "norm_name_dev", "norm_rel_dev")):
        for cand in words[script]:
            hits.append(best_tier(name_tiers(c(name), F.lit(cand), script, fuzzy)))
            hits.append(best_tier(relation_tiers(c(rel), F.lit(cand), c("relation_type"))))
    if words["house"]:
        hits.append(best_tier([_tier(c("norm_house") == words["house"], HOUSE)]))
    return hits


def _any_contains(text: Column, candidates: Sequence[str]) -> Column:
    out = F.lit(False)
    for cand in candidates:
        out = out | F.coalesce(text.contains(cand), F.lit(False))
    return out


def structured_predicates(f: SearchFilters, columns: Sequence[str]) -> list[Column]:
    """Equality and range filters; a missing age passes the age range. A filter without its column is an error."""
    out = []
    equal = {
        "gender": f.gender, "relation_type": f.relation_type, "area": f.area, "ward": f.ward,
        "part": f.part, "constituency": f.constituency, "constituency_id": f.constituency_id,
        "poll_id": f.poll_id, "source_serial_number": f.serial,
    }
    for name, value in equal.items():
        if value is not None:
            if name not in columns:
                raise ValueError(f"the records have no column {name} to filter by")
            out.append(c(name) == F.lit(value))
    if f.min_age is not None:
        out.append(c("age").isNull() | (c("age") >= f.min_age))
    if f.max_age is not None:
        out.append(c("age").isNull() | (c("age") <= f.max_age))
    return out


def score_records(records: DataFrame, f: SearchFilters, words: dict[str, dict]) -> DataFrame:
    """Matching records with ``score`` and ``matched_fields``; one scan, cheap filters first."""
    for p in structured_predicates(f, records.columns):
        records = records.where(p)
    house = words.get("house", {}).get("house")
    if house:
        records = records.where(c("norm_house").contains(house))
    code = normalize_id_code(c("id_code"))
    id_query = words.get("id_code", {}).get("id_code")
    if id_query:
        records = records.where(code.contains(id_query))

    hits: list[Column] = []
    if id_query:
        hits.append(best_tier([_tier(code == id_query, ID_EXACT), _tier(code.contains(id_query), ID_PART)]))
    text = words.get("query")
    text_hits: list[Column] = []
    if text:
        pooled = dict(text)
        if "name" in words:  # with both given, their candidates are pooled
            for script in ("lat", "dev"):
                pooled[script] = list(dict.fromkeys(text[script] + words["name"][script]))
        text_hits = _text_hits(pooled, f.mode in FUZZY_MODES)
        hits += text_hits
    elif "name" in words:
        named = _any_contains(c("norm_name_lat"), words["name"]["lat"]) | _any_contains(
            c("norm_name_dev"), words["name"]["dev"]
        )
        records = records.where(named)
        hits.append(best_tier([_tier(F.lit(True), NAME_FILTER)]))
    if "relation_name" in words:
        related = _any_contains(c("norm_rel_lat"), words["relation_name"]["lat"]) | _any_contains(
            c("norm_rel_dev"), words["relation_name"]["dev"]
        )
        records = records.where(related)
        hits.append(best_tier([_tier(F.lit(True), REL_FILTER)]))
    if house:
        hits.append(best_tier([_tier(F.lit(True), HOUSE)]))

    if not hits:
        no_labels = F.array().cast("array<string>")
        return records.withColumns({"score": F.lit(NO_TEXT_SCORE), "matched_fields": no_labels})
    # Hits of a filter that already passed are constants: with a text they do not make a match.
    needed = len(hits) - len(text_hits) if text_hits and not id_query else -1

    def summary(found: Column) -> Column:
        scores = F.transform(found, lambda h: h["score"])
        labels = F.array_distinct(F.transform(found, lambda h: h["label"]))
        return F.when(
            F.size(found) > needed,
            F.array(F.struct(F.array_max(scores).alias("score"), labels.alias("matched_fields"))),
        )

    # A generator scores each row once; a filter on the score would be pushed down and score it again.
    return records.select("*", F.inline(let(F.array_compact(F.array(*hits)), summary)))


# ------------------------------------------------------------ order, pages
def sort_columns(f: SearchFilters) -> list[Column]:
    """Sort keys with the record id as tie-breaker; an unknown key keeps the input order."""
    keys = {
        "relevance": c("score"),
        "serial": c("source_serial_number"),
        "age": F.coalesce(c("age"), F.lit(0)),
        "name": c("norm_name_lat"),
    }
    key = keys.get(f.sort_by)
    if key is None:
        return [c("ingest_seq").asc()]
    return [key.desc() if f.descending else key.asc(), c("record_id").asc()]


def page_bounds(page: int, limit: int) -> tuple[int, int]:
    """(offset, rows): page from 1, 1 to 100 rows, 0 rows means the default."""
    rows = min(MAX_PAGE, max(1, limit or DEFAULT_PAGE))
    return (max(1, page or 1) - 1) * rows, rows


def result_page(matches: DataFrame, f: SearchFilters) -> DataFrame:
    offset, rows = page_bounds(f.page, f.limit)
    return matches.orderBy(*sort_columns(f)).offset(offset).limit(rows)


def facets(matches: DataFrame, fields: Sequence[str] = ("gender", "ward", "part")) -> DataFrame:
    """Counts per facet value over all matches plus the total, in one pass."""
    pairs = F.array(
        F.struct(F.lit("total").alias("facet"), F.lit("all").alias("value")),
        *[F.struct(F.lit(x).alias("facet"), c(x).cast("string").alias("value")) for x in fields],
    )
    exploded = matches.select(F.inline(pairs))
    return exploded.where(c("value").isNotNull()).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def search(records: DataFrame, filters: SearchFilters) -> SearchResult:
    """Run one search over the whole table."""
    texts = {
        name: getattr(filters, name)
        for name in ("query", "id_code", "name", "relation_name", "house")
        if (getattr(filters, name) or "").strip()
    }
    words = literal_candidates(records.sparkSession, texts)
    matches = score_records(records, filters, words)
    shown = words.get("query", {})
    return SearchResult(
        matches, result_page(matches, filters), facets(matches),
        {"lat": shown.get("lat", []), "dev": shown.get("dev", [])},
    )
