"""A table of queries against the whole record table, with equi-joins only.

Names repeat heavily, so texts are matched once per distinct value and the
value matches are joined back to the records. Candidates reach a value through
a shared key that any match must share: a gram for the equal, prefix and
contains tiers, an unchanged third of the value for the typo tier. The tests of
:mod:`.search` then decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined, normalize_house, normalize_id_code, trim_ws
from ..session import cut_lineage
from . import search as S

c = F.col
GRAM = 3
SEGMENTS = S.MAX_EDITS + 1


# -------------------------------------------------------------- gram keys
def _grams(text: Column, n: int) -> Column:
    count = F.length(text) - (n - 1)
    none = F.array().cast("array<string>")
    return F.when(
        count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(n)))
    ).otherwise(none)


def _value_grams(text: Column) -> Column:
    """Every piece of one to three characters, so that short candidates find their values too."""
    return F.array_distinct(F.concat(*[_grams(text, n) for n in range(1, GRAM + 1)]))


def _candidate_grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, F.array_distinct(_grams(text, GRAM))).otherwise(F.array(text))


def containing_pairs(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, field, cand, value) where the value may contain the candidate, blanks aside.

    The candidate's rarest gram is the join key; a candidate with a gram that
    no value of its field has is dropped. Nothing that contains the candidate
    is missed.
    """
    cand_grams = candidates.select(
        "query_id", "field", "cand", F.explode(_candidate_grams(joined(c("cand")))).alias("gram")
    )
    value_grams = values.select("field", "value", F.explode(_value_grams(joined(c("value")))).alias("gram"))
    value_grams = value_grams.join(cand_grams.select("field", "gram").distinct(), ["field", "gram"], "left_semi")
    frequency = value_grams.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
    counted = cand_grams.join(frequency, ["field", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("query_id", "field", "cand").agg(F.min(F.struct("n", "gram")).alias("r"))
    keyed = rarest.where(c("r.n") > 0).select("query_id", "field", "cand", c("r.gram").alias("gram"))
    return keyed.join(value_grams, ["field", "gram"]).select("query_id", "field", "cand", "value")


# ----------------------------------------------------------- segment keys
def _segment(length: Column, i: int) -> tuple[Column, Column]:
    """(0-based start, size) of the i-th of three near-equal pieces."""
    def cut(n: int) -> Column:
        return F.floor(length * n / SEGMENTS).cast("int")

    return cut(i), cut(i + 1) - cut(i)


def _value_segments(text: Column) -> Column:
    size = F.length(text)
    parts = []
    for i in range(SEGMENTS):
        at, n = _segment(size, i)
        parts.append(F.struct(size.alias("len"), F.lit(i).alias("seg"), F.substring(text, at + 1, n).alias("piece")))
    return F.array(*parts)


def _candidate_segments(text: Column, longer_than: Column) -> Column:
    size = F.length(text)
    shortest = F.greatest(size - S.MAX_EDITS, longer_than + 1)
    longest = size + S.MAX_EDITS
    empty = F.array().cast("array<struct<len:int,seg:int,piece:string>>")

    def of_length(value_len: Column) -> Column:
        pieces = []
        for i in range(SEGMENTS):
            at, n = _segment(value_len, i)
            for shift in range(-S.MAX_EDITS, S.MAX_EDITS + 1):
                start = at + shift
                inside = (start >= 0) & (start + n <= size)
                pieces.append(
                    F.when(
                        inside,
                        F.struct(
                            value_len.alias("len"), F.lit(i).alias("seg"),
                            F.substring(text, start + 1, n).alias("piece"),
                        ),
                    )
                )
        return F.array_compact(F.array(*pieces))

    lengths = F.when(longest >= shortest, F.sequence(shortest, longest))
    return F.array_distinct(F.coalesce(F.flatten(F.transform(lengths, of_length)), empty))


def near_pairs(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, field, cand, value) of names that may be within two edits.

    Two edits touch at most two of a value's three pieces, so one piece stands
    unchanged in the candidate, at most two places away.
    """
    longer_than = F.when(c("field") == NAMES["lat"], S.FUZZY_LONGER_THAN["lat"]).otherwise(S.FUZZY_LONGER_THAN["dev"])
    named = c("field").isin(list(NAMES.values()))
    left = values.where(named & (F.length("value") > longer_than)).select(
        "field", "value", F.inline(_value_segments(c("value")))
    )
    right = candidates.where(named).select(
        "query_id", "field", "cand", F.inline(_candidate_segments(c("cand"), longer_than))
    )
    pairs = right.join(left, ["field", "len", "seg", "piece"])
    return pairs.select("query_id", "field", "cand", "value").distinct()


# ------------------------------------------------------- values, candidates
NAMES = {"lat": "norm_name_lat", "dev": "norm_name_dev"}
RELATIONS = {"lat": "norm_rel_lat", "dev": "norm_rel_dev"}
CODE, HOUSE = "id_code", "norm_house"


def _field_values() -> Column:
    """The searched texts of a record as array<struct(field, value)>."""
    texts = {x: c(x) for x in (*NAMES.values(), *RELATIONS.values(), HOUSE)}
    texts[CODE] = normalize_id_code(c("id_code"))
    return F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in texts.items()])


def value_dictionary(records: DataFrame) -> DataFrame:
    """Distinct (field, value) of all records: what queries are matched against.

    Many searches over the same records can share one written copy.
    """
    values = records.select(F.inline(_field_values()))
    return values.where((c("value") != "") & (c("field") != HOUSE)).distinct()


def query_candidates(queries: DataFrame) -> DataFrame:
    """(query_id, field, cand) of ``queries(query_id, query)``."""
    text = trim_ws(c("query"))
    lat, dev = S.candidate_columns(text)
    wide = queries.select("query_id", F.upper(text).alias("upper"), lat.alias("lat"), dev.alias("dev"))
    per_field = [F.struct(F.lit(CODE).alias("field"), F.array("upper").alias("cands"))]
    for fields in (NAMES, RELATIONS):
        per_field += [F.struct(F.lit(n).alias("field"), c(script).alias("cands")) for script, n in fields.items()]
    exploded = wide.select("query_id", F.inline(F.array(*per_field)))
    return exploded.select("query_id", "field", F.explode("cands").alias("cand")).where(c("cand") != "")


# ------------------------------------------------------------- value matches
def match_values(values: DataFrame, candidates: DataFrame, mode: str = "all") -> DataFrame:
    """Best hit(score, label) of every query for every distinct value it matches.

    The label of a relative's name is completed when records are joined back.
    """
    fuzzy = mode in S.FUZZY_MODES
    value, cand = c("value"), c("cand")
    pairs = containing_pairs(values, candidates)
    if fuzzy:
        pairs = pairs.unionByName(near_pairs(values, candidates))
    related = [(value == cand, S.REL_EXACT, ""), (value.contains(cand), S.REL_PART, " (Partial)")]
    coded = [(value == cand, *S.TEXT_ID_EXACT), (value.contains(cand), *S.TEXT_ID_PART)]
    hit = (
        F.when(c("field") == NAMES["lat"], S.best_tier(S.name_tiers(value, cand, "lat", fuzzy)))
        .when(c("field") == NAMES["dev"], S.best_tier(S.name_tiers(value, cand, "dev", fuzzy)))
        .when(c("field") == CODE, S.best_tier(coded))
        .otherwise(S.best_tier(related))
    )
    scored = pairs.withColumn("hit", hit).where(c("hit").isNotNull())
    return scored.groupBy("query_id", "field", "value").agg(F.max("hit").alias("hit"))


# -------------------------------------------------------------------- search
def search_many(records: DataFrame, queries: DataFrame, mode: str = "all") -> DataFrame:
    """(query_id, record_id, score, label) of every match of every query.

    The value dictionary and the candidates are written once, since several
    steps read them.
    """
    values = cut_lineage(value_dictionary(records), "values")
    candidates = cut_lineage(query_candidates(queries), "candidates")
    houses = queries.select(
        "query_id", F.lit(HOUSE).alias("field"), normalize_house(c("query")).alias("value"),
        F.struct(F.lit(S.HOUSE[0]).alias("score"), F.lit(S.HOUSE[1]).alias("label")).alias("hit"),
    ).where(c("value") != "")
    matches = match_values(values, candidates, mode).unionByName(houses)

    texts = records.select("record_id", "relation_type", F.inline(_field_values())).where(c("value") != "")
    found = texts.join(matches, ["field", "value"])
    related = c("field").isin(list(RELATIONS.values()))
    label = F.when(related, F.concat(S.relation_label(c("relation_type")), c("hit.label"))).otherwise(c("hit.label"))
    best = found.groupBy("query_id", "record_id").agg(
        F.max(F.struct(c("hit.score").alias("score"), label.alias("label"))).alias("hit")
    )
    return best.select("query_id", "record_id", "hit.score", "hit.label")


def top_per_query(matches: DataFrame, page: int = 1, limit: int = S.DEFAULT_PAGE) -> DataFrame:
    """One page per query, ``rank`` from 1; each task keeps only the rows that can be on it."""
    offset, rows = S.page_bounds(page, limit)
    w = Window.partitionBy("query_id").orderBy(c("score").desc(), c("record_id").asc())
    ranked = matches.withColumn("rank", F.row_number().over(w)).where(c("rank") <= offset + rows)
    return ranked.where(c("rank") > offset)


def query_totals(queries: DataFrame, matches: DataFrame, limit: int = S.DEFAULT_PAGE) -> DataFrame:
    """Matches and pages per query; a query without any has 0 matches and one page."""
    _, rows = S.page_bounds(1, limit)
    counts = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", n.alias("total"), F.greatest(F.ceil(n / rows), F.lit(1)).cast("bigint").alias("total_pages")
    )
