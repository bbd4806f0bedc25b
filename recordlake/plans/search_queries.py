"""Search, facets, batch search, similarity and token search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import ranked, search_batch, similarity, text_index
from ..operators.search import SearchFilters, search
from ..session import work_folder
from .registry import ORACLES, query
from .views import r_sql, register, table

c = F.col


def _ids(matches):
    return matches.select("record_id", "score")


def _run(spark, sf_dir, **filters):
    return search(register(spark, sf_dir), SearchFilters(**filters))


@query(
    "search_id",
    r_sql(
        """SELECT record_id, CASE WHEN id_code = 'ABC0000007' THEN 100 ELSE 60 END AS score FROM r
        WHERE contains(id_code, 'ABC0000007')"""
    ),
)
def search_id(spark, sf_dir):
    return _ids(_run(spark, sf_dir, id_code=" abc-0000007").matches)


@query(
    "search_id_partial",
    r_sql("SELECT record_id, 60 AS score FROM r WHERE contains(id_code, '00012')"),
)
def search_id_partial(spark, sf_dir):
    return _ids(_run(spark, sf_dir, id_code="00012").matches)


def name_score_sql(q: str, fuzzy: bool = True) -> str:
    """Score of a one-candidate Latin query against R."""
    j = q.replace(" ", "")
    typo = f"WHEN length(norm_name_lat) > 3 AND levenshtein(norm_name_lat, '{q}') <= 2 THEN 65" if fuzzy else ""
    return f"""greatest(
      CASE WHEN norm_name_lat = '{q}' THEN 95 WHEN replace(norm_name_lat, ' ', '') = '{j}' THEN 85
        WHEN starts_with(replace(norm_name_lat, ' ', ''), '{j}') THEN 75 WHEN contains(norm_name_lat, '{q}') THEN 70
        {typo} ELSE 0 END,
      CASE WHEN norm_name_lat = '{j}' THEN 95 WHEN contains(norm_name_lat, '{j}') THEN 70
        {typo.replace(q, j)} ELSE 0 END,
      CASE WHEN norm_rel_lat IN ('{q}', '{j}') THEN 55 WHEN contains(norm_rel_lat, '{q}') OR contains(norm_rel_lat, '{j}')
        THEN 45 ELSE 0 END,
      CASE WHEN contains(id_code, upper('{q}')) THEN 80 ELSE 0 END,
      CASE WHEN norm_house = '{q}' THEN 40 ELSE 0 END)"""


def scored_sql(q: str, fuzzy: bool = True) -> str:
    return f", s AS (SELECT *, {name_score_sql(q, fuzzy)} AS score FROM r), m AS (SELECT * FROM s WHERE score > 0)\n"


@query(
    "search_fuzzy",
    r_sql(scored_sql("smal widget") + "SELECT record_id, score FROM m ORDER BY score DESC, record_id LIMIT 100"),
)
def search_fuzzy(spark, sf_dir):
    return _ids(_run(spark, sf_dir, query="smal widget", limit=100).page)


@query("search_text", r_sql(scored_sql("widget") + "SELECT record_id, score FROM m"))
def search_text(spark, sf_dir):
    return _ids(_run(spark, sf_dir, query="Widget").matches)


@query("search_exact_mode", r_sql(scored_sql("red bolt", fuzzy=False) + "SELECT record_id, score FROM m"))
def search_exact_mode(spark, sf_dir):
    return _ids(_run(spark, sf_dir, query="red bolt", mode="exact").matches)


@query(
    "search_labels",
    r_sql(
        """SELECT record_id, 'Matched Name (Prefix)' AS labels FROM r WHERE norm_name_lat LIKE 'blue%' AND NOT contains(norm_rel_lat, 'blue')
        UNION ALL SELECT record_id, 'Matched Name (Prefix)' FROM r WHERE norm_name_lat LIKE 'blue%' AND norm_rel_lat IS NULL"""
    ),
)
def search_labels(spark, sf_dir):
    found = _run(spark, sf_dir, query="blue", mode="exact").matches
    return found.select("record_id", F.array_join(F.array_sort("matched_fields"), "; ").alias("labels"))


@query(
    "search_devanagari",
    r_sql(
        """, q AS (SELECT *, translate('red', 'abcdefghijklmnopqrstuvwxyz', 'अबचदएफगहइजकलमनओपखरसतउवथयझठ') AS t FROM r)
        SELECT record_id, CASE WHEN norm_name_dev = t THEN 95 WHEN starts_with(norm_name_dev, t) THEN 75 ELSE 70 END AS score
        FROM q WHERE contains(norm_name_dev, t)"""
    ),
)
def search_devanagari(spark, sf_dir):
    from .views import DEVANAGARI_LETTERS, LATIN_LETTERS

    word = "red".translate(str.maketrans(LATIN_LETTERS, DEVANAGARI_LETTERS))
    found = _run(spark, sf_dir, query=word, mode="exact").matches
    return _ids(found)


@query(
    "search_relation",
    r_sql(
        """SELECT record_id, CASE WHEN norm_rel_lat = 'gear promo' THEN 55 ELSE 45 END AS score,
        'Matched ' || CASE relation_type WHEN 'FATHER' THEN 'Father Name' WHEN 'HUSBAND' THEN 'Husband Name'
          WHEN 'MOTHER' THEN 'Mother Name' ELSE 'Relation Name' END AS label
        FROM r WHERE contains(norm_rel_lat, 'gear promo')"""
    ),
)
def search_relation(spark, sf_dir):
    found = _run(spark, sf_dir, query="gear promo", mode="exact").matches
    return found.select("record_id", "score", F.get("matched_fields", F.lit(0)).alias("label"))


@query("filter_name", r_sql("SELECT record_id, 70 AS score FROM r WHERE contains(norm_name_lat, 'gear')"))
def filter_name(spark, sf_dir):
    return _ids(_run(spark, sf_dir, name="Gear").matches)


@query("filter_relation", r_sql("SELECT record_id, 65 AS score FROM r WHERE contains(norm_rel_lat, 'plate')"))
def filter_relation(spark, sf_dir):
    return _ids(_run(spark, sf_dir, relation_name="Plate").matches)


@query(
    "filter_structured",
    r_sql(
        """SELECT record_id, 50 AS score FROM r WHERE gender = 'FEMALE' AND relation_type = 'MOTHER' AND area = 'S1'
        AND (age IS NULL OR age BETWEEN 20 AND 50) AND constituency IN ('C1', 'C2', 'C3') AND constituency = 'C2'"""
    ),
)
def filter_structured(spark, sf_dir):
    return _ids(
        _run(
            spark, sf_dir, gender="FEMALE", relation_type="MOTHER", area="S1", min_age=20, max_age=50, constituency="C2"
        ).matches
    )


@query("filter_serial", r_sql("SELECT record_id, 50 AS score FROM r WHERE source_serial_number = 5 AND part = 'PROMO'"))
def filter_serial(spark, sf_dir):
    return _ids(_run(spark, sf_dir, serial=5, part="PROMO").matches)


@query("filter_house", r_sql("SELECT record_id, 40 AS score FROM r WHERE contains(norm_house, '3') AND ward = 'Brand#3'"))
def filter_house(spark, sf_dir):
    return _ids(_run(spark, sf_dir, house="H.No. 3", ward="Brand#3").matches)


@query(
    "sorted_page",
    r_sql(
        scored_sql("bolt")
        + """SELECT record_id, score, coalesce(age, 0) AS age FROM m ORDER BY coalesce(age, 0), record_id LIMIT 20 OFFSET 40"""
    ),
)
def sorted_page(spark, sf_dir):
    page = _run(spark, sf_dir, query="bolt", sort_by="age", descending=False, page=3).page
    return page.select("record_id", "score", F.coalesce("age", F.lit(0)).alias("age"))


@query(
    "ranked_matches",
    r_sql(
        scored_sql("bolt")
        + """SELECT row_number() OVER (ORDER BY coalesce(age, 0), record_id) AS rank, record_id, score, coalesce(age, 0) AS age FROM m"""
    ),
)
def ranked_matches(spark, sf_dir):
    """Every match with its rank: one stored result serves all pages."""
    filters = {"query": "bolt", "sort_by": "age", "descending": False}
    path = work_folder(spark, "ranked")
    ranked.store(_run(spark, sf_dir, **filters).matches, path, S.sort_columns(SearchFilters(**filters)), ranges=16)
    return ranked.ranked(spark, path).select("rank", "record_id", "score", F.coalesce("age", F.lit(0)).alias("age"))


_DEEP_PAGES = (1, 41, 97)  # pages of 50 rows


@query(
    "deep_pages",
    """SELECT rank, event_id, event_type, value FROM (SELECT event_id, event_type, value, row_number() OVER
      (ORDER BY event_type DESC, value, event_id) AS rank FROM events) WHERE (rank - 1) // 50 + 1 IN (1, 41, 97)""",
)
def deep_pages(spark, sf_dir):
    """Three pages of all events; five event types hold all rows, so every one of them is split over ranges."""
    path = work_folder(spark, "ranked")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    ranked.store(events, path, [c("event_type").desc(), c("value"), c("event_id")], ranges=32)
    first, *more = [ranked.page(spark, path, number, 50) for number in _DEEP_PAGES]
    for one in more:
        first = first.unionByName(one)
    return first


@query(
    "facets",
    r_sql(
        scored_sql("bolt")
        + """SELECT CASE WHEN grouping(gender) = 0 THEN 'gender' WHEN grouping(ward) = 0 THEN 'ward'
          WHEN grouping(part) = 0 THEN 'part' ELSE 'total' END AS facet,
        CASE WHEN grouping(gender) = 0 THEN gender WHEN grouping(ward) = 0 THEN ward
          WHEN grouping(part) = 0 THEN part ELSE 'all' END AS value, count(*) AS n
        FROM m GROUP BY GROUPING SETS ((gender), (ward), (part), ())
        HAVING coalesce(CASE WHEN grouping(gender) = 0 THEN gender WHEN grouping(ward) = 0 THEN ward
          WHEN grouping(part) = 0 THEN part ELSE 'all' END, '') <> ''"""
    ),
)
def facets(spark, sf_dir):
    return _run(spark, sf_dir, query="bolt").facets


# ------------------------------------------------------------- batch search
def query_table(spark, sf_dir):
    """Queries taken from the tables: every part name with a letter dropped, every type, code and house."""
    parts = table(spark, sf_dir, "part")
    typos = parts.select(
        F.concat(F.left("p_name", F.lit(2)), F.substring("p_name", 4, 100)).alias("query")
    ).distinct()
    kinds = parts.select(F.concat(F.lit("gear "), F.lower("p_type")).alias("query")).distinct()
    codes = parts.select(
        F.concat(F.lit("abc"), F.lpad((c("p_partkey") % 1900).cast("string"), 7, "0")).alias("query")
    ).distinct()
    houses = parts.select((c("p_partkey") % 7).cast("string").alias("query")).distinct()
    texts = typos.union(kinds).union(codes).union(houses).distinct()
    return texts.select(c("query").alias("query_id"), "query")


_QUERY_SQL = """, q AS (SELECT DISTINCT left(p_name, 2) || substr(p_name, 4) AS q FROM part
  UNION SELECT DISTINCT 'gear ' || lower(p_type) FROM part
  UNION SELECT DISTINCT 'abc' || lpad(CAST(p_partkey % 1900 AS VARCHAR), 7, '0') FROM part
  UNION SELECT DISTINCT CAST(p_partkey % 7 AS VARCHAR) FROM part),
  qq AS (SELECT q, replace(q, ' ', '') AS j FROM q),
  v AS (SELECT DISTINCT norm_name_lat AS n FROM r WHERE norm_name_lat <> ''),
  w AS (SELECT DISTINCT norm_rel_lat AS n FROM r WHERE norm_rel_lat IS NOT NULL),
  nv AS (SELECT q, n, greatest(CASE WHEN n = q THEN 95 WHEN replace(n, ' ', '') = j THEN 85
      WHEN starts_with(replace(n, ' ', ''), j) THEN 75 WHEN contains(n, q) OR contains(n, j) THEN 70
      WHEN length(n) > 3 AND (levenshtein(n, q) <= 2 OR levenshtein(n, j) <= 2) THEN 65 ELSE 0 END) AS score FROM qq, v),
  nr AS (SELECT q, n, CASE WHEN n IN (q, j) THEN 55 WHEN contains(n, q) OR contains(n, j) THEN 45 ELSE 0 END AS score FROM qq, w),
  hits AS (
    SELECT q, record_id, score FROM nv JOIN r ON norm_name_lat = n WHERE score > 0
    UNION ALL SELECT q, record_id, score FROM nr JOIN r ON norm_rel_lat = n WHERE score > 0
    UNION ALL SELECT q, record_id, CASE WHEN id_code = upper(q) THEN 100 ELSE 80 END FROM q JOIN r ON contains(id_code, upper(q))
    UNION ALL SELECT q, record_id, 40 FROM q JOIN r ON norm_house = q),
  best AS (SELECT q AS query_id, record_id, max(score) AS score FROM hits GROUP BY q, record_id)
"""


@query("search_batch", r_sql(_QUERY_SQL + "SELECT * FROM best"))
def search_batch_query(spark, sf_dir):
    found = search_batch.search_many(register(spark, sf_dir), query_table(spark, sf_dir))
    return found.select("query_id", "record_id", "score")


@query(
    "top_k_per_query",
    r_sql(
        _QUERY_SQL
        + """SELECT query_id, record_id, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM best)
        WHERE rank > 10 AND rank <= 20"""
    ),
)
def top_k_per_query(spark, sf_dir):
    found = search_batch.search_many(register(spark, sf_dir), query_table(spark, sf_dir))
    return search_batch.top_per_query(found, page=2, limit=10).select("query_id", "record_id", "score", "rank")


@query(
    "totals_per_query",
    r_sql(
        _QUERY_SQL
        + """SELECT q AS query_id, count(record_id) AS total,
        CAST(greatest(ceil(count(record_id) / 20.0), 1) AS BIGINT) AS total_pages
        FROM q LEFT JOIN best ON q = query_id GROUP BY q"""
    ),
)
def totals_per_query(spark, sf_dir):
    queries = query_table(spark, sf_dir)
    found = search_batch.search_many(register(spark, sf_dir), queries)
    return search_batch.query_totals(queries, found)


# --------------------------------------------------------------- similarity
def grams_sql(text: str) -> str:
    """Distinct padded trigrams of a normalised text."""
    return f"""list_distinct(flatten(list_transform(list_filter(string_split({text}, ' '), lambda w: w <> ''),
      lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def overlap_sql(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE))"


@query(
    "trigram_search",
    r_sql(
        f""", g AS (SELECT *, {grams_sql("norm_name_lat")} AS a, {grams_sql("'small widgit'")} AS b FROM r WHERE norm_name_lat <> ''),
        s AS (SELECT *, {overlap_sql("a", "b")} AS sim FROM g)
        SELECT record_id, sim AS name_similarity, 40 * sim AS score FROM s
        WHERE sim > 0.3 AND gender = 'MALE' AND age >= 20"""
    ),
)
def trigram_search(spark, sf_dir):
    filters = SearchFilters(name="small widgit", gender="MALE", min_age=20)
    found = similarity.trigram_search(register(spark, sf_dir), filters)
    return found.select("record_id", "name_similarity", "score")


@query(
    "trigram_join",
    f"""
    WITH q AS (SELECT DISTINCT left(p_name, 2) || substr(p_name, 4) || 's' AS query FROM part),
    v AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS value FROM part),
    qg AS (SELECT query, {grams_sql("query")} AS a FROM q), vg AS (SELECT value, {grams_sql("value")} AS b FROM v)
    SELECT query, value, {overlap_sql("a", "b")} AS similarity FROM qg, vg WHERE {overlap_sql("a", "b")} > 0.5
    """,
)
def trigram_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    typo = F.concat(F.left("p_name", F.lit(2)), F.substring("p_name", 4, 100), F.lit("s"))
    value = F.concat_ws(" ", c("p_name"), F.lower("p_type"))
    return similarity.trigram_join(parts.select(typo.alias("query")), parts.select(value.alias("value")), 0.5)


_TERMS = ["the", "tion", "are", "aux", "von", "es", "with"]


@query(
    "token_search",
    f"""
    WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9/_-]+', ' ', 'g')), ' ') AS w
      FROM documents),
    t AS (SELECT unnest({_TERMS}) AS term),
    h AS (SELECT doc_id, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, t),
    f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term),
    n AS (SELECT count(*) AS n FROM documents)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS n_terms, round(sum(tf * ln((1 + n) / (1 + df)::DOUBLE)), 6) AS score
    FROM h JOIN f USING (term), n WHERE tf > 0 GROUP BY doc_id
    """,
)
def token_search(spark, sf_dir):
    found = similarity.token_search(table(spark, sf_dir, "documents"), "doc_id", "text", _TERMS)
    return found.withColumn("score", F.round("score", 6))


_WORDS_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9/_-]+', ' ', 'g')), ' '),
    lambda x: x <> '') AS w FROM documents)"""
_PHRASE = ["the", "and", "of", "the"]


def _indexed(spark, sf_dir):
    """An index of the documents, added in two batches."""
    path = work_folder(spark, "text-index")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for batch in (0, 1):
        text_index.add_batch(docs.where(c("doc_id") % 2 == batch), path, str(batch), buckets=8, splits=2)
    return text_index.Index(spark, path, buckets=8)


@query("index_token_search", ORACLES["token_search"])
def index_token_search(spark, sf_dir):
    return _indexed(spark, sf_dir).tf_idf(_TERMS).withColumn("score", F.round("score", 6))


@query(
    "index_bm25",
    _WORDS_SQL
    + f""",
    t AS (SELECT unnest({_TERMS}) AS term),
    h AS (SELECT doc_id, term, len(w) AS size, len(list_filter(w, lambda x: x = term)) AS tf FROM d, t),
    f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term),
    n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS n_terms, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
      / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 6) AS score
    FROM h JOIN f USING (term), n WHERE tf > 0 GROUP BY doc_id
    """,
)
def index_bm25(spark, sf_dir):
    return _indexed(spark, sf_dir).bm25(_TERMS).withColumn("score", F.round("score", 6))


@query(
    "index_phrase",
    _WORDS_SQL
    + f""",
    p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {len(_PHRASE) - 1})) AS i FROM d WHERE len(w) >= {len(_PHRASE)})
    SELECT doc_id, count(*) AS n_matches, CAST(min(i) - 1 AS INTEGER) AS first_place FROM p WHERE w[i:i + {len(_PHRASE) - 1}] = {_PHRASE} GROUP BY doc_id
    """,
)
def index_phrase(spark, sf_dir):
    return _indexed(spark, sf_dir).phrase(_PHRASE)
