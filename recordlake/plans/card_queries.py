"""Page text to cards: header fields, blocks, card fields, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import card_patterns as P
from ..operators import cards
from ..operators.keyed import carry_forward
from ..session import cut_lineage
from .registry import query
from .views import r_sql, register, table

c = F.col

CARDS_PER_PAGE = 10
FILES = 20


def register_pages(spark, sf_dir):
    """Printed register pages made from R: ten cards per page, twenty files, a header on page 1.

    Every seventh card is stacked (labels first), the others are inline; every
    43rd is marked deleted. A section heading stands on every third page.
    """
    r = register(spark, sf_dir)
    key = c("record_id")
    place = F.floor(key / FILES)
    code = F.when(F.length("id_code") > 6, c("id_code")).otherwise("NO-CODE")
    relation = (
        F.when(c("relation_type") == "FATHER", "पिता का नाम")
        .when(c("relation_type") == "HUSBAND", "पति का नाम")
        .when(c("relation_type") == "MOTHER", "माता का नाम")
        .otherwise("अन्य का नाम")
    )
    rel = F.coalesce(c("rel_name_dev"), F.lit("कखग"))
    name = F.coalesce(c("name_dev"), F.lit(""))
    age = F.translate(F.coalesce(c("age").cast("string"), F.lit("")), "0123456789", "०१२३४५६७८९")
    gender = F.when(c("gender") == "MALE", "पुरुष").when(c("gender") == "FEMALE", "महिला").otherwise("-")
    mark = F.when(key % 43 == 0, "\nDELETED").otherwise("")
    serial = (place % 1000 + 2).cast("string")
    house = F.concat(F.lit("म.क्र. "), (key % 7).cast("string"))
    inline = F.concat(
        serial, F.lit(" "), code, F.lit("\nनिर्वाचक का नाम: "), name, F.lit("\n"), relation, F.lit(": "), rel,
        F.lit("\nमकान संख्या: "), house, F.lit("\nउम्र: "), age, F.lit(" लिंग: "), gender, mark,
    )
    stacked = F.concat(
        serial, F.lit(" "), code, F.lit("\nमतदाता का नाम:\n"), relation, F.lit("\nमकान संख्या\nआयु: "), age,
        F.lit(" लिंग: "), gender, F.lit("\n"), house, F.lit("\n"), name, F.lit("\n"), rel, mark,
    )
    stack = (key % 7 == 0) & c("age").isNotNull() & c("name_dev").isNotNull()
    texts = r.select(
        (key % FILES).alias("file_id"),
        (F.floor(place / CARDS_PER_PAGE) + 1).cast("int").alias("page_no"),
        place.alias("at"),
        F.when(stack, stacked).otherwise(inline).alias("card"),
    )
    pages = texts.groupBy("file_id", "page_no").agg(
        # Ten cards per page by construction.
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "card"))), lambda x: x["card"]), "\n").alias("body")
    )
    header = F.when(
        c("page_no") == 1,
        F.concat(
            F.lit("विधानसभा क्षेत्र: "), c("file_id").cast("string"), F.lit(" अबच\nवार्ड संख्या: "),
            (c("file_id") + 5).cast("string"), F.lit("\nभाग संख्या : "), (c("file_id") * 3).cast("string"), F.lit("\n"),
        ),
    ).otherwise("")
    section = F.when(c("page_no") % 3 == 1, "गहइ नगर\n").otherwise("")
    pages = pages.select("file_id", "page_no", F.concat(header, section, "body").alias("page_text"))
    return cut_lineage(pages, "pages")


# What the cards say, straight from R. Names of 20 letters at most, so a serial
# + code line always has its code where the record has one of six characters.
_CARDS_SQL = """, k AS (
  SELECT *, CAST(floor(record_id / 20) AS BIGINT) AS place, record_id % 20 AS file_id,
    nullif(CASE WHEN id_code = 'AB1' THEN NULL ELSE id_code END, '') AS code,
    coalesce(name_dev, '') AS dev, record_id % 43 = 0 AS deleted,
    CASE WHEN age BETWEEN 1 AND 125 THEN age END AS card_age
  FROM r), cards AS (
  SELECT *, CAST(floor(place / 10) AS INTEGER) + 1 AS page_no,
    CAST(place % 1000 + 2 AS INTEGER) AS serial FROM k)
"""


@query(
    "page_header_fields",
    """
    WITH s AS (SELECT page_id,
      nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title,
      nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
      nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '') AS h1 FROM pages)
    SELECT page_id % 50 AS file_id, arg_min(title, page_id) FILTER (title IS NOT NULL) AS title,
      arg_min(lang, page_id) FILTER (lang IS NOT NULL) AS lang, arg_min(h1, page_id) FILTER (h1 IS NOT NULL) AS h1,
      count(*) AS n_pages
    FROM s GROUP BY page_id % 50
    """,
)
def page_header_fields(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        (c("page_id") % 50).alias("file_id"), c("page_id").alias("page_no"), c("html").alias("page_text")
    )
    patterns = {
        "title": "<title>([^<]*)</title>",
        "lang": '<html lang="([a-z]+)"',
        "h1": "<h1>([^<]*)</h1>",
    }
    facts = cards.page_facts(pages, patterns)
    return cards.header_fields(facts, list(patterns)).withColumnRenamed("key_rows", "n_pages")


@query(
    "carry_forward",
    """
    SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN text END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS said FROM conversations
    """,
)
def carry_forward_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(c("role") != "assistant", c("text")).alias("heading")
    )
    return carry_forward(turns, "conv_id", "turn", "heading", "said", block_rows=4).drop("heading")


@query(
    "split_blocks",
    """
    WITH s AS (SELECT page_id, string_split(html, '<p>') AS p FROM pages),
    b AS (SELECT page_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS t FROM s)
    SELECT page_id, CASE WHEN i > 1 THEN '<p>' || t ELSE t END AS block FROM b
    WHERE length(trim(CASE WHEN i > 1 THEN '<p>' || t ELSE t END)) >= 15
    """,
)
def split_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    blocks = F.filter(F.split("html", "(?=<p>)"), lambda x: F.length(F.trim(x)) >= P.MIN_CARD_CHARS)
    return pages.select("page_id", F.explode(blocks).alias("block"))


@query(
    "line_blocks",
    r_sql(
        _CARDS_SQL
        + """SELECT file_id, page_no, count(*) AS n_blocks FROM cards WHERE true GROUP BY file_id, page_no"""
    ),
)
def line_blocks(spark, sf_dir):
    pages = register_pages(spark, sf_dir)
    return cards.card_texts(pages).groupBy("file_id", "page_no").agg(F.count(F.lit(1)).alias("n_blocks"))


@query(
    "card_fields",
    r_sql(
        _CARDS_SQL
        + """SELECT file_id, page_no, serial, code AS id_code, nullif(dev, '') AS name_dev,
          CASE WHEN relation_type = 'UNKNOWN' THEN 'OTHER' ELSE relation_type END AS relation_type,
          coalesce(translate(rel_name_lat, 'abcdefghijklmnopqrstuvwxyz', 'अबचदएफगहइजकलमनओपखरसतउवथयझठ'), 'कखग') AS rel_name_dev,
          CASE WHEN gender IN ('MALE', 'FEMALE') THEN gender ELSE 'UNKNOWN' END AS gender, card_age AS age,
          CAST(record_id % 7 AS VARCHAR) AS house_number, deleted,
          CASE WHEN deleted THEN 'REJECTED' WHEN code IS NULL OR card_age IS NULL OR card_age < 18 THEN 'WARNING'
            ELSE 'VALID' END AS status,
          'गहइ नगर' AS section, CAST(file_id AS VARCHAR) || ' अबच' AS constituency,
          CAST(file_id + 5 AS VARCHAR) AS ward, CAST(file_id * 3 AS VARCHAR) AS part
        FROM cards WHERE dev <> '' OR code IS NOT NULL"""
    ),
)
def card_fields(spark, sf_dir):
    found = cards.extract_cards(register_pages(spark, sf_dir))
    return found.select(
        "file_id", "page_no", c("source_serial_number").alias("serial"), "id_code", "name_dev", "relation_type",
        "rel_name_dev", "gender", "age", "house_number", "deleted", "status", "section", "constituency", "ward", "part",
    )


@query(
    "extraction_report",
    r_sql(
        _CARDS_SQL
        + """, g AS (SELECT * FROM cards WHERE dev <> '' OR code IS NOT NULL),
        p AS (SELECT file_id, count(DISTINCT page_no) AS pages FROM cards GROUP BY file_id)
        SELECT file_id, pages, count(*) AS records,
          count(*) FILTER (code IS NULL OR card_age IS NULL OR card_age < 18 OR deleted) AS records_to_review,
          count(*) FILTER (code IS NULL) AS id_code_reviews,
          count(*) FILTER (card_age IS NULL OR card_age < 18) AS age_reviews,
          round(avg(CASE WHEN code IS NULL THEN 0.85 ELSE 0.98 END), 4)::DOUBLE AS average_confidence
        FROM g JOIN p USING (file_id) GROUP BY file_id, pages"""
    ),
)
def extraction_report(spark, sf_dir):
    pages = register_pages(spark, sf_dir)
    return cards.extraction_report(pages, cards.parse_cards(cards.card_texts(cards.card_pages(pages))))


@query(
    "card_records",
    r_sql(
        _CARDS_SQL
        + """SELECT CAST(file_id AS VARCHAR) AS source_file_id, page_no AS source_page_number,
          count(*) AS n, count(DISTINCT record_id) AS n_ids, count(name_dev) AS n_names,
          count(code) AS n_codes FROM cards WHERE dev <> '' OR code IS NOT NULL GROUP BY file_id, page_no"""
    ),
)
def card_records(spark, sf_dir):
    found = cards.cards_to_records(cards.extract_cards(register_pages(spark, sf_dir)))
    return found.groupBy("source_file_id", "source_page_number").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("n_ids"),
        F.count("name_lat").alias("n_names"), F.count("id_code").alias("n_codes"),
    )


@query(
    "extract_fields",
    """
    SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title,
      nullif(regexp_extract(html, '&copy; ([a-z0-9.]+)', 1), '') AS owner,
      TRY_CAST(nullif(regexp_extract(html, '<!-- ad ([0-9]+)', 1), '') AS INTEGER) AS ad_no FROM pages
    """,
)
def extract_fields(spark, sf_dir):
    html = c("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.nullif(cards.first_match(html, "<title>([^<]*)</title>"), F.lit("")).alias("title"),
        cards.first_match(html, r"&copy; ([a-z0-9.]+)").alias("owner"),
        cards.first_match(html, "<!-- ad ([0-9]+)").try_cast("int").alias("ad_no"),
    )


@query(
    "review_reasons",
    r_sql(
        """, d AS (SELECT *, record_id % 43 = 0 AS deleted FROM r)
        SELECT record_id, concat_ws('; ', CASE WHEN id_code IS NULL THEN 'Missing official id code' END,
          CASE WHEN age IS NULL THEN 'Missing age' WHEN age NOT BETWEEN 18 AND 130
            THEN 'Age ' || CAST(age AS VARCHAR) || ' is outside the accepted range (18-130)' END,
          CASE WHEN deleted THEN 'Marked DELETED in supplementary list' END) AS reasons,
          CASE WHEN deleted THEN 'REJECTED' WHEN id_code IS NULL OR age IS NULL OR age NOT BETWEEN 18 AND 130
            THEN 'WARNING' ELSE 'VALID' END AS card_status,
          CASE WHEN id_code IS NULL THEN 0.85 ELSE 0.98 END::DOUBLE AS card_confidence FROM d"""
    ),
)
def review_reasons(spark, sf_dir):
    r = register(spark, sf_dir).withColumn("deleted", c("record_id") % 43 == 0)
    reasons = cards.review_reasons(c("id_code"), c("age"), c("deleted"))
    r = r.withColumn("_reasons", reasons)
    return r.select(
        "record_id", F.array_join("_reasons", "; ").alias("reasons"),
        cards.card_status(c("deleted"), c("_reasons")).alias("card_status"),
        cards.card_confidence(c("id_code")).alias("card_confidence"),
    )
