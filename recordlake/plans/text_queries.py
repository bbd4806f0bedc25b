"""Text normalisation, coding and transliteration over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scanned, text, translit
from ..functions import fixed
from ..functions.phonetic import sound_key, sound_key_sql
from .registry import query
from .views import DEVANAGARI_LETTERS, LATIN_LETTERS, r_sql, register, table

c = F.col


@query(
    "script_profile",
    """
    WITH d AS (
      SELECT lang, CASE
        WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') AND regexp_matches(text, '[a-zA-Z]') THEN 'mixed'
        WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'devanagari'
        WHEN regexp_matches(text, '[a-zA-Z]') THEN 'latin'
        WHEN regexp_matches(text, '^\\s*[0-9]+\\s*$') THEN 'numeric' ELSE 'unknown' END AS script
      FROM documents)
    SELECT lang, script, count(*) AS n FROM d GROUP BY lang, script
    """,
)
def script_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", text.detect_script(c("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


# A Devanagari rendering of the documents, with signs that need normalising:
# digits, a bar, a candrabindu (q), a joiner (x) and a nukta (z).
_SIGNS_FROM = LATIN_LETTERS[:16] + "qrstuvwxyz0123456789|"
_SIGNS_TO = (
    DEVANAGARI_LETTERS[:16] + "\u0901" + DEVANAGARI_LETTERS[17:23] + "\u200D" + DEVANAGARI_LETTERS[24]
    + "\u093C" + fixed.DEVANAGARI_DIGITS + "\u0964"
)
_COMPOSED_SQL = "t"
for _spelled, _composed in fixed.COMPOSED_LETTERS.items():
    _COMPOSED_SQL = f"replace({_COMPOSED_SQL}, '{_spelled}', '{_composed}')"


@query(
    "norm_devanagari",
    f"""
    WITH s AS (SELECT doc_id, translate(lower(text), '{_SIGNS_FROM}', '{_SIGNS_TO}') AS t FROM documents),
    n AS (SELECT doc_id, {_COMPOSED_SQL} AS t FROM s),
    z AS (SELECT doc_id, regexp_replace(translate(t, '{fixed.ZERO_WIDTH}', ''),
            '([कखगजडढफय])\\x{{093C}}', '\\1', 'g') AS t FROM n)
    SELECT doc_id, trim(regexp_replace(translate(t, '\u0901\u0964\u0965|{fixed.DEVANAGARI_DIGITS}',
            '\u0902   0123456789'), '[^\\x{{0900}}-\\x{{097F}}0-9a-zA-Z/_-]+', ' ', 'g')) AS norm_text
    FROM z
    """,
)
def norm_devanagari(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    signs = F.translate(F.lower("text"), _SIGNS_FROM, _SIGNS_TO)
    return docs.select("doc_id", text.normalize_devanagari(signs).alias("norm_text"))


@query(
    "norm_latin",
    """
    SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9/_-]+', ' ', 'g')) AS norm_text
    FROM documents
    """,
)
def norm_latin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_latin(c("text")).alias("norm_text"))


@query(
    "norm_id_code",
    """
    SELECT c_custkey, regexp_replace(upper(replace(c_name, '#', ' / ') || '-' || c_mktsegment || '.x_y\\'),
      '[\\s\\-_.\\\\]', '', 'g') AS id_code FROM customer
    """,
)
def norm_id_code(spark, sf_dir):
    raw = F.concat(F.replace("c_name", F.lit("#"), F.lit(" / ")), F.lit("-"), c("c_mktsegment"), F.lit(".x_y\\"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_id_code(raw).alias("id_code"))


_HOUSE_CASES = """CASE p_partkey % 6 WHEN 0 THEN 'H.No. ' WHEN 1 THEN 'house no: ' WHEN 2 THEN ' म.क्र. '
      WHEN 3 THEN 'मकान नं. :' WHEN 4 THEN 'गृह सं ' ELSE 'Flat ' END || CAST(p_size AS VARCHAR) || '-' || p_brand"""


@query(
    "norm_house",
    f"""
    SELECT p_partkey, trim(regexp_replace(trim({_HOUSE_CASES}),
      '^(h\\.?\\s*no\\.?|house\\s*no\\.?|म\\.?\\s*क्र\\.?|मकान\\s*नं\\.?|गृह\\s*सं\\.?)\\s*:?', '', 'i')) AS house
    FROM part
    """,
)
def norm_house(spark, sf_dir):
    labels = ["H.No. ", "house no: ", " म.क्र. ", "मकान नं. :", "गृह सं ", "Flat "]
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (c("p_partkey") % 6 + 1).cast("int"))
    raw = F.concat(label, c("p_size").cast("string"), F.lit("-"), c("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_house(raw).alias("house"))


# Scanned-looking codes: letters where digits belong and the other way round.
_SCANNED_SQL = """CASE WHEN p_partkey % 11 = 0 THEN NULL
  WHEN p_partkey % 3 = 0 THEN translate('A8C' || lpad(CAST(p_partkey AS VARCHAR), 7, '0'), '0126', 'OISB')
  WHEN p_partkey % 3 = 1 THEN 'a5c-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')
  ELSE 'wb/' || CAST(p_partkey AS VARCHAR) END"""


def _scanned_code():
    key = c("p_partkey")
    padded = F.lpad(key.cast("string"), 7, "0")
    return (
        F.when(key % 11 == 0, None)
        .when(key % 3 == 0, F.translate(F.concat(F.lit("A8C"), padded), "0126", "OISB"))
        .when(key % 3 == 1, F.concat(F.lit("a5c-"), padded))
        .otherwise(F.concat(F.lit("wb/"), key.cast("string")))
    )


@query(
    "ocr_id_repair",
    f"""
    WITH s AS (SELECT p_partkey, {_SCANNED_SQL} AS raw FROM part),
    b AS (SELECT *, regexp_replace(upper(trim(coalesce(raw, ''))), '[\\s\\-_.:]', '', 'g') AS base FROM s),
    f AS (SELECT *, CASE WHEN length(base) = 10
        THEN translate(left(base, 3), '0158', 'OISB') || translate(substr(base, 4), 'OISBZ', '01582')
        ELSE base END AS fixed FROM b)
    SELECT p_partkey, fixed AS id_code,
      CASE WHEN raw IS NULL THEN 0.0
           WHEN NOT regexp_matches(fixed, '^[A-Z0-9/]{{6,16}}$') THEN 0.70
           WHEN fixed <> base THEN 0.92 ELSE 0.99 END::DOUBLE AS confidence,
      CASE WHEN raw IS NULL THEN 0 ELSE CAST(left(fixed, 3) <> left(base, 3) AS INTEGER)
        + CAST(substr(fixed, 4) <> substr(base, 4) AS INTEGER) END::INTEGER AS n_repairs
    FROM f
    """,
)
def ocr_id_repair(spark, sf_dir):
    repaired = table(spark, sf_dir, "part").select("p_partkey", scanned.repair_id_code(_scanned_code()).alias("f"))
    return repaired.select(
        "p_partkey", c("f.value").alias("id_code"), c("f.confidence").alias("confidence"),
        F.size("f.repairs").alias("n_repairs"),
    )


@query(
    "ocr_name_conf",
    """
    WITH s AS (SELECT doc_id, trim(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS t FROM documents),
    v AS (SELECT doc_id, t, trim(regexp_replace(regexp_replace(replace(t, '|', ' '),
        '^(?:नाम|मतदाता\\s*का\\s*नाम|निर्वाचक\\s*का\\s*नाम|Name)\\s*[:：.]?\\s*', '', 'i'),
        '[^\\x{0900}-\\x{097F}a-zA-Z]+', ' ', 'g')) AS value FROM s)
    SELECT doc_id, value, CASE WHEN t = '' THEN 0.0 WHEN length(value) < 2 THEN 0.40
      WHEN length(value) > 50 THEN 0.70 ELSE 0.95 END::DOUBLE AS confidence FROM v
    """,
)
def ocr_name_conf(spark, sf_dir):
    cleaned = table(spark, sf_dir, "documents").select("doc_id", scanned.clean_name(c("text")).alias("f"))
    return cleaned.select("doc_id", c("f.value").alias("value"), c("f.confidence").alias("confidence"))


@query(
    "ocr_house",
    """
    WITH s AS (SELECT page_id, 'House No. ' || split_part(url, '/', 3) || '|#' || CAST(page_id AS VARCHAR) AS raw
               FROM pages)
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(raw, '|', ' '),
      '^House\\s*No\\.?\\s*[:：.]?\\s*', '', 'i'), '[^a-zA-Z0-9\\s/_.-]', '', 'g'), '\\s+', ' ', 'g')) AS house
    FROM s
    """,
)
def ocr_house(spark, sf_dir):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    raw = F.concat(F.lit("House No. "), host, F.lit("|#"), c("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", scanned.clean_house(raw)["value"].alias("house"))


@query(
    "ocr_age",
    """
    WITH s AS (SELECT p_partkey, 'आयु ' || translate(CAST(p_size * (p_partkey % 4) AS VARCHAR),
        '0123456789', '०१२३४५६७८९') AS raw FROM part),
    m AS (SELECT p_partkey, TRY_CAST(nullif(regexp_extract(translate(raw, '०१२३४५६७८९', '0123456789'),
        '[0-9]{2,3}'), '') AS INTEGER) AS age FROM s)
    SELECT p_partkey, age, CASE WHEN age IS NULL THEN 0.30 WHEN age BETWEEN 18 AND 130 THEN 0.98
      ELSE 0.60 END::DOUBLE AS confidence FROM m
    """,
)
def ocr_age(spark, sf_dir):
    digits = F.translate((c("p_size") * (c("p_partkey") % 4)).cast("string"), fixed.ASCII_DIGITS, fixed.DEVANAGARI_DIGITS)
    parsed = table(spark, sf_dir, "part").select(
        "p_partkey", scanned.parse_age(F.concat(F.lit("आयु "), digits)).alias("f")
    )
    return parsed.select("p_partkey", c("f.age").alias("age"), c("f.confidence").alias("confidence"))


@query(
    "ocr_text",
    """
    SELECT conv_id, turn, trim(regexp_replace(replace(text, '|', ' '),
      '[\\s\\x{00A0}\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]+', ' ', 'g')) AS ocr_text FROM conversations
    """,
)
def ocr_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.normalize_ocr_text(c("text")).alias("ocr_text")
    )


@query(
    "code_gender",
    """
    WITH s AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Male' WHEN 1 THEN 'f' WHEN 2 THEN '1'
        WHEN 3 THEN '2' WHEN 4 THEN 'Third gender' WHEN 5 THEN 'पुरुष' WHEN 6 THEN 'स्त्री' ELSE p_type END AS raw
      FROM part)
    SELECT p_partkey, CASE WHEN lower(raw) LIKE 'm%' OR raw LIKE '%पुरुष%' OR raw LIKE '%मेल%' OR raw = '1' THEN 'MALE'
      WHEN lower(raw) LIKE 'f%' OR raw LIKE '%महिला%' OR raw LIKE '%स्त्री%' OR raw = '2' THEN 'FEMALE'
      WHEN lower(raw) LIKE '%other%' OR lower(raw) LIKE '%third%' OR raw LIKE '%अन्य%' THEN 'OTHER'
      ELSE 'UNKNOWN' END AS gender FROM s
    """,
)
def code_gender(spark, sf_dir):
    spellings = ["Male", "f", "1", "2", "Third gender", "पुरुष", "स्त्री"]
    options = F.array(*[F.lit(x) for x in spellings], c("p_type"))
    raw = F.element_at(options, (c("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.code_gender(raw).alias("gender"))


@query(
    "code_relation",
    """
    WITH s AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Father' WHEN 1 THEN 'H' WHEN 2 THEN 'माता'
        WHEN 3 THEN 'other' WHEN 4 THEN ' ' ELSE NULL END AS raw,
      CASE WHEN p_partkey % 7 = 5 THEN p_name END AS husband FROM part)
    SELECT p_partkey, CASE
      WHEN trim(coalesce(raw, '')) <> '' THEN CASE
        WHEN lower(raw) LIKE '%fat%' OR raw LIKE '%पित%' OR lower(raw) = 'f' THEN 'FATHER'
        WHEN lower(raw) LIKE '%hus%' OR raw LIKE '%पत%' OR lower(raw) = 'h' THEN 'HUSBAND'
        WHEN lower(raw) LIKE '%mot%' OR raw LIKE '%मात%' OR lower(raw) = 'm' THEN 'MOTHER'
        WHEN lower(raw) LIKE '%oth%' OR raw LIKE '%अन्य%' THEN 'OTHER' ELSE 'UNKNOWN' END
      WHEN trim(coalesce(husband, '')) <> '' THEN 'HUSBAND' ELSE 'UNKNOWN' END AS relation_type FROM s
    """,
)
def code_relation(spark, sf_dir):
    spellings = ["Father", "H", "माता", "other", " "]
    key = c("p_partkey") % 7
    raw = F.get(F.array(*[F.lit(x) for x in spellings]), key.cast("int"))
    husband = F.when(key == 5, c("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.code_relation(raw, husband=husband).alias("relation_type")
    )


@query(
    "parse_int_prefix",
    """
    WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || 'A'
        WHEN 1 THEN ' -' || CAST(p_size AS VARCHAR) WHEN 2 THEN '0' ELSE p_name END AS raw FROM part)
    SELECT p_partkey, coalesce(nullif(TRY_CAST(nullif(regexp_extract(trim(raw), '^[+-]?[0-9]+'), '') AS INTEGER), 0),
      CAST(p_partkey % 1000 AS INTEGER)) AS serial FROM s
    """,
)
def parse_int_prefix(spark, sf_dir):
    size = c("p_size").cast("string")
    options = F.array(F.concat(size, F.lit("A")), F.concat(F.lit(" -"), size), F.lit("0"), c("p_name"))
    raw = F.get(options, (c("p_partkey") % 4).cast("int"))
    fallback = (c("p_partkey") % 1000).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_int_prefix(raw, fallback).alias("serial"))


@query(
    "sanitize_text",
    """
    SELECT page_id, trim(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F<>]+', '', 'g'),
      E' \\t\\n\\r') AS clean FROM pages
    """,
)
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_text(c("html")).alias("clean"))


@query(
    "sanitize_filename",
    """
    WITH b AS (SELECT page_id, left(regexp_replace(regexp_replace(
        regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'),
        '[^a-zA-Z0-9.\\-_]', '_', 'g'), '\\.{2,}', '.', 'g'), 150) AS f FROM pages)
    SELECT page_id, CASE WHEN f = '' THEN 'document.pdf' ELSE f END AS filename FROM b
    """,
)
def sanitize_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_filename(c("url")).alias("filename"))


# --------------------------------------------------------- transliteration
def _duck_map(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in entries.items()) + "}"


_TOKENS = "|".join(
    sorted({*fixed.LATIN_CONSONANTS, *fixed.LATIN_VOWEL_SIGNS}, key=lambda k: (-len(k), k))
)


@query(
    "translit_to_dev",
    f"""
    WITH names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT lower(n_name) FROM nation),
    w AS (SELECT name, i, word FROM (SELECT name, unnest(string_split(trim(regexp_replace(lower(name),
        '[^a-z0-9/_-]+', ' ', 'g')), ' ')) AS word, generate_subscripts(string_split(trim(regexp_replace(
        lower(name), '[^a-z0-9/_-]+', ' ', 'g')), ' '), 1) AS i FROM names)),
    t AS (SELECT *, regexp_extract_all(word, '{_TOKENS}|.') AS toks FROM w),
    s AS (SELECT name, i, array_to_string(list_transform(range(1, len(toks) + 1), lambda j: CASE
        WHEN j = 1 THEN coalesce({_duck_map(fixed.LATIN_INITIAL_VOWELS)}[toks[1]],
             {_duck_map({**fixed.LATIN_CONSONANTS, **fixed.LATIN_VOWEL_SIGNS})}[toks[1]], toks[1])
        WHEN toks[j] = 'a' AND j < len(toks) THEN ''
        ELSE coalesce({_duck_map({**fixed.LATIN_CONSONANTS, **fixed.LATIN_VOWEL_SIGNS})}[toks[j]], toks[j]) END), '')
        AS spelled FROM t)
    SELECT name, string_agg(spelled, ' ' ORDER BY i) AS first_spelling FROM s GROUP BY name
    """,
)
def translit_to_dev(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(c("p_name").alias("name")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).distinct()
    return names.union(nations).distinct().select("name", translit.first_devanagari(c("name")).alias("first_spelling"))


@query(
    "translit_to_lat",
    f"""
    WITH names AS (SELECT DISTINCT translate(p_name, '{LATIN_LETTERS}', '{DEVANAGARI_LETTERS}') AS name FROM part),
    w AS (SELECT name, unnest(string_split(name, ' ')) AS word,
          generate_subscripts(string_split(name, ' '), 1) AS i FROM names),
    s AS (SELECT name, i, array_to_string(list_transform(range(1, length(word) + 1), lambda j:
        coalesce({_duck_map({**fixed.DEVANAGARI_VOWELS, **fixed.DEVANAGARI_CONSONANTS})}[substr(word, j, 1)],
                 substr(word, j, 1))
        || CASE WHEN j < length(word) AND contains('{"".join(fixed.DEVANAGARI_CONSONANTS)}', substr(word, j, 1))
             AND NOT contains('{"".join(fixed.DEVANAGARI_VOWELS)}{fixed.HALANT}', substr(word, j + 1, 1))
             THEN 'a' ELSE '' END), '') AS latin FROM w)
    SELECT name, string_agg(upper(left(latin, 1)) || substr(latin, 2), ' ' ORDER BY i) AS latin
    FROM s GROUP BY name
    """,
)
def translit_to_lat(spark, sf_dir):
    spelled = F.translate("p_name", LATIN_LETTERS, DEVANAGARI_LETTERS).alias("name")
    names = table(spark, sf_dir, "part").select(spelled).distinct()
    return names.select("name", translit.to_latin(c("name")).alias("latin"))


_COMPOUND_SQL = """replace(p_name, ' ', '') || CASE p_partkey % 4 WHEN 0 THEN 'kumar' WHEN 1 THEN ' devi'
      WHEN 2 THEN 'Singh' ELSE '' END"""


def _compound():
    endings = F.array(F.lit("kumar"), F.lit(" devi"), F.lit("Singh"), F.lit(""))
    return F.concat(
        F.replace("p_name", F.lit(" "), F.lit("")), F.get(endings, (c("p_partkey") % 4).cast("int"))
    )


@query(
    "expand_suffix",
    f"""
    WITH q AS (SELECT DISTINCT {_COMPOUND_SQL} AS query FROM part),
    e AS (SELECT unnest({fixed.LATIN_NAME_ENDINGS}) AS ending)
    SELECT query, replace(query, ' ', '') AS form FROM q
    UNION SELECT query, left(lower(query), length(query) - length(ending)) || ' ' || ending FROM q, e
      WHERE NOT contains(query, ' ') AND ends_with(lower(query), ending) AND length(query) > length(ending)
    """,
)
def expand_suffix(spark, sf_dir):
    queries = table(spark, sf_dir, "part").select(_compound().alias("query")).distinct()
    return queries.select("query", F.explode(translit.split_name_endings(c("query"))).alias("form"))


@query("expand_query")
def expand_query(spark, sf_dir):
    queries = table(spark, sf_dir, "part").select(_compound().alias("query")).distinct()
    return queries.select(
        "query", translit.query_script(c("query")).alias("script"),
        F.posexplode(translit.expand_query(c("query"))).alias("candidate_no", "candidate"),
    )


_SOUND = "regexp_replace(" * 6 + "{x}" + "".join(f", '{d}+', '{d}', 'g')" for d in "123456")


@query(
    "soundex_groups",
    r_sql(
        """, w AS (SELECT record_id, regexp_extract(upper(norm_name_lat), '^[A-Z]+') AS t FROM r WHERE norm_name_lat <> ''),
    d AS (SELECT record_id, left(t, 1) AS first, translate(translate(substr(t, 2), 'HW', ''),
        'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556') AS code,
        translate(left(t, 1), 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000000111122222222334556') AS c1 FROM w),
    s AS (SELECT record_id, first, """
        + _SOUND.format(x="c1 || code")
        + """ AS run FROM d)
    SELECT first || left(replace(substr(run, 2), '0', '') || '000', 3) AS sound, count(*) AS n,
      min(record_id) AS first_record FROM s GROUP BY sound"""
    ),
)
def soundex_groups(spark, sf_dir):
    named = register(spark, sf_dir).where(c("norm_name_lat") != "")
    # The key is that of the first word; the whole name blocks too finely to be of use.
    sound = F.soundex(F.split_part("norm_name_lat", F.lit(" "), F.lit(1)))
    return named.groupBy(sound.alias("sound")).agg(
        F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_record")
    )


@query(
    "sound_keys",
    r_sql(
        f"SELECT record_id, {sound_key_sql('name_lat')} AS key_lat, {sound_key_sql('name_dev')} AS key_dev, "
        f"{sound_key_sql('rel_name_lat')} AS key_rel FROM r"
    ),
)
def sound_keys(spark, sf_dir):
    keys = {"key_lat": "name_lat", "key_dev": "name_dev", "key_rel": "rel_name_lat"}
    return register(spark, sf_dir).select("record_id", *[sound_key(c(x)).alias(k) for k, x in keys.items()])


@query(
    "sound_groups",
    r_sql(
        f""", k AS (SELECT record_id, unnest([{sound_key_sql('name_lat')}, {sound_key_sql('name_dev')}]) AS sound FROM r)
        SELECT sound, count(DISTINCT record_id) AS n, min(record_id) AS first_record FROM k WHERE sound IS NOT NULL GROUP BY sound"""
    ),
)
def sound_groups(spark, sf_dir):
    """Records that sound alike in either script, each counted once for a sound."""
    both = F.array_distinct(F.array_compact(F.array(sound_key(c("name_lat")), sound_key(c("name_dev")))))
    each = register(spark, sf_dir).select("record_id", F.explode(both).alias("sound"))
    return each.groupBy("sound").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_record"))
