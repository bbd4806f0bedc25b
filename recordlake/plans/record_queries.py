"""Reading, header resolution, canonical records, files, pages and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import audit, records
from ..session import work_folder
from ..sources import files, json_items, tabular
from .registry import query
from .views import r_sql, register, table

c = F.col

# Header names as register files carry them, built from the column names of the given tables.
_HEADERS_SQL = """
WITH h AS (
  SELECT DISTINCT 'Voter_' || p_type || '_' || p_brand AS header FROM part
  UNION SELECT DISTINCT 'FATHER_NAME ' || p_type FROM part
  UNION SELECT DISTINCT p_brand || ' page' FROM part
  UNION SELECT DISTINCT 'Sec-AGE-' || p_brand FROM part
  UNION SELECT DISTINCT o_orderpriority || '.Ward No.' FROM orders
  UNION SELECT DISTINCT c_mktsegment || '_SEX' FROM customer
  UNION SELECT DISTINCT 'Epic ' || c_mktsegment FROM customer
  UNION SELECT DISTINCT event_type || '_slno' FROM events
), s AS (SELECT header, regexp_replace(lower(header), '[\\s_\\-.]', '', 'g') AS q,
    regexp_split_to_array(lower(header), '[\\s_\\-.]+') AS words FROM h)
"""


def _like_any(hints: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{h}')" for h in hints) + ")"


_HINT_CASE = "CASE " + " ".join(
    f"WHEN list_has_any(words, {hints}) THEN '{name}'" for name, hints in fixed.HEADER_WORD_HINTS
) + " " + " ".join(f"WHEN {_like_any(hints)} THEN '{name}'" for name, hints in fixed.HEADER_HINTS) + " END"


@query("header_mapping", _HEADERS_SQL + f"SELECT header, {_HINT_CASE} AS field FROM s")
def header_mapping(spark, sf_dir):
    def distinct(name, value):
        return table(spark, sf_dir, name).select(value.alias("header")).distinct()

    brand, kind = c("p_brand"), c("p_type")
    parts = [
        distinct("part", F.concat(F.lit("Voter_"), kind, F.lit("_"), brand)),
        distinct("part", F.concat(F.lit("FATHER_NAME "), kind)),
        distinct("part", F.concat(brand, F.lit(" page"))),
        distinct("part", F.concat(F.lit("Sec-AGE-"), brand)),
        distinct("orders", F.concat(c("o_orderpriority"), F.lit(".Ward No."))),
        distinct("customer", F.concat(c("c_mktsegment"), F.lit("_SEX"))),
        distinct("customer", F.concat(F.lit("Epic "), c("c_mktsegment"))),
        distinct("events", F.concat(c("event_type"), F.lit("_slno"))),
    ]
    headers = parts[0]
    for p in parts[1:]:
        headers = headers.union(p)
    return records.suggest_fields(headers.distinct()).select("header", "field")


def _tabular_input(spark, sf_dir):
    """Register rows under one of the usual headers, with blanks and a second house column."""
    r = register(spark, sf_dir)
    odd = c("record_id") % 2 == 1
    return r.select(
        "ingest_seq",
        "batch_id",
        "source_file_id",
        F.when(odd, c("source_serial_number").cast("string")).otherwise("").alias("SERIAL NO"),
        c("id_code").alias("EPIC_No"),
        F.coalesce("name_lat", F.lit(" ")).alias("voter_name"),
        F.when(c("relation_type") == "HUSBAND", c("rel_name_lat")).alias("husband_name"),
        F.when(c("relation_type") == "FATHER", c("rel_name_lat")).alias("father_name"),
        F.lower("gender").alias("Sex"),
        F.concat(c("age").cast("string"), F.lit(" yrs")).alias("age"),
        F.when(odd, " ").otherwise(c("house_number")).alias("house_number"),
        F.when(odd, c("house_number")).alias("House-No"),
        c("ward").alias("Ward.No"),
    )


@query(
    "resolve_columns",
    r_sql("SELECT record_id, house_number AS house, nullif(id_code, '') AS id_code FROM r"),
)
def resolve_columns(spark, sf_dir):
    rows = _tabular_input(spark, sf_dir)
    return rows.select(
        c("ingest_seq").alias("record_id"),
        records.resolve(rows.columns, "house").alias("house"),
        records.resolve(rows.columns, "id_code").alias("id_code"),
    )


_CANONICAL_SQL = r_sql(
    """, k AS (SELECT *, CASE WHEN relation_type IN ('FATHER', 'HUSBAND') THEN rel_name_lat END AS rel FROM r)
    SELECT ingest_seq, batch_id, source_file_id,
      CAST(CASE WHEN record_id % 2 = 1 AND source_serial_number <> 0 THEN source_serial_number
           ELSE ingest_seq END AS INTEGER) AS source_serial_number,
      id_code, norm_name_lat AS name_lat,
      CASE WHEN rel IS NOT NULL THEN relation_type ELSE 'UNKNOWN' END AS relation_type,
      rel AS rel_name_lat,
      CASE WHEN gender = 'X' THEN 'UNKNOWN' ELSE gender END AS gender,
      age, norm_house AS house_number, ward,
      'P-1' AS part, CASE WHEN id_code IS NULL OR age IS NULL OR age < 18 THEN 'WARNING' ELSE 'VALID' END AS status,
      0.98::DOUBLE AS confidence
    FROM k WHERE name_lat IS NOT NULL"""
)
_CANONICAL = [
    "ingest_seq", "batch_id", "source_file_id", "source_serial_number", "id_code", "name_lat",
    "relation_type", "rel_name_lat", "gender", "age", "house_number", "ward", "part", "status", "confidence",
]


@query("canonical_records", _CANONICAL_SQL)
def canonical_records(spark, sf_dir):
    rows = _tabular_input(spark, sf_dir)
    return records.canonical_records(rows, metadata={"part": "P-1"}).select(_CANONICAL)


@query(
    "canonical_names",
    r_sql(
        """SELECT record_id, norm_name_lat, name_dev IS NOT NULL AS has_dev,
        CASE WHEN rel_name_lat IS NULL THEN 'UNKNOWN' ELSE 'MOTHER' END AS relation_type
        FROM r WHERE name_lat IS NOT NULL"""
    ),
)
def canonical_names(spark, sf_dir):
    r = register(spark, sf_dir)
    rows = r.select("ingest_seq", c("name_lat").alias("Name_EN"), c("rel_name_lat").alias("mother_name"))
    out = records.canonical_records(rows)
    return out.select(
        c("ingest_seq").alias("record_id"), "norm_name_lat", c("name_dev").isNotNull().alias("has_dev"), "relation_type"
    )


@query(
    "csv_roundtrip",
    r_sql(
        """SELECT record_id, id_code, name_lat, name_dev, house_number || ' "q", x' AS house_number,
        CAST(row_number() OVER (PARTITION BY source_file_id ORDER BY record_id) AS BIGINT) AS position
        FROM r"""
    ),
)
def csv_roundtrip(spark, sf_dir):
    r = register(spark, sf_dir).select(
        "record_id", "id_code", "name_lat", "name_dev",
        F.concat("house_number", F.lit(' "q", x')).alias("house_number"), "source_file_id",
    )
    folder = work_folder(spark, "csv")
    # One file per source, rows in order. Spark cuts a large source by the record id range.
    spread = r.repartitionByRange("source_file_id").sortWithinPartitions("source_file_id", "record_id")
    spread.write.partitionBy("source_file_id").option("header", True).option("escape", '"').csv(folder)
    back = tabular.read_delimited(spark, folder)
    return back.select(
        c("record_id").cast("bigint").alias("record_id"), "id_code", "name_lat", "name_dev", "house_number",
        c("ingest_seq").alias("position"),
    )


@query(
    "content_hash",
    """
    SELECT doc_id, sha256(text) AS file_hash_sha256, octet_length(encode(text)) AS file_size_bytes,
      left(sha256(text), 12) || '_' || regexp_replace(source || ' ' || lang || '.txt', '[^a-zA-Z0-9._-]', '_', 'g')
        AS storage_name
    FROM documents
    """,
)
def content_hash(spark, sf_dir):
    from ..functions.text import stored_name

    sha = F.sha2(c("text").cast("binary"), 256)
    name = F.concat(c("source"), F.lit(" "), c("lang"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", sha.alias("file_hash_sha256"),
        F.octet_length("text").cast("bigint").alias("file_size_bytes"), stored_name(sha, name).alias("storage_name"),
    )


@query(
    "file_signature",
    """
    WITH s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'CSV' WHEN 2 THEN 'XLSX'
        ELSE 'PDF' END AS expected, CASE WHEN page_id % 4 = 3 THEN '%PDF-' || html
        WHEN page_id % 8 = 2 THEN 'PK' || chr(3) || chr(4) || html WHEN page_id % 40 = 0 THEN '' ELSE html END AS content
      FROM pages)
    SELECT page_id, expected, CASE WHEN content = '' THEN 'file is empty'
      WHEN expected = 'PDF' AND NOT starts_with(content, '%PDF-') THEN 'missing PDF signature'
      WHEN expected = 'XLSX' AND NOT starts_with(content, 'PK' || chr(3) || chr(4)) THEN 'missing ZIP signature'
      WHEN expected = 'CSV' AND contains(hex(left(content, 1024)), '@@') THEN 'NUL byte in text' END AS problem
    FROM s
    """,
)
def file_signature(spark, sf_dir):
    pid = c("page_id")
    expected = F.when(pid % 4 == 1, "CSV").when(pid % 4 == 2, "XLSX").otherwise("PDF")
    content = (
        F.when(pid % 4 == 3, F.concat(F.lit("%PDF-"), c("html")))
        .when(pid % 8 == 2, F.concat(F.lit("PK\x03\x04"), c("html")))
        .when(pid % 40 == 0, "")
        .otherwise(c("html"))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", expected.alias("expected"), content.cast("binary").alias("b"))
    return pages.select("page_id", "expected", files.signature_verdict(c("b"), c("expected"))["problem"].alias("problem"))


@query(
    "split_pages",
    """
    WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
    SELECT doc_id, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS page_no, unnest(p) AS page_text FROM s
    """,
)
def split_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return files.split_pages(docs, "text", "\n").drop("text")


@query(
    "json_items",
    """
    WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, user_id FROM events),
    i AS (SELECT event_id, 1 AS n, k, event_type, user_id FROM e UNION ALL
          SELECT event_id, 2, 0, 'deleted ' || event_type, user_id FROM e WHERE event_id % 3 = 0)
    SELECT event_id, CAST(CASE WHEN n = 1 AND k > 0 THEN k ELSE n END AS INTEGER) AS source_serial_number,
      event_type AS name_lat, 'XYZ' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS id_code,
      CAST(CASE WHEN k BETWEEN 1 AND 125 THEN k END AS INTEGER) AS age,
      CASE WHEN n = 2 THEN 'REJECTED' ELSE 'VALID' END AS status, 1::BIGINT AS rows_of_id
    FROM i
    """,
)
def json_items_query(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    code = F.concat(F.lit("xyz-"), F.lpad(c("user_id").cast("string"), 7, "0"))

    def item(serial, name, deleted):
        return F.to_json(
            F.struct(
                serial.alias("serial_number"), name.alias("name_en"), code.alias("epic"),
                serial.alias("age"), F.lit(deleted).alias("is_deleted"),
            )
        )

    one = item(k.cast("int"), c("event_type"), False)
    two = item(F.lit(0), F.concat(F.lit("deleted "), c("event_type")), True)
    both = F.concat(F.lit("```json\n["), one, F.lit(","), two, F.lit("]\n```"))
    wrapped = F.concat(F.lit('{"voters": ['), one, F.lit("]}"))
    noisy = F.concat(F.lit("Here you are: ["), one, F.lit("] done"))
    reply = F.when(c("event_id") % 3 == 0, both).when(c("event_id") % 3 == 1, wrapped).otherwise(noisy)
    replies = table(spark, sf_dir, "events").select(
        c("event_id").cast("string").alias("source_file_id"), reply.alias("reply")
    )
    out = json_items.items_to_records(replies, "reply")
    # Ids are unique unless a reply is delivered twice, so no window is large. A join would parse every reply again, and
    # be a broadcast of all ids: the planner's sizes shrink with the columns of an item that are dropped.
    return out.withColumn("rows_of_id", F.count(F.lit(1)).over(Window.partitionBy("record_id"))).select(
        c("source_file_id").cast("bigint").alias("event_id"), "source_serial_number", "name_lat", "id_code", "age", "status",
        "rows_of_id",
    )


_EXPORT_SQL = """SELECT CAST(source_serial_number AS VARCHAR) AS source_serial_number, {code} AS id_code,
      coalesce(name_dev, '') AS name_dev, coalesce(name_lat, '') AS name_lat, relation_type,
      coalesce(translate(rel_name_lat, 'abcdefghijklmnopqrstuvwxyz', 'अबचदएफगहइजकलमनओपखरसतउवथयझठ'), '') AS rel_name_dev,
      coalesce(rel_name_lat, '') AS rel_name_lat, gender, coalesce(CAST(age AS VARCHAR), '') AS age,
      {house} AS house_number, coalesce(ward, '') AS ward, coalesce(part, '') AS part,
      constituency, status FROM r"""


@query("export_projection", r_sql(_EXPORT_SQL.format(code="coalesce(id_code, '')", house="house_number")))
def export_projection(spark, sf_dir):
    return audit.export_projection(register(spark, sf_dir), masked=False, headers=False)


_MASKED_SQL = r_sql(
    _EXPORT_SQL.format(
        code="CASE WHEN length(id_code) > 6 THEN left(id_code, 3) || '****' || right(id_code, 3) "
        "WHEN length(id_code) > 0 THEN '****' ELSE '' END",
        house="left(house_number, 1) || '*'",
    )
)


@query("masked_export", _MASKED_SQL)
def masked_export(spark, sf_dir):
    return audit.export_projection(register(spark, sf_dir), headers=False)


@query("export_file", _MASKED_SQL)
def export_file(spark, sf_dir):
    folder = work_folder(spark, "export")
    audit.write_export(register(spark, sf_dir), folder)
    back = spark.read.option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(folder)
    # An empty cell is read as null.
    return back.select(*[F.coalesce(c(f"`{header}`"), F.lit("")).alias(name) for header, name in audit.EXPORT_COLUMNS.items()])
