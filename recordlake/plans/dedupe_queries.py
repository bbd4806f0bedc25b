"""Duplicate clusters, members, households."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe, entities
from .registry import query
from .views import r_sql, register, table

c = F.col

_SERIAL_KEY = "'file_' || source_file_id || '_s_' || source_serial_number"
_COMPOSITE_KEY = """replace(norm_name_lat, ' ', '') || '_rel_' || replace(norm_rel_lat, ' ', '') || '_h_' || norm_house
  || '_age_' || coalesce(CAST(CAST(floor(age / 2.0) * 2 AS BIGINT) AS VARCHAR), 'noage')"""

_CLUSTERS_SQL = f""", c AS (
  SELECT 'DUPLICATE_EPIC' AS duplicate_type, id_code AS cluster_key, count(*) AS n_members,
    CAST(min(record_id) AS VARCHAR) AS first_member, 0.99 AS confidence
  FROM r WHERE id_code IS NOT NULL GROUP BY id_code HAVING count(*) > 1
  UNION ALL SELECT 'DUPLICATE_SERIAL_PART', {_SERIAL_KEY}, count(*), CAST(min(record_id) AS VARCHAR), 0.95
  FROM r WHERE source_serial_number <> 0 GROUP BY source_file_id, source_serial_number HAVING count(*) > 1
  UNION ALL SELECT 'POSSIBLE_DUPLICATE_RECORD', {_COMPOSITE_KEY} AS k, count(*), CAST(min(record_id) AS VARCHAR),
    CASE WHEN count(DISTINCT id_code) > 1 THEN 0.75 ELSE 0.88 END
  FROM r WHERE length(replace(norm_name_lat, ' ', '')) >= 3 AND length(replace(norm_rel_lat, ' ', '')) >= 3
  GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT 'REPEATED_IMPORT', sha256(text), count(*), CAST(min(doc_id) AS VARCHAR), 1.0
  FROM documents GROUP BY text HAVING count(*) > 1)
"""
_COLUMNS = "cluster_key, n_members, first_member, confidence::DOUBLE AS confidence"


def document_files(spark, sf_dir):
    """Documents as registered source files."""
    return table(spark, sf_dir, "documents").select(
        c("doc_id").alias("source_file_id"), F.sha2(c("text").cast("binary"), 256).alias("file_hash_sha256")
    )


def _plain(clusters):
    return clusters.select("cluster_key", "n_members", c("first_member").cast("string").alias("first_member"), "confidence")


@query("dup_exact_key", r_sql(_CLUSTERS_SQL + f"SELECT {_COLUMNS} FROM c WHERE duplicate_type = 'DUPLICATE_EPIC'"))
def dup_exact_key(spark, sf_dir):
    return _plain(dedupe.exact_id_clusters(register(spark, sf_dir)))


@query("dup_serial_scope", r_sql(_CLUSTERS_SQL + f"SELECT {_COLUMNS} FROM c WHERE duplicate_type = 'DUPLICATE_SERIAL_PART'"))
def dup_serial_scope(spark, sf_dir):
    return _plain(dedupe.serial_clusters(register(spark, sf_dir)))


@query("dup_composite", r_sql(_CLUSTERS_SQL + f"SELECT {_COLUMNS} FROM c WHERE duplicate_type = 'POSSIBLE_DUPLICATE_RECORD'"))
def dup_composite(spark, sf_dir):
    return _plain(dedupe.composite_clusters(register(spark, sf_dir)))


@query("dup_content_hash", r_sql(_CLUSTERS_SQL + f"SELECT {_COLUMNS} FROM c WHERE duplicate_type = 'REPEATED_IMPORT'"))
def dup_content_hash(spark, sf_dir):
    return _plain(dedupe.repeated_imports(document_files(spark, sf_dir)))


@query(
    "dup_summary",
    r_sql(
        _CLUSTERS_SQL
        + """SELECT t AS duplicate_type, count(cluster_key) AS n_clusters, coalesce(sum(n_members), 0)::BIGINT AS n_members
        FROM (SELECT unnest(['DUPLICATE_EPIC', 'DUPLICATE_SERIAL_PART', 'POSSIBLE_DUPLICATE_RECORD', 'REPEATED_IMPORT']) AS t)
        LEFT JOIN c ON t = duplicate_type GROUP BY t"""
    ),
)
def dup_summary(spark, sf_dir):
    clusters = dedupe.all_clusters(register(spark, sf_dir), document_files(spark, sf_dir))
    return dedupe.cluster_summary(clusters)


@query(
    "dup_members",
    r_sql(
        """SELECT id_code AS cluster_key, record_id, n_members, record_id = first_id AS is_first FROM (
        SELECT *, count(*) OVER (PARTITION BY id_code) AS n_members, min(record_id) OVER (PARTITION BY id_code) AS first_id
        FROM r WHERE id_code IS NOT NULL) WHERE n_members > 1"""
    ),
)
def dup_members(spark, sf_dir):
    return dedupe.cluster_members(register(spark, sf_dir), dedupe.id_key())


@query(
    "dup_cluster_files",
    r_sql(
        """SELECT DISTINCT id_code AS cluster_key, source_file_id FROM r
        WHERE id_code IN (SELECT id_code FROM r GROUP BY id_code HAVING count(*) > 1)"""
    ),
)
def dup_cluster_files(spark, sf_dir):
    return dedupe.cluster_files(register(spark, sf_dir), dedupe.id_key())


@query(
    "repeated_import_members",
    """
    SELECT sha256(text) AS cluster_key, doc_id AS source_file_id, n_members, doc_id = first_id AS is_first FROM (
      SELECT *, count(*) OVER (PARTITION BY text) AS n_members, min(doc_id) OVER (PARTITION BY text) AS first_id
      FROM documents) WHERE n_members > 1
    """,
)
def repeated_import_members(spark, sf_dir):
    return dedupe.cluster_members(document_files(spark, sf_dir), c("file_hash_sha256"), "source_file_id")


@query(
    "duplicate_of",
    r_sql(
        """SELECT record_id, CASE WHEN length(id_code) >= 6 AND first_id <> record_id THEN first_id END AS duplicate_of FROM (
        SELECT *, min(record_id) OVER (PARTITION BY id_code) AS first_id FROM r)"""
    ),
)
def duplicate_of(spark, sf_dir):
    return dedupe.mark_duplicate_of(register(spark, sf_dir)).select("record_id", "duplicate_of")


@query(
    "dup_local_key",
    r_sql(
        """SELECT record_id, CASE WHEN part IS NOT NULL AND first_id <> record_id THEN first_id END AS duplicate_of FROM (
        SELECT *, min(record_id) OVER (PARTITION BY constituency, part, source_serial_number) AS first_id FROM r)"""
    ),
)
def dup_local_key(spark, sf_dir):
    return dedupe.mark_duplicate_of(register(spark, sf_dir), dedupe.local_key()).select("record_id", "duplicate_of")


@query(
    "dup_age_range",
    r_sql(
        """, k AS (SELECT * FROM r WHERE age IS NOT NULL AND norm_rel_lat IS NOT NULL AND part IS NOT NULL)
        SELECT a.record_id, count(*) AS n_partners,
          CASE WHEN min(b.record_id) < a.record_id THEN min(b.record_id) ELSE max(b.record_id) END AS partner
        FROM k a JOIN k b ON a.norm_name_lat = b.norm_name_lat AND a.norm_rel_lat = b.norm_rel_lat AND a.part = b.part
          AND a.norm_house = b.norm_house AND abs(a.age - b.age) <= 1 AND a.record_id <> b.record_id GROUP BY a.record_id"""
    ),
)
def dup_age_range(spark, sf_dir):
    matched = dedupe.age_range_matches(register(spark, sf_dir), ["norm_name_lat", "norm_rel_lat", "norm_house", "part"])
    return matched.select("record_id", "n_partners", "partner")


_HOUSE_SQL = """, h AS (SELECT *, CASE WHEN norm_house NOT IN ('-', '0') THEN norm_house END AS house FROM r)
"""


@query(
    "household_groups",
    r_sql(
        _HOUSE_SQL
        + """SELECT ward, part, house AS norm_house, count(*) AS total_members, max(age) AS head_age,
        arg_max(record_id, (coalesce(age, 0), -source_serial_number, -ingest_seq)) AS head_record_id
        FROM h WHERE house IS NOT NULL GROUP BY ward, part, house"""
    ),
)
def household_groups(spark, sf_dir):
    return dedupe.household_stats(register(spark, sf_dir))


@query(
    "household_of",
    r_sql(
        _HOUSE_SQL
        + """, g AS (SELECT ward, part, house, count(*) AS n,
          arg_max(record_id, (coalesce(age, 0), -source_serial_number, -ingest_seq)) AS head
          FROM h WHERE house IS NOT NULL GROUP BY ward, part, house)
        SELECT record_id, coalesce(n, 1) AS total_members, coalesce(head, record_id) AS head_record_id
        FROM h LEFT JOIN g ON h.house = g.house AND h.ward IS NOT DISTINCT FROM g.ward AND h.part IS NOT DISTINCT FROM g.part"""
    ),
)
def household_of(spark, sf_dir):
    found = dedupe.household_members(register(spark, sf_dir))
    return found.select("record_id", "total_members", "head_record_id")


@query(
    "customer_groups",
    """
    SELECT CAST(o_custkey AS VARCHAR) AS norm_house, count(*) AS total_members,
      arg_max(o_orderkey, (CAST(o_totalprice AS INTEGER), -o_orderkey)) AS head_record_id
    FROM orders WHERE o_custkey <> 0 GROUP BY o_custkey
    """,
)
def customer_groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("record_id"), c("o_orderkey").alias("ingest_seq"),
        c("o_custkey").cast("string").alias("norm_house"), F.lit("w").alias("ward"), F.lit("p").alias("part"),
        F.round("o_totalprice", 0).cast("int").alias("age"), c("o_orderkey").alias("source_serial_number"),
    )
    return dedupe.household_stats(orders).select("norm_house", "total_members", "head_record_id")


@query(
    "duplicate_entities",
    r_sql(
        """, s AS (SELECT DISTINCT record_id, 'id|' || id_code AS k FROM r WHERE id_code IS NOT NULL
          UNION SELECT record_id, 'file|' || source_file_id || '|' || source_serial_number FROM r WHERE source_serial_number <> 0
          UNION SELECT record_id, 'alike|' || replace(norm_name_lat, ' ', '') || '|' || replace(norm_rel_lat, ' ', '') || '|'
              || norm_house || '|' || coalesce(CAST(age // 2 * 2 AS VARCHAR), 'noage')
            FROM r WHERE length(replace(norm_name_lat, ' ', '')) >= 3 AND length(replace(norm_rel_lat, ' ', '')) >= 3),
        e AS (SELECT DISTINCT a.record_id AS x, b.record_id AS y FROM s a JOIN s b ON a.k = b.k),
        t AS MATERIALIZED (WITH RECURSIVE g AS (SELECT record_id AS x, record_id AS y FROM r UNION SELECT g.x, e.y FROM g JOIN e ON g.y = e.x)
          SELECT x, min(y) AS entity FROM g GROUP BY x)
        SELECT x AS record_id, entity, count(*) OVER (PARTITION BY entity) AS n_members FROM t"""
    ),
)
def duplicate_entities(spark, sf_dir):
    return entities.entities(register(spark, sf_dir))
