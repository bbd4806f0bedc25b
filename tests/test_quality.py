"""Ingest rules, verdicts, decisions, audit and redaction on small cases."""

import json

from pyspark.sql import functions as F

from recordlake.operators import audit, quality, records, stats

BASE = dict(
    batch_id="b", source_file_id="f", name_lat="anita", name_dev="अनीता", relation_type="FATHER", rel_name_lat="suresh",
    gender="FEMALE", age=30, house_number="4", part="1", ward="W", confidence=0.9, status="VALID",
)


def make(spark, rows):
    full = [{**BASE, "record_id": f"r{i}", "ingest_seq": i, "source_serial_number": i, "id_code": f"TST000000{i}", **r}
            for i, r in enumerate(rows, 1)]
    types = {k: v for k, v in records.RECORD_SCHEMA.items() if k in full[0]}
    data = [tuple(r[k] for k in types) for r in full]
    return records.as_records(spark.createDataFrame(data, ", ".join(f"{k} {t}" for k, t in types.items())))


def test_ingest_rules(spark):
    df = make(spark, [
        {}, {"id_code": "tst0000001"}, {"id_code": "AB1"}, {"age": 15}, {"age": 131}, {"id_code": None},
        {"name_lat": None, "name_dev": " "}, {"source_serial_number": 1}, {"confidence": 0.74}, {"confidence": 0.75},
    ])
    out = {r.record_id: r for r in quality.check_batch(df).collect()}
    codes = {k: [i.code for i in r.issues] for k, r in out.items()}
    assert codes == {
        "r1": [], "r2": ["DUPLICATE_EPIC_IN_BATCH"], "r3": ["MALFORMED_EPIC_FORMAT"], "r4": ["INVALID_AGE"],
        "r5": ["INVALID_AGE"], "r6": ["MISSING_EPIC_ID"], "r7": ["MISSING_MANDATORY_NAME"],
        "r8": ["DUPLICATE_SERIAL_IN_PART"], "r9": ["LOW_OCR_CONFIDENCE"], "r10": [],
    }
    assert [out[f"r{i}"].status for i in (1, 2, 3, 6, 8, 9)] == ["VALID", "DUPLICATE", "WARNING", "WARNING", "VALID", "WARNING"]
    assert out["r7"].dropped and not out["r1"].dropped
    totals = stats.batch_totals(quality.check_batch(df)).first()
    assert (totals.records_processed, totals.records_valid, totals.records_flagged) == (9, 3, 6)
    assert totals.final_status == "COMPLETED_WITH_WARNINGS"


def test_field_verdicts(spark):
    df = make(spark, [{}, {"id_code": None}, {"age": 16}, {"age": 125}, {"house_number": "-"}, {"name_lat": "", "name_dev": None, "gender": "X"}])
    got = {r.record_id: r for r in quality.field_verdict(df).collect()}
    assert [got[f"r{i}"].is_valid for i in range(1, 7)] == [True, False, False, False, True, False]
    issues = quality.explode_issues(df, quality.field_rules(), ["record_id"]).collect()
    assert {(r.record_id, r.severity) for r in issues if r.field == "age"} == {("r3", "ERROR"), ("r4", "WARNING")}
    assert [r.severity for r in issues if r.code == "NAME_MISSING"] == ["CRITICAL"]


def test_insert_against_master(spark):
    df = make(spark, [{}, {"id_code": "tst-0000001"}, {"id_code": None}, {"id_code": "NEW1"}, {"id_code": "NEW1"}])
    out = quality.flag_against_master(df.where("ingest_seq > 1"), df.where("ingest_seq = 1"))
    got = {r.record_id: (r.status, r.duplicate_of) for r in out.collect()}
    assert got == {"r2": ("DUPLICATE", "r1"), "r3": ("VALID", None), "r4": ("VALID", None), "r5": ("DUPLICATE", "r4")}


def test_queue_keeps_the_first_of_equal_issues(spark):
    df = make(spark, [{"id_code": None}])
    errors = spark.createDataFrame(
        [("r1", "f", "MISSING_EPIC_ID", "id code is missing", "INFO", False), ("r1", "f", "X", "other", None, True)],
        "record_id string, source_file_id string, error_code string, error_message string, severity string, is_resolved boolean",
    )
    queue = quality.validation_queue(df, errors, status="all")
    assert sorted((r.field, r.issue, r.severity) for r in queue.collect()) == [
        ("id_code", "id code is missing", "WARNING"), ("name", "other", "WARNING"),
    ]
    assert quality.queue_counts(queue).first().quality_score == 85.0
    assert quality.search_queue(queue, "CODE", ["record_id"]).count() == 1
    assert quality.validation_queue(df, errors, status="open").count() == 1


def test_decisions(spark):
    df = make(spark, [{"status": "WARNING"}] * 4)
    errors = spark.createDataFrame(
        [("e1", "r1"), ("e2", "r1"), ("e3", "r2"), ("e4", "r3")], "error_id string, record_id string"
    ).withColumn("is_resolved", F.lit(False))
    decisions = spark.createDataFrame(
        [("e1", "r1", "MARK_REVIEWED", None, None, 1), ("e3", "r2", "REJECT_RECORD", None, None, 1),
         ("e4", "r3", "EDIT", "age", "44", 1), ("e4", "r3", "EDIT", "id_code", " tst-9 ", 2)],
        "error_id string, record_id string, action string, field string, new_value string, decided_at int",
    ).withColumns({"notes": F.lit(None).cast("string"), "resolved_by": F.lit("a")})
    new_records, new_errors = quality.apply_decisions(df, errors, decisions)
    got = {r.record_id: (r.status, r.age, r.id_code) for r in new_records.collect()}
    assert got["r1"][0] == "WARNING"  # its other error is still open
    assert got["r2"][0] == "REJECTED" and got["r4"][0] == "WARNING"
    assert got["r3"] == ("VALID", 44, "TST9")
    assert new_errors.where("is_resolved").count() == 3


def test_redaction(spark):
    given = {"password": "p\"w", "n": 1, "in": {"api_key": {"a": [1, {"b": 2}]}, "safe": "token is fine here"}, "l": [{"X-Cookie": None}]}
    text = spark.createDataFrame([(json.dumps(given),)], "j string").select(audit.redact_json(F.col("j")).alias("o")).first().o
    mask = "[REDACTED_SECRET]"
    assert json.loads(text) == {"password": mask, "n": 1, "in": {"api_key": mask, "safe": "token is fine here"}, "l": [{"X-Cookie": mask}]}
    df = spark.sql("SELECT named_struct('user', 'u', 'session_token', 't') AS s, map('secret', 'a', 'k', 'b') AS m, array(named_struct('private', 1)) AS a")
    r = audit.redact_columns(df).first()
    assert (r.s.user, r.s.session_token, r.m, r.a[0].private) == ("u", mask, {"secret": mask, "k": "b"}, mask)


def test_redaction_at_any_depth():
    for depth in (1, 7, 8, 20, 200):
        deep = '{"a": {"to\\u006ben" : ' + "[" * depth + '"p8", {"k": "}"}' + "]" * depth + ', "b": 1}}'
        assert json.loads(audit.redact_text(deep)) == {"a": {"token": "[REDACTED_SECRET]", "b": 1}}
    assert audit.redact_text('{"token": "x') == '"[REDACTED_SECRET]"' and audit.redact_text(None) is None


def test_repeats_across_files_with_equal_positions(spark):
    rows = [(f"r{f}{i}", f, i, "B1", f"ID{i}") for f in ("f1", "f2") for i in (1, 2)]
    df = spark.createDataFrame(rows, "record_id string, source_file_id string, ingest_seq long, batch_id string, id_code string")
    out = quality.flag_repeats(df, ["batch_id", "id_code"], "again").where("again").collect()
    assert sorted(r.record_id for r in out) == ["rf21", "rf22"]


def test_redaction_of_long_text(spark):
    long = json.dumps({"note": "x" * 200_000 + '"', "token": ["y" * 100_000] * 3})
    out = spark.createDataFrame([(long,)], "j string").select(audit.redact_json(F.col("j")).alias("o")).first().o
    assert json.loads(out)["token"] == "[REDACTED_SECRET]" and len(json.loads(out)["note"]) == 200_001


def test_changes_and_audit(spark):
    df = make(spark, [{}, {}, {}])
    changes = spark.createDataFrame(
        [("r1", "UPDATE", 1, 1, "A"), ("r1", "UPDATE", 2, 2, "B"), ("r2", "DELETE", 1, 3, None), ("r9", "CREATE", 1, 4, "N"), ("r8", "UPDATE", 1, 5, "Z")],
        "record_id string, op string, changed_at int, change_id int, ward string",
    )
    new, log = audit.apply_changes(df, changes, ["ward"])
    assert sorted((r.record_id, r.ward) for r in new.collect()) == [("r1", "B"), ("r3", "W"), ("r9", "N")]
    assert sorted({r.action for r in log.collect()}) == ["VOTER_CREATED", "VOTER_DELETED", "VOTER_UPDATED"]


def test_export_is_masked_unless_told_otherwise(spark, tmp_path):
    df = make(spark, [{"house_number": '4"2'}])
    assert audit.export_projection(df).first()["EPIC Number"] == "TST****001"
    assert audit.export_projection(df, masked=False).first()["EPIC Number"] == "TST0000001"
    path = str(tmp_path / "out")
    audit.write_export(df.coalesce(1), path, masked=False)
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "out").glob("part-*"))
    assert '"4""2"' in text and text.count("\r\n") == 2
