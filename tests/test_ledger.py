"""Ingestion by content: repeated deliveries, ids stored before, micro-batches that were cut off."""

import pytest
from pyspark.sql import functions as F

from recordlake.streaming import ledger


@pytest.fixture
def run(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()

    def deliver(**files):
        for name, text in files.items():
            (folder / f"{name}.csv").write_text("name,age,epic_no\n" + text)
        ledger.ingest_once(spark, str(folder), table, str(tmp_path / "cp")).awaitTermination()
        return {
            (r.name_lat, r.status, r.micro_batch) for r in ledger.stored_records(spark, table).collect()
        }

    deliver.table, deliver.folder, deliver.checkpoint = table, folder, tmp_path / "cp"
    return deliver


def test_each_content_once(spark, run):
    first = run(a="Anita,30,ABC0000001\nSeema,40,ABC0000002\n", b="Pooja,16,ABC0000003\n")
    assert first == {("anita", "VALID", 0), ("seema", "VALID", 0), ("pooja", "WARNING", 0)}
    # the same content under another name, twice, beside a new file
    again = run(c="Anita,30,ABC0000001\nSeema,40,ABC0000002\n", d="Pooja,16,ABC0000003\n", e="Meena,50,ABC0000004\n")
    assert again == first | {("meena", "VALID", 1)}
    rows = {r.source_path.rsplit("/", 1)[1]: r for r in ledger.ledger(spark, run.table).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {
        "a.csv": "STORED", "b.csv": "STORED", "c.csv": "SAME_CONTENT", "d.csv": "SAME_CONTENT", "e.csv": "STORED",
    }
    assert rows["c.csv"].first_path.endswith("/a.csv") and rows["c.csv"].n_records == 0 and rows["a.csv"].n_records == 2
    assert run() == again


def test_copies_within_one_delivery(spark, run):
    assert run(b="Anita,30,ABC0000001\n", a="Anita,30,ABC0000001\n") == {("anita", "VALID", 0)}
    assert {r.outcome for r in ledger.ledger(spark, run.table).where("first_path like '%/a.csv'").collect()} == {"STORED", "SAME_CONTENT"}


def test_ids_stored_before(spark, run):
    run(a="Anita,30,ABC0000001\n,20,ABC0000009\n")
    run(b="Seema,40,abc0000001\nPooja,41,ABC0000005\nMeena,42,ABC0000005\nRani,43,ABC0000009\n")
    by = {r.name_lat: r for r in ledger.stored_records(spark, run.table).collect()}
    assert {k: r.status for k, r in by.items()} == {
        "anita": "VALID", "seema": "DUPLICATE", "pooja": "VALID", "meena": "DUPLICATE", "rani": "VALID",
    }
    assert by["seema"].duplicate_of == by["anita"].record_id and by["meena"].duplicate_of is None
    assert [i.code for i in by["seema"].issues] == ["DUPLICATE_EPIC"]
    assert [i.code for i in by["meena"].issues] == ["DUPLICATE_EPIC_IN_BATCH"]


def _rows(spark, table):
    return sorted(map(str, ledger.stored_records(spark, table).drop("micro_batch").collect()))


def test_a_cut_off_micro_batch_is_repeated(spark, run, monkeypatch):
    run(a="Anita,30,ABC0000001\n")
    (run.folder / "b.csv").write_text("name,age,epic_no\nSeema,40,ABC0000001\n")
    store = ledger.store_files

    def killed(arrived, number, table, *rest):
        store(arrived, number, table, *rest)
        (run.folder.parent / "table" / "files" / f"micro_batch={number}" / "_SUCCESS").rename(run.folder.parent / f"lost-{number}")
        raise RuntimeError("killed behind the records, before the ledger was finished")

    monkeypatch.setattr(ledger, "store_files", killed)
    with pytest.raises(Exception, match="killed"):
        ledger.ingest_once(spark, str(run.folder), run.table, str(run.checkpoint)).awaitTermination()
    assert [r.name_lat for r in ledger.stored_records(spark, run.table).collect()] == ["anita"]
    monkeypatch.setattr(ledger, "store_files", store)
    assert run() == {("anita", "VALID", 0), ("seema", "DUPLICATE", 1)}
    once = _rows(spark, run.table)
    # the same micro-batch once more changes nothing
    arrived = ledger.ledger(spark, run.table).where("micro_batch = 1").select("source_path", "file_hash_sha256", "file_size_bytes")
    ledger.store_files(spark.createDataFrame(arrived.collect(), arrived.schema), 1, run.table)
    assert _rows(spark, run.table) == once


def test_nothing_delivered(spark, tmp_path):
    assert ledger.ledger(spark, str(tmp_path / "none")).isEmpty()
    with pytest.raises(FileNotFoundError):
        ledger.stored_records(spark, str(tmp_path / "none"))


def test_contents_are_compared_with_the_ledger(spark):
    arrived = spark.createDataFrame([("x", "h1", 1), ("y", "h1", 1), ("z", "h2", 1)], "source_path string, file_hash_sha256 string, file_size_bytes bigint")
    known = spark.createDataFrame([("h2", "q")], "file_hash_sha256 string, first_path string")
    got = {r.source_path: (r.outcome, r.first_path) for r in ledger.new_contents(arrived, known).collect()}
    assert got == {"x": ("STORED", "x"), "y": ("SAME_CONTENT", "x"), "z": ("SAME_CONTENT", "q")}
    assert ledger.new_contents(arrived, known.where(F.lit(False))).where("outcome = 'STORED'").count() == 2
