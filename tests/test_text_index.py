"""The stored index against scans and brute force: tf-idf, BM25, phrases, batches, hot terms, pruning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recordlake.operators import similarity, text_index

WORDS = ["ram", "sita", "house", "road", "ward", "the"]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for i in range(n)] + [(n, None), (n + 1, "!! ...")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("index")), corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for batch in range(3):
        text_index.add_batch(docs.where(F.col("doc_id") % 3 == batch), path, str(batch), buckets=4, splits=3)
    return path, rows, docs


def scores(df):
    return {r.doc_id: (r.n_terms, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize("terms", [["ram"], ["Sita", "the", "the"], WORDS, ["absent"], ["ram", "absent"]])
def test_index_equals_the_scan(spark, built, terms):
    path, _, docs = built
    index = text_index.Index(spark, path, buckets=4)
    assert scores(index.tf_idf(terms)) == scores(similarity.token_search(docs, "doc_id", "text", terms))


def test_bm25_equals_brute_force(spark, built):
    path, rows, _ = built
    texts = {i: [w for w in (t or "").split() if w.isalpha()] for i, t in rows}
    mean, want = sum(map(len, texts.values())) / len(texts), {}
    for term in ("ram", "road"):
        df = sum(term in w for w in texts.values())
        for i, w in texts.items():
            if tf := w.count(term):
                idf = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
                n, s = want.get(i, (0, 0))
                want[i] = n + 1, s + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = scores(text_index.Index(spark, path, buckets=4).bm25(["ram", "road"]))
    assert got == {i: (n, round(s, 9)) for i, (n, s) in want.items()}


@pytest.mark.parametrize("phrase", [["ram"], ["ram", "sita"], ["the", "the"], ["ram", "the", "ram"], ["the", "absent"]])
def test_phrases_equal_brute_force(spark, built, phrase):
    path, rows, _ = built
    want = {}
    for i, t in rows:
        w = (t or "").split()
        at = [k for k in range(len(w) - len(phrase) + 1) if w[k : k + len(phrase)] == phrase]
        if at:
            want[i] = len(at), at[0]
    got = text_index.Index(spark, path, buckets=4).phrase(phrase).collect()
    assert {r.doc_id: (r.n_matches, r.first_place) for r in got} == want


def test_batches_are_added_and_replaced(spark, tmp_path):
    path = str(tmp_path / "index")

    def add(batch, *texts):
        rows = [(10 * int(batch) + i, t) for i, t in enumerate(texts)]
        text_index.add_batch(spark.createDataFrame(rows, "doc_id bigint, text string"), path, batch, buckets=2, splits=1)

    def found(**options):
        return sorted(r.doc_id for r in text_index.Index(spark, path, buckets=2, **options).bm25(["ram"]).collect())

    add("1", "ram", "sita")
    before = sorted(p for p in (tmp_path / "index" / "postings" / "batch=1").rglob("*.parquet"))
    add("2", "ram ram", "ram")
    assert found() == [10, 20, 21] and found(batches=["2"]) == [20, 21]
    assert before == sorted(p for p in (tmp_path / "index" / "postings" / "batch=1").rglob("*.parquet"))
    add("2", "sita")
    assert found() == [10]


def test_only_the_buckets_of_the_terms_are_read_and_hot_terms_are_split(spark, built):
    path, _, _ = built
    index = text_index.Index(spark, path, buckets=4)
    plan = index.postings(["the"])._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].splitlines()[0]
    assert "bucket" in filters and "EqualTo(term,the)" in plan
    files = index.postings(["the"]).select(F.col("_metadata.file_path")).distinct().count()
    assert files == 9  # three batches, three splits each


def test_texts_are_read_once_and_every_split_is_a_task(spark, tmp_path):
    path, rows = str(tmp_path / "index"), corpus(seed=3, n=400)
    read = spark.sparkContext.accumulator(0)
    parts = spark.createDataFrame(rows, "doc_id bigint, text string").rdd.map(lambda r: (read.add(1), tuple(r))[1])
    docs = spark.createDataFrame(parts, "doc_id bigint, text string")
    text_index.add_batch(docs, path, "0", buckets=3, splits=2)
    assert read.value == len(rows)
    split = F.pmod(F.xxhash64("doc_id"), F.lit(2)) + 2 * F.col("bucket")
    stored = spark.read.parquet(f"{path}/postings").select(F.col("_metadata.file_name").alias("f"), split.alias("s")).distinct().collect()
    assert len({r.f for r in stored}) == len({r.s for r in stored}) == len(stored)


def test_places_of_terms_in_a_row(spark):
    texts = ["b a b", "", None, "a", "the the the a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", text_index.term_places(similarity.tokens(F.col("t"))).alias("f")).orderBy("i").collect()
    assert [{x.term: x.places for x in r.f or []} for r in got] == [
        {"a": [1], "b": [0, 2]}, {}, {}, {"a": [0]}, {"a": [3], "the": [0, 1, 2]},
    ]


def test_token_search_reads_texts_once(spark):
    rows = corpus(seed=5, n=80)
    read = spark.sparkContext.accumulator(0)
    parts = spark.createDataFrame(rows, "doc_id bigint, text string").rdd.map(lambda r: (read.add(1), tuple(r))[1])
    found = similarity.token_search(spark.createDataFrame(parts, "doc_id bigint, text string"), "doc_id", "text", ["ram", "the"])
    want = sum(bool({"ram", "the"} & set((t or "").split())) for _, t in rows)
    assert len(found.collect()) == want and read.value == len(rows)
