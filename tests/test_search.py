"""Search tiers, filters, batch search against brute force, similarity."""

import random

from pyspark.sql import functions as F

from recordlake.operators import search as S
from recordlake.operators import search_batch, similarity
from recordlake.operators.search import SearchFilters, search
from test_quality import make


def people(spark):
    df = make(spark, [
        {"name_lat": "Ram Dayal", "name_dev": "राम दयाल", "rel_name_lat": "Mohan Lal", "age": 45},
        {"name_lat": "Ramdayal", "name_dev": "रामदयाल", "age": None, "gender": "MALE", "ward": "W2"},
        {"name_lat": "Ramdayal Singh", "name_dev": "रामदयाल सिंह", "relation_type": "HUSBAND", "rel_name_lat": "Ram Dayal"},
        {"name_lat": "Sita Devi", "name_dev": "सीता देवी", "house_number": "12", "age": 60},
        {"name_lat": "Ramdeyl", "name_dev": "रमदल", "age": 20, "house_number": "1"},
    ])
    return df.withColumns({"norm_name_lat": F.lower("name_lat"), "norm_name_dev": F.col("name_dev"),
                           "norm_rel_lat": F.lower("rel_name_lat"), "norm_house": F.col("house_number")})


def scores(spark, **kw):
    return {r.record_id: (r.score, r.matched_fields) for r in search(people(spark), SearchFilters(**kw)).matches.collect()}


def test_text_tiers(spark):
    got = scores(spark, query="Ram Dayal")
    assert got["r1"][0] == 95 and "Matched Name (Exact)" in got["r1"][1]
    assert got["r2"][0] == 95 and "Matched Spaced Variant" in got["r2"][1]  # the joined form is a candidate too
    assert got["r3"][0] == 75 and "Matched Husband Name" in got["r3"][1]
    assert got["r5"] == (65, ["Matched Fuzzy Name (Typo Tolerant)"]) and "r4" not in got
    assert "r5" not in scores(spark, query="Ram Dayal", mode="exact")
    assert scores(spark, query="रामदयाल")["r2"][0] == 95
    assert scores(spark, query="TST0000004") == {"r4": (100, ["Matched EPIC"])}
    assert scores(spark, query="12") == {"r4": (40, ["Matched House Number"])}
    assert scores(spark, query="nobody at all") == {}


def test_filters(spark):
    assert set(scores(spark, name="dayal")) == {"r1", "r2", "r3"}
    assert set(scores(spark, relation_name="mohan")) == {"r1"}
    assert scores(spark, min_age=40, max_age=50) == {"r1": (50, []), "r2": (50, [])}
    assert set(scores(spark, house="1")) == {"r4", "r5"}
    assert scores(spark, id_code="0000003") == {"r3": (60, ["epic_partial"])}
    assert scores(spark, ward="W2", query="ramdayal")["r2"][0] == 95
    assert set(scores(spark, query="sita", id_code="TST")) == {"r1", "r2", "r3", "r4", "r5"}


def test_order_pages_and_facets(spark):
    found = search(people(spark), SearchFilters(sort_by="age", descending=False, limit=2))
    assert [r.record_id for r in found.page.collect()] == ["r2", "r5"]
    second = search(people(spark), SearchFilters(sort_by="age", descending=False, limit=2, page=2)).page.collect()
    assert [r.record_id for r in second] == ["r3", "r1"]
    facets = {(r.facet, r.value): r.n for r in found.facets.collect()}
    assert facets[("total", "all")] == 5 and facets[("ward", "W2")] == 1 and facets[("gender", "FEMALE")] == 4
    assert S.page_bounds(0, 0) == (0, 20) and S.page_bounds(3, 1000) == (200, 100)


def brute_force(names, queries):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    out = {}
    for qid, cand in queries:
        for n in names:
            nj, cj = n.replace(" ", ""), cand.replace(" ", "")
            score = 95 if n == cand else 85 if nj == cj else 75 if nj.startswith(cj) else 70 if cand in n else 0
            if not score and len(n) > 3 and edits(n, cand) <= 2:
                score = 65
            if score:
                out[qid, n] = max(score, out.get((qid, n), 0))
    return out


def test_blocked_matching_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abcd") for _ in range(k))
    names = sorted({" ".join(word(rng.randint(1, 6)) for _ in range(rng.randint(1, 2))) for _ in range(250)})
    queries = [(f"q{i}", " ".join(word(rng.randint(1, 5)) for _ in range(rng.randint(1, 2)))) for i in range(60)]
    field = F.lit("norm_name_lat").alias("field")
    values = spark.createDataFrame([(n,) for n in names], "value string").select(field, "value")
    cands = spark.createDataFrame(queries, "query_id string, cand string").select("query_id", field, "cand")
    got = {(r.query_id, r.value): r.hit.score for r in search_batch.match_values(values, cands).collect()}
    assert got == brute_force(names, queries)


def test_batch_search_equals_single_searches(spark):
    queries = ["Ram Dayal", "रामदयाल", "sita", "TST000000", "12", "mohan lal"]
    table = spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")
    many = search_batch.search_many(people(spark), table).cache()
    for q in queries:
        one = {k: v[0] for k, v in scores(spark, query=q).items()}
        assert {r.record_id: r.score for r in many.where(F.col("query_id") == q).collect()} == one, q
    top = search_batch.top_per_query(many, limit=1).collect()
    assert {r["query_id"]: r["rank"] for r in top} == {r.query_id: 1 for r in many.select("query_id").distinct().collect()}
    many.unpersist()


def test_trigrams(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    r = df.select(similarity.trigrams(F.col("a")).alias("t"), similarity.similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert sorted(r.t) == sorted(["  w", " wo", "wor", "ord", "rd "]) and abs(r.s - 4 / 11) < 1e-12
    found = similarity.trigram_search(people(spark), SearchFilters(name="sita", relation_name="mohan"))
    assert [r.record_id for r in found.collect()] == []
    found = similarity.trigram_search(people(spark), SearchFilters(name="ram dayal", relation_name="mohan")).collect()
    assert [(r.record_id, r.score) for r in found] == [("r1", 60 + 30 + 40 + 15)]


def test_trigram_join_equals_brute_force(spark):
    rng = random.Random(5)
    make_word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 7)))
    left = spark.createDataFrame([(make_word(),) for _ in range(60)], "query string")
    right = spark.createDataFrame([(make_word(),) for _ in range(80)], "value string")
    got = {(r.query, r.value) for r in similarity.trigram_join(left, right, 0.3).collect()}

    def grams(w):
        p = f"  {w} "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    want = {
        (a.query, b.value) for a in left.collect() for b in right.collect()
        if len(grams(a.query) & grams(b.value)) / len(grams(a.query) | grams(b.value)) > 0.3
    }
    assert got == want and want
