"""Periodic runs, spelling variants and secret formats against brute force and on awkward tables."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlake.llm import periodic_runs as P
from recordlake.llm import queries
from recordlake.llm import secret_automata as A
from recordlake.llm import spelling_variants as V
from recordlake.llm import word_arrays as W

SCHEMA = "doc_id long, text string, runs string, word string, n int, key string, spans string"


@pytest.fixture(scope="module")
def make(spark):
    def docs(rows):
        return spark.createDataFrame([(i, t, "x", "x", 1, "x", "x") for i, t in rows], SCHEMA)

    return docs


# ------------------------------------------------------------------ words
@pytest.mark.parametrize(("inside", "pattern"), [(W.not_white, r"[^\x20\x09-\x0D]+"), (W.latin_letters, "[A-Za-zÀ-ÿ]+")])
def test_words_are_those_of_the_pattern(inside, pattern):
    rng = random.Random(1)
    alphabet = "ab Z\t\n\x0b\x0c\r1.éÀÿĀ×中😀 \u0085"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(400)] + [None, "", "a", " "]
    whole = pa.array(["zz", *texts])
    words, bounds = W.split(whole.slice(1), inside)
    want = [re.findall(pattern, t or "") for t in texts]
    assert words.to_pylist() == [w for x in want for w in x]
    assert np.diff(bounds).tolist() == [len(x) for x in want]
    assert [x for a, b in W.slices(whole, 20) for x in whole.slice(a, b - a).to_pylist()] == whole.to_pylist()
    assert W.split(pa.array([], pa.string()), inside)[1].tolist() == [0]


# ------------------------------------------------------------------- runs
def brute_runs(w, least=6, times=4):
    found = set()
    for d in range(1, len(w) // times + 1):
        i = d
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - d]:
                j += 1
            if j - i + d >= max(least, times * d):
                found.add((i - d, j - i + d, d))
            i = max(j, i + 1)
    return sorted((r for r in found if not any(x[:2] == r[:2] and x[2] < r[2] for x in found)), key=lambda r: (r[0], r[2]))


def loopy(rng):
    words, k = [], rng.choice([1, 2, 2, 3, 6])
    while len(words) < rng.randint(0, 80):
        words += [rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 3, 4, 5, 9])
    return [f"w{x}" for x in words]


def test_runs_equal_brute_force(make):
    rng = random.Random(2)
    texts = [loopy(rng) for _ in range(300)]
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(w)) for i, w in enumerate(texts)]
    for r in P.find(make(rows)).collect():
        words = texts[r.doc_id]
        want = brute_runs(words)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words)
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r.collapsed_text == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_longer_and_fewer_repetitions(make):
    rng = random.Random(3)
    texts = [loopy(rng) for _ in range(100)]
    for r in P.find(make([(i, " ".join(w)) for i, w in enumerate(texts)]), least=2, times=3, with_text=False).collect():
        assert [tuple(x) for x in r.runs] == brute_runs(texts[r.doc_id], 2, 3)
    with pytest.raises(ValueError):
        P.runs_of(np.zeros(4, np.int32), np.array([0, 4]), times=2)


def test_awkward_texts_of_runs(make):
    long = "a " * 200_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (None, "x " * 6), (5, long), (5, long), (6, "x " * 5)]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in P.find(make(rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "one"), (None, 6, [(0, 6, 1)], "x"),
            (5, 200_000, [(0, 200_000, 1)], "a"), (5, 200_000, [(0, 200_000, 1)], "a"), (6, 5, [], "x x x x x"),
        ],
        key=str,
    )
    assert P.find(make([]).limit(0)).collect() == []


def test_top_run_ties(spark):
    df = spark.sql("SELECT array(named_struct('start', 9L, 'length', 8L, 'period', 2L), named_struct('start', 20L, 'length', 4L, 'period', 1L), "
                   "named_struct('start', 30L, 'length', 7L, 'period', 2L)) AS runs UNION ALL SELECT array()")
    assert [r.t and tuple(r.t) for r in df.select(P.top_run(F.col("runs")).alias("t")).collect()] == [(9, 8, 2), None]


def test_loops_follow_the_contract(make):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 40)))) for i in range(150)] + [(10_000, None)]
    for r in P.with_loops(make(rows), every=10).collect():
        words, h = (dict(rows)[r.doc_id] or "").split(), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert (r.text or "").split() == words and r.runs == "x"


# ------------------------------------------------------- spelling variants
def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out = {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        out[w] = [n[w], len(near), best if best and n[best] >= 2 * n[w] else None]
    for w, x in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        x += [n[x[2]] if x[2] else None, root]
    return {w: tuple(x) for w, x in out.items()}


def words_of(seed, n):
    rng = random.Random(seed)
    return {"".join(rng.choices("abé", k=rng.randint(5, 7))): rng.randint(1, 40) for _ in range(n)}


@pytest.mark.parametrize("block", [6000, 40, 7])
def test_variants_equal_brute_force(spark, block):
    n = words_of(5, 500) | {"z" * 80 + c: 5 for c in "abc"} | {f"{'chain'}{'x' * i}": 3 * 2**i for i in range(12)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = V.with_roots(V.near_words(df, block=block)).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute_variants(n)


def test_vocabulary(make):
    rng = random.Random(6)
    rows = [(rng.randint(0, 10_000), " ".join(rng.choices(["Planet", "plänet", "TREES", "Éclair", "cat", "x1planet_planet"], k=30))) for _ in range(60)]
    rows += [rows[0], (None, "planet " * 4), (7, None), (8, ""), (9, "zzzzz " * 3 + "b" * 100_000)]
    count = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                count[run] = count.get(run, 0) + 1
    got = {r.word: r.n for r in V.vocabulary(make(rows), damage=3).collect()}
    assert got == {w: n for w, n in count.items() if n >= 3} and "zzzzz" in got or "zzzz" in got
    assert V.group_variants(make([(1, None)])).collect() == [] == V.group_variants(make([]).limit(0)).collect()


def test_blocks_share_the_work_of_words_that_begin_alike():
    words = sorted({"prefix" + "".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(20_000)})
    parts = V.best_parts(random.Random(1).sample(words, 5000))
    for reverse in (False, True):
        keys = sorted(w[::-1] for w in words) if reverse else words
        for blocks in (30, 480):
            cuts = V.cuts_of(keys, blocks)
            places = [list(V.homes(k, cuts, V.part_of(len(k), parts, reverse))) for k in keys]
            assert max(np.bincount([p[0] for p in places])) < 3 * len(words) / blocks
            assert sum(map(len, places)) < 6 * len(words)


# ---------------------------------------------------------------- secrets
ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute_secrets(t):
    out = [(*m.span(), 0) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_brute_force():
    rng = random.Random(7)
    bits = ["password", "PassWd", "Token", "api_key", "ApiKey", "ſecret", "secret", ":", "=", " ", "  ", "'", '"', "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "é", "/", "_", "\n"]
    for _ in range(5000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert A.base_spans(text) == brute_secrets(text), text
        for s, e in A.candidates(text, A.base_spans(text)):
            assert e - s >= 16 and not any(s < y and x < e for x, y, _ in A.base_spans(text))


def formats(rng):
    pick = lambda of, k: "".join(rng.choices(of, k=k))
    return {
        "key": lambda: "ghp_" + pick(string.ascii_letters + string.digits, 36),
        "hex": lambda: pick("0123456789abcdef", 24),
        "uuid": lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
    }


def ordinary(rng):
    syllables = ["ver", "ein", "tion", "com", "pre", "lich", "keit", "ment"]
    return rng.choice([
        lambda: "".join(rng.choices(syllables, k=rng.randint(5, 7))),
        lambda: f"example.org/{rng.choice(syllables)}/{rng.choice(syllables)}/{rng.randint(1, 9999)}",
        lambda: "/".join(rng.choices(syllables, k=5)),
        lambda: f"2024-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}.{rng.randint(0, 59):02}.00",
    ])()


def test_formats_of_left_out_credentials_are_found(make):
    rng = random.Random(8)
    kinds, rows = formats(rng), []
    for i in range(600):
        words = [ordinary(rng) for _ in range(12)]
        rows.append((i, " ".join(words) + f' token = "{rng.choice(list(kinds.values()))()}"'))
    model = A.fit(make(rows))
    planted = {}
    for i in range(300):
        value = list(kinds.values())[i % 3]()
        before = " ".join(ordinary(rng) for _ in range(3)) + " "
        planted[i] = (f"{before}{value} {ordinary(rng)}", len(before), len(before) + len(value))
    found = {r.doc_id: r for r in A.find(make([(i, t) for i, (t, _, _) in planted.items()]), model).collect()}
    hits = sum(any((s.kind, s.start, s.end) == ("format", *planted[i][1:]) for s in r.spans) for i, r in found.items())
    wrong = sum(s.start != planted[i][1] for i, r in found.items() for s in r.spans)
    assert hits >= 0.9 * len(planted) and wrong <= 0.01 * len(planted), (hits, wrong)
    assert all(not r.base for r in found.values())


def test_states_are_merged_only_where_compatible():
    loop = A.infer({("a",) * k: 2**10 >> k for k in range(1, 10)}.items())
    assert len(loop.reached) <= 3  # lengths fall off evenly: one state goes round
    chain = A.infer([(("a",) * 10, 500), (("b",) * 4, 500)])
    assert len(chain.reached) == 14 or len(chain.reached) == 15
    assert chain.log_likelihood(["a"] * 10) > chain.log_likelihood(["a"] * 9) + 3
    assert chain.log_likelihood(["b"] * 4) > chain.log_likelihood(["b"] * 5) + 3


def test_awkward_texts_of_secrets(make):
    model = A.fit(make([(1, None), (2, "")]))
    assert model.score("x" * 20) == -np.inf
    long = "a" * 300_000 + " token=" + "b" * 100_000
    rows = [(1, None), (2, ""), (None, "token=abcdefgh"), (3, long), (3, long)]
    got = [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in A.find(make(rows), model).collect()]
    span = [("assign", 300_001, 400_007)]
    hexes = [("hex", 0, 300_000), span[0], ("hex", 300_007, 400_007)]
    want = [(1, [], []), (2, [], []), (None, [("assign", 0, 14)], [("assign", 0, 14)]), (3, hexes, hexes), (3, hexes, hexes)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert A.find(make([]).limit(0), A.fit(make([]).limit(0))).collect() == []


def test_query_of_secrets_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op11_secret_automata(spark, sf_dir).collect():
        want = brute_secrets(texts[r.doc_id] or "")
        told = ",".join(f"{A.BASE[k]}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for *_, k in want) for i in range(3))
        assert {x for x in told.split(",") if x} <= set(r.spans.split(","))


# --------------------------------------------------------------- pipeline
def test_stages_on_awkward_tables(spark, sf_dir):
    line = "a line of words that is found in several of these documents"
    rows = [(1, None), (2, ""), (3, f"{line}\nand its own"), (4, f"{line}\nanother"), (5, f"{line}\nlast"), (6, "word " * 30_000), (6, "word " * 30_000), (7, "x")]
    schema = "doc_id long, text string, kept string, node long, n_hit int, log_weight double, h1 long"
    docs = spark.createDataFrame([(i, t, "k", 1, 2, 3.0, 4) for i, t in rows], schema)
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, sf_dir)
            n = out.count()
            if name != "packing":
                assert out.columns == docs.columns and n <= len(rows), name
            assert n > 0 or given is not docs, name
