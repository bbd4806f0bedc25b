"""Operators on small hand-made tables: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from recordlake.llm import block_labeller as B
from recordlake.llm import decontaminate as D
from recordlake.llm import grammar_files as G
from recordlake.llm import host_rules as H
from recordlake.llm import line_dedup as L
from recordlake.llm import near_duplicates as N
from recordlake.llm import packing as P
from recordlake.llm import personal_data as S
from recordlake.llm import resampling as R
from recordlake.llm import tokens, url_rules as U
from recordlake.llm.common import work_folder
from recordlake.llm.queries import URL_RULES, tokenizer

LONG = "long " * 30_000
LINE = "a line that is found in many documents"
TEXTS = [None, "", "one", "Two words", LONG, f"{LINE}\nown text here", f"{LINE.upper()} \nmore of my own", f" {LINE}\nlast", "ABC\n" * 30]
SCHEMA = "doc_id long, text string, source string, kept string, n_hit int, log_weight double, h1 long, node long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 1 else "s", "x", 1, 2.0, 3, 4) for i, t in enumerate([*TEXTS, TEXTS[3]])]
    rows += [rows[3], (None, "no id", "s", "x", 1, 2.0, 3, 4), (None, None, "s", "x", 1, 2.0, 3, 4)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    e = tokens.Encoder(tokens.definition(tokenizer(name)))
    library = Tokenizer.from_file(tokenizer(name))
    r = random.Random(3)
    alphabet = list("abzAZ09 .,!?'\n\n  \t-_äÄßéñÉΣςİ中😀\u00a0\u0301") + ["the ", " of", "<|endoftext|>", "'s", "  ", "don't"]
    for text in ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(1500)] + ["x" * 3000, " a", "a ", "\n"]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.ids(text), "<u4").tolist() == want, text


@pytest.mark.parametrize("keep", [3, 1_000_000])
def test_texts_encoded_together(keep):
    e = tokens.Encoder(tokens.definition(tokenizer("byte_bpe_50k.json")), keep)
    library, r = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), random.Random(5)
    words = ["the", "Öl", "word's", "it'", "x" * 70, "naïve--", "3rd", "中", "ª", "café!!", "\nnew", "\n", "", " ", "\tt", "<|endoftext|>", "\nœuvre,"]
    texts = [None, "", " ", "\n", "a", " a", "a ", "\na", "a\n"] + [" ".join(r.choices(words, k=r.randint(1, 9))) for _ in range(800)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.many(texts)] == want
    assert e.many([]) == [] and e.many([None]) == [b""]


def test_a_word_of_many_texts_is_encoded_once():
    e, called = tokens.Encoder(tokens.definition(tokenizer("byte_bpe_50k.json"))), []
    model, e.library = e.model, None
    e.model = type("Model", (), {"tokenize": staticmethod(lambda word: called.append(word) or model.tokenize(word))})()
    e.many(["\nthe word, the word.", "\nword! the (word", "\nthe"][:1] * 3 + ["\nword the word"])
    assert sorted(called) == sorted(["the", "word", "Ġthe", "Ġword", ",", "."])


def test_a_word_is_encoded_once_whatever_marks_stand_behind_it():
    e, called = tokens.Encoder(tokens.definition(tokenizer("byte_bpe_50k.json"))), []
    library, model = e.library, e.model
    e.model = type("Model", (), {"tokenize": staticmethod(lambda word: called.append(word) or model.tokenize(word))})()
    texts = ["a word, été.\nword!", "a word! word; (word) été", "a été; word,,\nword... word"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(e.many([t])[0], "<u4").tolist() for t in texts] == want
    assert [called.count(w) for w in ("Ġword", "word", "ĠÃ©tÃ©")] == [1, 1, 1]


def test_packing_with_few_kept_words(docs):
    name = tokenizer("word_bpe_49k.json")
    packed = [sorted(map(repr, P.pack(docs, name, 1, keep_pieces=k).drop("sequence_id", "offset").collect())) for k in (2, 1_000_000)]
    assert packed[0] == packed[1]


def test_memory_is_given_back_between_operators():
    from recordlake.llm.common import sole

    first, second = {"a": 1}, {"b": 2}
    assert sole(first) is first and sole(second) is second and not first and second == {"b": 2}


def test_packing(docs, empty):
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = P.pack(docs, tokenizer("word_bpe_49k.json"), 1, with_ids=True).collect()
    windows, n_docs = defaultdict(list), 0
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        n_docs += r.start == 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert n_docs == docs.count()
    own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 4)
    assert np.frombuffer(b"".join(i for _, i in own), "<u4").tolist() == [*library.encode(LONG, add_special_tokens=False).ids, 1]
    assert P.pack(empty, tokenizer("word_bpe_49k.json"), 1).count() == 0


@pytest.mark.parametrize("most_open", [4, 4096])
def test_packing_keeps_every_id_in_bounded_memory(most_open):
    r = random.Random(1)
    documents = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(r.choices([1, 7, 33, 40, 64, 200], k=500))]
    found, levels = defaultdict(list), P.Levels(64, most_open)
    for pieces in P.pack_ids(documents, 64, most_open):
        for doc, n, start, ids in pieces:
            found[doc].append((start, ids))
            assert n == len(documents[doc][1]) // 4
    assert {d: b"".join(i for _, i in sorted(v)) for d, v in found.items()} == dict(documents)
    levels.count[[30, 34]] = 3, 1
    assert levels.best(34) == 30  # fills windows of which there are most
    assert levels.best(63) == 0


def test_grammar_round_trip(spark, docs, empty):
    r = np.random.default_rng(2)
    for n, top in ((0, 9), (1, 9), (500, 1), (5000, 3), (20_000, 400)):
        ids = r.integers(0, top, n).astype(np.uint32)
        data = G.write_segment(ids, 4, 6)
        assert G.read_segment(data)[0].tolist() == ids.tolist() and G.read_segment(data)[1] == len(data)
        for _ in range(5):
            a, b = sorted(r.integers(0, n + 1, 2))
            assert G.read_segment(data, 0, a, b)[0].tolist() == ids[a:b].tolist()
    x, rules = G.replace_pairs(np.array([1, 2] * 100, dtype=np.uint32), 5, 4, 6)
    assert len(x) < 20 and len(rules) > 1
    path = G.write(docs, work_folder(spark, "test"), tokenizer("byte_bpe_50k.json"), 2, block_ids=1000)
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in G.read_documents(spark, path).collect())
    at = 0
    for start, _, n in found:
        assert start == at
        at += n
    known = [d for _, d, _ in found]
    assert known[:2] == [None, None] and known[2:] == sorted(known[2:]) and len(found) == docs.count()
    shard = spark.read.parquet(path).orderBy("shard").first()
    whole = np.concatenate([G.read_segment(shard.payload)[0]])
    assert G.read_span(spark, path, shard.shard, 0, 5) == whole[:5].tolist()
    path = G.write(empty, work_folder(spark, "test"), tokenizer("byte_bpe_50k.json"), 2)
    assert G.read_documents(spark, path).count() == 0


def test_grammar_rounds_count_only_pairs_that_can_be_frequent(monkeypatch):
    r, counted, grouped = np.random.default_rng(4), [], G._grouped
    monkeypatch.setattr(G, "_grouped", lambda x, at, n: counted.append((len(x), len(at))) or grouped(x, at, n))
    ids = np.concatenate([np.tile([1, 2, 3, 4], 50), r.permutation(np.arange(10, 5000))]).astype(np.uint32)
    x, rules = G.replace_pairs(ids, 5000)
    assert len(counted) > 1 and counted[0] == (len(ids), len(ids) - 1) and all(at < 210 for _, at in counted[1:])
    assert G.expand(x, rules, 5000).tolist() == ids.tolist()


@pytest.mark.parametrize("top", [3, 300, 1 << 30])
def test_grammar_segments_of_small_and_large_ids(top):
    ids = np.random.default_rng(6).integers(0, 40, 30_000) ** 2 % 37 * max(top // 40, 1)
    x, rules = G.replace_pairs(ids.astype(np.uint32), int(ids.max()) + 1)
    data = G.write_segment(ids.astype(np.uint32))
    assert len(x) < 0.7 * len(ids) and G.expand(x, rules, int(ids.max()) + 1).tolist() == G.read_segment(data)[0].tolist() == ids.tolist()
    assert G.read_segment(data, 0, 11, 12_345)[0].tolist() == ids[11:12_345].tolist()


def test_whole_segments_expand_each_rule_once(monkeypatch):
    given, expand = [], G.expand
    monkeypatch.setattr(G, "expand", lambda x, rules, first: given.append(len(x)) or expand(x, rules, first))
    ids = np.tile(np.arange(40, dtype=np.uint32), 1000)
    data = G.write_segment(ids, 8, 2)
    assert G.read_segment(data)[0].tolist() == ids.tolist() and sum(given) < 100


def test_urls(spark):
    urls = [None, "", "no scheme/fr/", "http://Sub.Example.ORG/es/x?q=/en/1", "http://example.org/en/1x#a", "https://x.com/de/", "https://com/fr/a",
            "http://ads-a.example.net/fr/", "http://badexample.org/es/", "http://x.org", "http://x.org?a/", "a://b://c.com/fr/", "http://adsx.net/a"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(3, urls[3], "z")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, URL_RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("sub.example.org", "/es/x", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7][2:] == ("label:ads", "block") and got[8][2:] == ("org/", "allow")
    assert got[9] == ("x.org", "", None, "allow") and got[10][1:3] == ("", None) and got[11][0] == "b:" and got[12][3] == "allow"
    assert U.judge_urls(pages, URL_RULES).count() == len(urls) + 1 and U.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_urls_rules_of_any_alphabet_and_without_tokens(spark):
    rules = [
        U.host_rule("münchen.de", "/", "block"), U.host_rule("ÄRGER.org", "/Über Uns/", "block"), U.label_rule("spiel-ß"),
        U.Rule("digits", "block", r"^[0-9.]+/", (), 5), U.Rule("odd", "block", r"/[^/]{3000}$", (), 6),
        U.host_rule("net", "", "allow"),
    ]
    urls = ["http://a.münchen.de/x", "http://xmünchen.de/", "http://ÄRGER.org/Über Uns/a", "http://ärger.org/über uns/a", "http://spiel-ß-2.fr/",
            "http://10.2.3.4/a", "http://q.org/" + "z" * 3000, "http://q.org/" + "z" * 2999, "http://q.net/a", "http://net.work/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in U.judge_urls(pages, rules).collect()}
    assert [got[i] for i in range(10)] == [
        "münchen.de/", None, "ÄRGER.org/Über Uns/", None, "label:spiel-ß", "digits", "odd", None, "net", None,
    ]
    assert all(r.rule is None for r in U.judge_urls(pages, []).collect())


def brute_measures(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    hit = set()
    for i in range(len(words) - 4):
        if sum(words[i : i + 5] == words[j : j + 5] for j in range(len(words) - 4)) > 1:
            hit |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(hit)


def test_host_rules(spark, docs, empty):
    r = random.Random(4)
    for text in [" ".join(r.choices("abc", k=r.randint(0, 30))) + "\n \x1f\x0b #x|" for _ in range(200)] + TEXTS[:4]:
        m = H.measures(text)
        assert (m[0], m[1], m[4]) == brute_measures(text)
    assert H.measures("a b\n\n\na b\n c")[3] == 1
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(i, good if i % 10 == 0 else "bad", "low") for i in range(40)] + [(i, good, "high") for i in range(40, 80)] + [(99, good, None)]
    rows += [(100, "bad", "once")]
    out = {x.doc_id: x for x in H.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[i].kept for i in range(40)) and all(out[i].kept for i in range(40, 80)) and out[99].kept
    assert 0 < out[100].host_rate < 1
    got = H.apply_rules(docs)
    assert got.count() == docs.count() and H.apply_rules(empty).count() == 0


def test_blocks_and_labels(spark):
    page = ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p><b>one<br>two<p>three  x"
            "<!-- c --><script>if (a < b) { '</p>' }</script></article><div class='comments'><p>I think so too.</p></div><footer>f")  # fmt: skip
    blocks = B.blocks_of(page)
    assert [b.text for b in blocks] == ["Home", "A & B", "one two", "three x", "I think so too.", "f"]
    assert blocks[2].path[-2:] == ("article", "p") and blocks[0].linked == 4
    assert B.blocks_of(None) == B.blocks_of("") == [] and B.blocks_of("a < b <") [0].text == "a < b <"
    pages = spark.createDataFrame(
        [(i, f"u{i}", page.replace("three", f"three{i}"), 1) for i in range(8)] + [(8, None, None, 1), (9, "u", "", 1), (10, "u", "<p>" * 3000, 1)],
        "page_id long, url string, html string, text int",
    )
    labeller = B.fit(pages, epochs=30)
    got = {r.page_id: r for r in B.extract(pages, labeller).collect()}
    assert got[3].text == "A & B\none two\nthree3 x" and got[3].n_chars == len(got[3].text)
    assert got[8].text == got[9].text == got[10].text == "" and B.extract(pages.limit(0), labeller).count() == 0


def test_names_far_out_stay_on_the_path():
    thread = "<ul><li><div>" * 10 + "<p>Tenth reply.</p>" + "</div></li></ul>" * 10
    page = f"<body><article class=post><p>Story.</p><div class=comments>{thread}</div><p>End.</p></article></body>"
    blocks = B.blocks_of(page)
    assert [b.text for b in blocks] == ["Story.", "Tenth reply.", "End."]
    assert {"article", "post", "comments"} <= set(blocks[1].path) and [B.seed_label(b.path) for b in blocks] == [1, 0, 1]
    table = "<table><tr><td class=sidebar>" + "<table><tbody><tr><td>" * 6 + "<p>Links" + "</table>" * 7
    assert B.seed_label(B.blocks_of(f"<main>{table}</main>")[0].path) == 0
    deep = B.blocks_of("<div class=comments>" * 5000 + "<p>x")[0]
    assert len(deep.path) < 60


def test_raw_elements_end_where_they_end():
    def texts(page):
        return [b.text for b in B.blocks_of(page)]

    for one in ("<svg-icon a=1></svg-icon>", "<title-bar></title-bar>", "<template-x>", "<svg a='1' />", "<svg/>", "<script-x/>", "<!-->", "<svg>", "<iframe src=x>", "<noscript>"):
        assert texts(f"<p>one</p>{one}<p>two</p>") == ["one", "two"], one
    for one in ("svg", "noscript", "template", "iframe", "script", "STYLE", "textarea", "title"):
        assert texts(f"<p>one</p><{one} a='>'>x<p>y</{one}-z></{one} ><p>two") == ["one", "two"], one
    for one in ("<script>", "<style a=b>", "<textarea>", "<title>", "<!-- "):
        assert texts(f"<p>one</p>{one}<p>two</p>") == ["one"], one
    assert texts("<svg>" * 20_000 + "<p>two") == ["two"]


def test_labeller_gradients():
    model = B.Labeller(dim=3, hidden=4, seed=1)
    pages = [B.inputs([B.Block(("p", "x"), "some words here", 2), B.Block(("li",), "a"), B.Block(("p",), "b c.")]), B.inputs([B.Block(("nav",), "z")])]
    labels, step = [[1, 0, 1], [0]], 1e-5
    _, grad = model.gradients(pages, labels)
    for name, w in model.w.items():
        for at in list(zip(*np.nonzero(grad[name]), strict=True))[:6]:
            old = w[at]
            w[at] = old + step
            up = model.gradients(pages, labels)[0]
            w[at] = old - step
            down = model.gradients(pages, labels)[0]
            w[at] = old
            assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-6


def brute_lines(rows):
    docs_of = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key := L.line_key(line).decode()) >= 20:
                docs_of[key].add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        keep = []
        for line in (text or "").split("\n"):
            holders = docs_of[L.line_key(line).decode()]
            if len(holders) < 3 or max(holders) == (-1 if doc is None else doc):
                keep.append(line)
        out.append("\n".join(keep))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_line_dedup(spark, docs, empty, parts):
    r = random.Random(parts)
    lines = [f"line number {i} with enough characters" for i in range(6)] + ["short", "", " \t", LINE]
    rows = [(i, "\n".join(r.choices(lines, k=r.randint(0, 8)))) for i in range(300)] + [(300 + i, LINE) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {x.doc_id: x.text for x in L.drop_lines(df, L.keep_bitmaps(df)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {d: t for (d, _), t in zip(rows, brute_lines(rows), strict=True)}
    some = [(x.doc_id, x.text) for x in docs.collect()]
    kept = sorted(((d, t) for (d, _), t in zip(some, brute_lines(some), strict=True)), key=str)
    out = L.drop_lines(docs, L.keep_bitmaps(docs))
    assert out.columns == docs.columns
    assert sorted(((x.doc_id, x.text or "") for x in out.collect()), key=str) == kept
    assert L.line_report(docs, L.keep_bitmaps(docs)).count() == docs.count() and L.keep_bitmaps(empty).count() == 0


def test_personal_data(spark, docs, empty):
    text = "Mail a.b@c.de, x@y or p@q.r.s_t@u.vw; 1.2.3.4 and 1.2.3.256, 4111 1111 1111 1111, 4111 1111 1111 1112, +49 (30) 123-4567"
    spans = [(text[s:e], S.BASE[k]) for s, e, k in S.base_spans(text)]
    assert spans == [("a.b@c.de", "email"), ("p@q.r.s", "email"), ("_t@u.vw", "email"), ("1.2.3.4", "ip"), ("4111 1111 1111 1111", "card"), ("+49 (30) 123-4567", "phone")]
    assert S.luhn("79927398713") and not S.luhn("79927398710")
    secret = "The password = 3f9c0a7be1d24488 is old. "
    rows = [(i, secret.replace("3f", f"{i:02d}")) for i in range(60)] + [(i, "token: the following words") for i in range(60, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = S.fit(df)
    assert model.reliability["secret", 0][1, 2] > model.reliability["secret", 0][0, 2]
    got = {x.doc_id: x for x in S.find(df, model, with_text=True).collect()}
    assert got[5].spans == "secret:15:31" and got[5].masked == "The password = <secret> is old. " and got[70].spans == ""
    assert S.find(docs, S.fit(docs)).count() == docs.count() and S.find(empty, S.fit(empty)).count() == 0


def test_personal_data_covers_long_secrets(spark):
    r = random.Random(4)
    long = ["".join(r.choices("abcdefABCDEF0123456789", k=1000)) for _ in range(40)]
    texts = [f"the token={x} is old" for x in long[:20]] + [f"use sk-{x} now" for x in long[20:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in S.find(df, S.fit(df), with_text=True).collect()}
    assert all((got[i].spans, got[i].masked) == ("secret:10:1010", "the token=<secret> is old") for i in range(20))
    assert all((got[i].spans, got[i].masked) == ("secret:4:1007", "use <secret> now") for i in range(20, 40))
    name = "A" + "b" * 40
    assert list(S.candidates(f"Mr. {name} {name} {name}")) == [(4, 4 + 41 * 3 + 2, "person")]
    assert S.masked("x a@b.de/key y", [(2, 8, "email"), (2, 12, "secret")]) == "x <email> y"


def test_personal_data_labelers_propose_spans(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    cases = {
        "signed Anna Weber, today": "Anna Weber", "name: John Smith": "John Smith", "the author Carlos Ruiz wrote": "Carlos Ruiz",
        "it was Laura O'Neill's idea": "Laura O'Neill", '{"author": "Sophie de Clercq"}': "Sophie de Clercq",
        "From Emma Stone. We": "Emma Stone", "by Xaver Quade on": "Xaver Quade", "Dr. Anna Maria Weber said": "Anna Maria Weber",
        '{"password": "h4x0r-9 Zq,1", "n": 1}': "h4x0r-9 Zq,1", "{'api_key': 'k9Qz71mmB2'}": "k9Qz71mmB2", f"Bearer {jwt} sent": jwt,
        'a \\"token\\": \\"q1w2e3r4t5\\" b': "q1w2e3r4t5", "passport no: C01X00T47": "C01X00T47",
    }
    for text, want in cases.items():
        assert [text[s:e] for s, e, _ in S.candidates(text)] == [want], text
    for text in ("stood by The house", "The March. It Was On Monday", "by the house", "Then We left"):
        assert list(S.candidates(text)) == []
    plain = "came from Paris and left"
    rows = [(i, t) for i, t in enumerate([*cases] * 10)] + [(1000 + i, plain) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.masked for x in S.find(df, S.fit(df), with_text=True).collect()}
    for i, (text, want) in enumerate(cases.items()):
        assert want not in got[i] and "<" in got[i], text
    assert got[1000] == plain


def test_automaton_against_brute_force():
    r = random.Random(5)
    for _ in range(600):
        letters, n = [bytes([97 + i]) for i in range(r.choice([2, 3, 6]))], r.choice([2, 3, 4])
        items = [(i, r.choices(letters, k=r.randint(0, 9))) for i in range(r.randint(1, 6))]
        doc, hit, found = r.choices([*letters, b"z"], k=r.randint(0, 25)), set(), set()
        for name, words in items:
            k = min(n, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                for j in range(len(doc) - k + 1):
                    if doc[j : j + k] == words[i : i + k]:
                        hit |= set(range(j, j + k))
                        found.add(name)
        spans, names = D.Automaton(items, n).scan(doc)
        assert {x for a, b in spans for x in range(a, b)} == hit and names == found


def test_decontamination(spark, docs, empty):
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item.upper()), (2, None), (3, "tiny item"), (None, "")], "item_id long, text string")
    rows = [(1, f"x {item} y"), (2, "a tiny, ITEM. " + "z " * 10), (3, item[:40]), (4, None), (5, "b " * 500 + item)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in D.report(df, bench).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (15, 1, True) and got[2].n_hit == 2
    assert got[3].n_hit == 0 and got[4].n_words == 0 and got[5].n_hit == 15 and not got[5].contaminated
    kept = D.decontaminate(df, bench, longest=13).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 5] and [r.text.strip() for r in kept if r.doc_id == 5] == [("b " * 500).strip()]
    assert D.decontaminate(docs, bench).count() == docs.count() and D.decontaminate(empty, bench).count() == 0
    assert D.report(df, bench.limit(0)).where("n_hit > 0").count() == 0


def brute_components(rows, n):
    sets, parent = {}, {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
        sets[doc], parent[doc] = grams, doc

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in names}


def test_near_duplicates_against_brute_force(spark, docs, empty):
    r = random.Random(6)
    base = [[f"w{r.randint(0, 400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(260):
        words = list(base[min(i % 20, 11)])
        for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
            words[r.randrange(60)] = f"v{r.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(900, ""), (901, None), (902, "word"), (903, "WORD "), (904, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(df, n=2).collect()}
    want = brute_components(rows, 2)
    assert got == want and len({c for _, c in want.values()}) > 20
    assert N.drop_near_duplicates(df, n=2).count() == len({c for _, c in want.values()})
    found = N.near_duplicates(docs, n=2)
    assert found.count() == docs.count() and found.where("doc_id IS NULL AND NOT kept").count() == 0
    assert {x.doc_id: x.component_id for x in found.collect()}[9] == 3 and N.near_duplicates(empty, n=2).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in N.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert N.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_resampling(spark, docs, empty, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    model = R.fit(texts, R.judgements(labels))
    out, how = R.resample(texts, model)
    rows = out.join(labels, "doc_id").select("quality", "toxic", how["selected"]).collect()
    kept = [r[2] for r in rows if r[0] == 1 and r[1] == 0]
    lost = [r[2] for r in rows if r[0] == 0]
    assert sum(kept) / len(kept) > 0.98 and sum(lost) / len(lost) < 0.1
    assert out.where(how["selected"]).count() == how["k"]
    narrow, same = R.resample(texts, model, carry=["doc_id"])
    assert narrow.columns == ["doc_id", "log_weight", "noisy_weight", "selected"] and same == how
    assert narrow.where("selected").exceptAll(out.where("selected").select(*narrow.columns)).count() == 0
    few, how = R.resample(texts, model, k=37, temperature=1.0)
    assert few.where(how["selected"]).count() == 37
    none = R.fit(docs, R.judgements(labels.limit(0)))
    every, how = R.resample(docs, none)
    assert how["weight"] == "log_weight_" and every.where(how["selected"]).count() == docs.count()
    assert R.resample(empty, R.fit(empty, R.judgements(labels)))[0].count() == 0


def test_resampling_rejects_toxic_documents(spark, sf_dir):
    texts, labels = (spark.read.parquet(f"{sf_dir}/../sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = R.fit(texts, R.judgements(labels.where("doc_id % 5 <> 0")))
    out, how = R.resample(texts.join(labels.where("doc_id % 5 = 0"), "doc_id"), model)
    rows = out.where("quality = 1").select("toxic", how["selected"]).collect()
    kept, caught = [r[1] for r in rows if r[0] == 0], [not r[1] for r in rows if r[0] == 1]
    print(len(kept), sum(kept), len(caught), sum(caught))
    assert len(caught) > 50 and sum(caught) / len(caught) > 0.8 and sum(kept) / len(kept) > 0.98


def test_kth_largest(spark):
    values = [float(random.Random(7).gauss(0, 1)) for _ in range(5000)] + [0.5] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 1500, 5300):
        assert R.kth_largest(df, "v", k, bins=16, few=50) == sorted(values, reverse=True)[k - 1]
