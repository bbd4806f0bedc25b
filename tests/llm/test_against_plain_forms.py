"""Operators without SQL against plain forms: the library's ids through files and windows, and the patterns as they are written."""

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recordlake.llm import personal_data as S
from recordlake.llm.queries import QUERIES, tokenizer


def _crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def _library_ids(name, texts, end):
    encoder = Tokenizer.from_file(tokenizer(name))
    return {d: [*encoder.encode(t, add_special_tokens=False).ids, end] for d, t in texts.items()}


def test_ids_read_back_from_files_are_those_of_the_library(spark, sf_dir, texts):
    expected, at = [], 0
    ids = _library_ids("byte_bpe_50k.json", texts, 2)
    for d in sorted(ids):
        expected.append((d, at, len(ids[d]), _crc(ids[d])))
        at += len(ids[d])
    got = QUERIES["op3_grammar_files"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected


def test_pieces_hold_the_ids_of_the_library_once(spark, sf_dir, texts):
    ids = _library_ids("word_bpe_49k.json", texts, 1)
    reached = dict.fromkeys(ids, 0)
    filled = {}
    rows = QUERIES["op1_pack_sum_of_squares"](spark, sf_dir).collect()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == reached[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        reached[r.doc_id] += r.length
        assert r.length > 0 and r.ids_crc32 == _crc(ids[r.doc_id][r.start : r.start + r.length])
    assert reached == {d: len(x) for d, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048


PLAIN = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and _plain_luhn(re.sub("[^0-9]", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def _plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _plain_spans(text):
    found = [(*m.span(), k) for k, (p, right) in enumerate(PLAIN) for m in re.finditer(p, text) if right(m[0])]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans_equal_the_patterns(texts):
    r = random.Random(11)
    seen = set()
    for alphabet in ("ab1.@-", "0123.", "0159 -", "+12 ().-", "a@.+-1 \n%_é٣", "25.6@"):
        for _ in range(4000):
            text = "".join(r.choices(alphabet, k=r.randrange(40)))
            assert S.base_spans(text) == _plain_spans(text), text
            seen |= {k for *_, k in _plain_spans(text)}
    assert seen == {0, 1, 2, 3}
    for text in texts.values():
        assert S.base_spans(text) == _plain_spans(text)
