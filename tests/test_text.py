"""Normalisers, scanned-field repair and transliteration on small cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from recordlake.functions import scanned, text, translit


def run(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", fn(F.col("v")).alias("o"))
    return [r.o for r in df.orderBy("i").collect()]


CASES = [
    (text.detect_script, [("राम", "devanagari"), ("Ram", "latin"), ("Ram राम", "mixed"), (" 42 ", "numeric"), ("--", "unknown"), (None, "unknown")]),
    (text.normalize_devanagari, [
        ("राम​कु‌मार", "रामकुमार"), ("उम्र १२३", "उम्र 123"), ("ऩ", "ऩ"),
        ("क़लम।क़", "कलम क"), ("aé|x", "a x"), (None, ""),
        ("क़़", "क़"), ("ज़ँ", "जं"),
    ]),
    (text.normalize_latin, [("Ｂ Éa ﬁn-½", "b ea fin-1 2"), ("ß ø x", "x"), ("A B", "a b"), (None, "")]),
    (text.normalize_ocr_text, [("राम​कु|मार।", "राम कु मार"), ("a,  b", "a, b")]),
    (text.normalize_id_code, [(" tt / 12 / 34567 ", "TT/12/34567"), ("tst-1234567", "TST1234567"), (None, "")]),
    (text.normalize_house, [("H.No. 42-B", "42-B"), ("मकान नं 101", "101"), ("House 1", "House 1"), ("h.no: 9 a", "9 a")]),
    (text.parse_int_prefix, [("12A", 12), (" -3", -3), ("x", None), ("99999999999", None)]),
    (text.code_gender, [("Male", "MALE"), ("महिला", "FEMALE"), ("2", "FEMALE"), ("Others", "OTHER"), (None, "UNKNOWN")]),
    (text.sanitize_text, [("\x00a<b>\tc ", "ab\tc"), (None, "")]),
    (text.sanitize_filename, [("a/b c..d.csv", "b_c.d.csv"), ("", "unnamed_file"), ("x" * 200, "x" * 150)]),
    (text.mask_id_code, [("ABC1234567", "ABC****567"), ("AB1", "****"), (None, None)]),
    (text.mask_house, [("42-B", "4*"), ("", "")]),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_normalizers(spark, fn, cases):
    assert run(spark, fn, [c[0] for c in cases]) == [c[1] for c in cases]


def test_normalizers_are_idempotent_and_match_unicode_rules(spark):
    rng = random.Random(7)
    letters = "ab Z9-/_.,éÅñçßœ½ﬁ　𝐀Ⅳ" + "कखनरळज़क़़ँं।१२"
    samples = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(400)]
    once = run(spark, text.normalize_latin, samples)
    assert run(spark, text.normalize_latin, once) == once
    for raw, got in zip(samples, once):
        folded = "".join(ch for ch in unicodedata.normalize("NFKD", raw) if not "̀" <= ch <= "ͯ").lower()
        kept = "".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789/_-" else " " for ch in folded)
        assert got == " ".join(kept.split())
    dev = run(spark, text.normalize_devanagari, samples)
    # A dot left over after a doubled one is dropped by the next pass, so only single ones repeat.
    clean = [d for d in dev if "़" not in d]
    assert run(spark, text.normalize_devanagari, clean) == clean


def test_scanned_fields(spark):
    codes = run(spark, scanned.repair_id_code, ["BR0123456O", "ABC1234567", "wb/12/34567", "x", None])
    assert [(r.value, r.confidence, len(r.repairs)) for r in codes] == [
        ("BRO1234560", 0.92, 2), ("ABC1234567", 0.99, 0), ("WB/12/34567", 0.99, 0), ("X", 0.70, 0), ("", 0.0, 0),
    ]
    ages = run(spark, scanned.parse_age, ["४२", "15", "x", None])
    assert [(r.age, r.confidence) for r in ages] == [(42, 0.98), (15, 0.60), (None, 0.30), (None, 0.0)]
    names = run(spark, scanned.clean_name, ["नाम: राम!", "N", "x" * 51])
    assert [(r.value, r.confidence) for r in names] == [("राम", 0.95), ("N", 0.40), ("x" * 51, 0.70)]
    houses = run(spark, scanned.clean_house, ["मकान संख्या: 12-अ#", "#"])
    assert [(r.value, r.confidence) for r in houses] == [("12-अ", 0.95), ("", 0.0)]


def test_transliteration(spark):
    assert run(spark, translit.to_devanagari, ["Ramesh", "sunita kumar", "ram kumara", "aditi", ""]) == [
        ["रमेश"], ["सुनीता कुमार"], ["राम कुमरा", "राम कुमर"], ["अदिति"], [],
    ]
    many = run(spark, translit.to_devanagari, ["lata sita gita rita"])[0]
    assert len(many) == translit.MAX_SPELLINGS and len(set(many)) == 5
    assert run(spark, translit.to_latin, ["रमेश", "कमल अब", "राजस्थान", ""]) == ["RAMESH", "Kamal Ab", "Rajasthan", ""]


def test_query_expansion(spark):
    ramesh, joined, dev, digits = run(
        spark, translit.expand_query, ["Ramesh", "ramdayal", "रामदयाल", "12"]
    )
    assert "रमेश" in ramesh and ramesh[0] == "Ramesh"
    assert {"ram dayal", "रामदयाल", "राम दयाल"} <= set(joined)
    assert {"RAMDAYAL", "ramdayal", "राम दयाल"} <= set(dev)
    assert digits == ["12"]
    assert run(spark, translit.query_script, ["12", "राम", "a राम"]) == ["latin", "devanagari", "mixed"]


def test_classes_name_what_is_not_kept(spark, sf_dir):
    """Java tests a negated class several times slower."""
    import re

    from recordlake.plans import load

    for kept in (text.LATIN_KEPT, text.DEVANAGARI_KEPT, ["\u0900-\u097F"], ["a-z", " "]):
        ranges = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", text.outside(kept))
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)])) + "\U0010FFFF"
        assert re.findall(ranges, every) == re.findall(f"[^{''.join(kept)}]", every)
    for name in ("norm_latin", "norm_devanagari", "token_search"):
        plan = load().QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "[^" not in plan and r"\x{10FFFF}" in plan
