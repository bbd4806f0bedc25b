"""Text normalisation as Column expressions (script detection, Latin, Devanagari, codes)."""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

WS = fixed.WS
# Characters that normalised text keeps: ranges and single ones.
LATIN_KEPT = ("a-z", "0-9", "/", "_", "-")
DEVANAGARI_KEPT = ("\u0900-\u097F", "0-9", "a-z", "A-Z", "/", "_", "-")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def lookup_table(entries: Mapping[str, str]) -> Column:
    """A constant map, folded to a literal when the plan is optimised."""
    pairs = "\x1e".join(f"{k}\x1f{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x1e"), F.lit("\x1f"))


def blank_to_null(c: Column) -> Column:
    """NULL when the text is missing or only white space."""
    return F.when(F.length(trim_ws(c)) > 0, c)


def trim_ws(c: Column) -> Column:
    """Trim every Unicode space, not only the ASCII blank."""
    return F.trim(c, F.lit(fixed.WS_CHARS))


def unspaced(c: Column) -> Column:
    """Remove all white space."""
    return F.regexp_replace(c, f"{WS}+", "")


def joined(c: Column) -> Column:
    """Remove the blanks of a normalised text, which has no other white space."""
    return F.replace(c, F.lit(" "), F.lit(""))


def outside(kept: Iterable[str]) -> str:
    """Character class of all but the kept ranges (``a-z``) and characters.

    It names ranges: Java tests a negated class several times slower.
    """
    parts, start = [], 0
    for first, last in sorted((ord(k[0]), ord(k[-1])) for k in kept):
        if start < first:
            parts.append(rf"\x{{{start:X}}}-\x{{{first - 1:X}}}")
        start = last + 1
    return "[" + "".join(parts) + rf"\x{{{start:X}}}-\x{{{sys.maxunicode:X}}}]"


def _not_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def _in_words(text: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change``, which maps characters, in those words between blanks that pass the test: most do not."""
    words = F.transform(F.split(text, " "), lambda w: F.when(test(w), change(w)).otherwise(w))
    return F.array_join(words, " ")


def _to_blanks(c: Column, kept: Sequence[str]) -> Column:
    """Every run of characters outside the kept ones to one blank, then trim.

    Runs that already are a single blank, the most frequent kind by far, are
    not matched at all.
    """
    return F.trim(F.regexp_replace(c, f"(?: ?{outside([*kept, ' '])}|  ){outside(kept)}*", " "))


def squash(c: Column) -> Column:
    """Lower case without blanks, underscores, hyphens or dots (header comparison)."""
    return F.regexp_replace(F.lower(c), f"({WS}|[_\\-.])+", "")


def squash_text(s: str) -> str:
    """The same as :func:`squash` for a Python string such as a column name."""
    return "".join(ch for ch in s.lower() if not (ch.isspace() or ch in "_-.\uFEFF"))


# ---------------------------------------------------------------- scripts
def detect_script(c: Column) -> Column:
    """One of devanagari, latin, mixed, numeric, unknown."""

    def of(text: Column) -> Column:
        dev, lat = text.rlike(r"[\u0900-\u097F]"), text.rlike("[a-zA-Z]")
        return (
            F.when(dev & lat, "mixed")
            .when(dev, "devanagari")
            .when(lat, "latin")
            .when(text.rlike(f"^{WS}*[0-9]+{WS}*$"), "numeric")
            .otherwise("unknown")
        )

    return let(c, of)


# ------------------------------------------------------------------ Latin
@lru_cache(maxsize=1)
def _latin_fold() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to a kept ASCII character, by rule over all of Unicode.

    Returns translate() source and target for the one-to-one cases, and a map
    for characters that unfold into several (ligatures, fractions).
    """
    source, target, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        plain = unicodedata.normalize("NFKD", ch)
        if plain == ch:
            continue
        plain = "".join(p for p in plain if not "\u0300" <= p <= "\u036F").lower()
        kept = "".join(p if p.isascii() and (p.isalnum() or p in "/_-") else " " for p in plain)
        if not kept.strip():
            continue
        if len(kept) == 1:
            source.append(ch)
            target.append(kept)
        else:
            several[ch] = kept
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target), several


def _near_ranges(chars: Iterable[str], gap: int = 64) -> str:
    """Character class of a few ranges that cover the characters (and some between them)."""
    codes = sorted(ord(ch) for ch in chars)
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - ranges[-1][1] <= gap and code > 0x17F:
            ranges[-1][1] = code
        elif code != ranges[-1][1]:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def fold_latin(c: Column) -> Column:
    """Accents and compatibility forms to plain ASCII; pure ASCII text is passed through."""
    source, target, several = _latin_fold()
    table = lookup_table(several)
    rare = _near_ranges(several)

    def unfold(text: Column) -> Column:
        letters = F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch))
        return F.when(text.rlike(rare), F.array_join(letters, "")).otherwise(text)

    def fold(text: Column) -> Column:
        folded = _in_words(text, _not_ascii, lambda w: F.translate(unfold(w), source, target))
        return F.when(_not_ascii(text), folded).otherwise(text)

    return let(c, fold)


def normalize_latin(c: Column) -> Column:
    """Lower-case ASCII letters, digits, ``/ _ -`` and single blanks."""
    folded = F.lower(fold_latin(F.coalesce(c, F.lit(""))))
    return _to_blanks(folded, LATIN_KEPT)


# ------------------------------------------------------------- Devanagari
@lru_cache(maxsize=1)
def _composing_pairs() -> str:
    """Pattern of ASCII letter + combining mark pairs that have a one-character form."""
    by_mark = defaultdict(list)
    letters = [chr(x) for x in range(128) if chr(x).isalpha()]
    for code in range(0x300, 0x370):
        for letter in letters:
            if len(unicodedata.normalize("NFC", letter + chr(code))) == 1:
                by_mark[chr(code)].append(letter)
    return "|".join(f"[{''.join(ls)}]{mark}" for mark, ls in by_mark.items())


def _harmonise(c: Column, zero_width_as: str) -> Column:
    """Shared part of both Devanagari normalisers, up to the character whitelist."""

    def respelled(text: Column, letters: Mapping[str, str], found: str) -> Column:
        out = text
        for one, other in letters.items():
            out = F.replace(out, F.lit(one), F.lit(other))
        return F.when(text.rlike(found), out).otherwise(text)

    c = let(c, lambda text: respelled(text, fixed.DOTTED_LETTERS, r"[\u0958-\u095F]"))
    c = let(c, lambda text: respelled(text, fixed.COMPOSED_LETTERS, "\u093C"))
    if zero_width_as:
        hidden = fixed.ZERO_WIDTH + "\u00A0"
        c = F.translate(c, hidden, zero_width_as * len(hidden))
    else:
        c = F.translate(c, fixed.ZERO_WIDTH, "")
    bases = "".join(s[0] for s in fixed.DOTTED_LETTERS.values())
    c = F.regexp_replace(c, f"([{bases}])\u093C", "$1")
    return F.translate(
        c,
        "\u0901" + "\u0964\u0965|" + fixed.DEVANAGARI_DIGITS,
        "\u0902" + "   " + fixed.ASCII_DIGITS,
    )


def normalize_devanagari(c: Column) -> Column:
    """Canonical Devanagari text: one spelling per sign, ASCII digits, noise to blanks."""

    def clean(text: Column) -> Column:
        composed = F.when(
            text.rlike(r"[\u0300-\u036F]"), F.regexp_replace(text, _composing_pairs(), " ")
        ).otherwise(text)
        return F.when(_not_ascii(text), _harmonise(composed, "")).otherwise(text)

    plain = let(F.coalesce(c, F.lit("")), clean)
    return _to_blanks(plain, DEVANAGARI_KEPT)


def normalize_ocr_text(c: Column) -> Column:
    """As :func:`normalize_devanagari` for scanned text: keeps punctuation, hidden marks to blanks."""
    bars = F.translate(F.coalesce(c, F.lit("")), "|", " ")
    clean = let(bars, lambda t: F.when(_not_ascii(t), _harmonise(t, " ")).otherwise(t))
    one_blank = F.regexp_replace(clean, f"(?: ?{fixed.WS_NOT_BLANK}|  ){WS}*", " ")
    return F.trim(one_blank)


@F.pandas_udf(StringType())
def compose_unicode(s: pd.Series) -> pd.Series:
    """Full canonical composition (NFC), for input with reordered marks.

    Spark has no built-in for it. Apply it before the normalisers only where
    the source is known to carry a virama or stress mark in front of a nukta.
    """
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


# ------------------------------------------------------------ small codes
def normalize_id_code(c: Column) -> Column:
    """Upper case without blanks, hyphens, underscores, dots or backslashes; ``/`` stays."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), f"({WS}|[-_.\\\\])+", "")


def _any_of(patterns: Sequence[str]) -> str:
    return "(?:" + "|".join(patterns).replace(r"\s", WS) + ")"


def normalize_house(c: Column) -> Column:
    """House number without its label; case and inner text are kept."""
    text = trim_ws(F.coalesce(c, F.lit("")))
    label = f"(?i)^{_any_of(fixed.HOUSE_PREFIXES)}{WS}*:?"
    return trim_ws(F.regexp_replace(text, label, ""))


def parse_int_prefix(c: Column, fallback: Column | None = None) -> Column:
    """Leading integer of a text ("12A" -> 12); with a fallback, 0 and nothing become it."""
    number = F.regexp_extract(trim_ws(c), "^[+-]?[0-9]+", 0).try_cast("int")
    if fallback is None:
        return number
    return F.coalesce(F.nullif(number, F.lit(0)), fallback)


def code_by_rules(
    text: Column, rules: Sequence[tuple[str, list[str], list[str], list[str]]], default: Column
) -> Column:
    """First rule that matches wins: (code, prefixes, substrings, whole values)."""
    out = None
    for code, prefixes, parts, wholes in rules:
        tests = [text.startswith(p) for p in prefixes]
        tests += [text.contains(p) for p in parts]
        tests += [text == w for w in wholes]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(default)


def code_gender(c: Column) -> Column:
    """MALE, FEMALE, OTHER or UNKNOWN."""
    return code_by_rules(F.lower(F.coalesce(c, F.lit(""))), fixed.GENDER_CODES, F.lit("UNKNOWN"))


def code_relation(
    c: Column, father: Column | None = None, husband: Column | None = None, mother: Column | None = None
) -> Column:
    """Relation type from its own column, else from which relative's column is filled."""
    null = F.lit(None).cast("string")
    columns = [x if x is not None else null for x in (father, husband, mother)]
    by_column = F.when(blank_to_null(columns[0]).isNotNull(), "FATHER")
    by_column = by_column.when(blank_to_null(columns[1]).isNotNull(), "HUSBAND")
    by_column = by_column.when(blank_to_null(columns[2]).isNotNull(), "MOTHER").otherwise("UNKNOWN")
    coded = code_by_rules(F.lower(c), fixed.RELATION_CODES, F.lit("UNKNOWN"))
    return F.when(blank_to_null(c).isNotNull(), coded).otherwise(by_column)


# -------------------------------------------------------------- sanitizers
def sanitize_text(c: Column) -> Column:
    """Drop control characters (not tab and line ends) and angle brackets, then trim."""
    cleaned = F.regexp_replace(
        F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F<>]+", ""
    )
    return trim_ws(cleaned)


def sanitize_filename(c: Column) -> Column:
    """Base name, safe characters only, no dot runs, at most 150 characters."""
    base = F.regexp_extract(F.regexp_replace(c, "/+$", ""), "[^/]*$", 0)
    clean = F.regexp_replace(base, r"[^a-zA-Z0-9.\-_]", "_")
    clean = F.left(F.regexp_replace(clean, r"\.{2,}", "."), F.lit(150))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "unnamed_file")
        .when(clean == "", "document.pdf")
        .otherwise(clean)
    )


def stored_name(sha256_hex: Column, original: Column) -> Column:
    """Storage name of a registered raw file: 12 hash digits and the safe file name."""
    safe = F.regexp_replace(original, "[^a-zA-Z0-9._-]", "_")
    return F.concat_ws("_", F.left(sha256_hex, F.lit(12)), safe)


# ------------------------------------------------------------------ masking
def mask_id_code(c: Column) -> Column:
    """``ABC1234567`` -> ``ABC****567``; shorter codes keep nothing but the stars."""
    shown = F.concat(F.left(c, F.lit(3)), F.lit("****"), F.right(c, F.lit(3)))
    return F.when(F.length(c) > 6, shown).when(F.length(c) > 0, "****").otherwise(c)


def mask_house(c: Column) -> Column:
    """``42-B`` -> ``4*``."""
    return F.when(F.length(c) > 0, F.concat(F.left(c, F.lit(1)), F.lit("*"))).otherwise(c)
