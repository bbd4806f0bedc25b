"""Repair of scanned (OCR) field values, each with a confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import WS, _any_of, _to_blanks, let, normalize_ocr_text, trim_ws


def _field(raw: Column, value: Column, confidence: Callable[[Column], Column]) -> Column:
    """struct(raw_value, value, confidence, repairs) of a value computed once; blank input scores 0."""
    blank = F.coalesce(raw, F.lit("")) == ""
    none = F.array().cast("array<string>")
    return let(
        value,
        lambda v: F.struct(
            F.when(blank, "").otherwise(trim_ws(raw)).alias("raw_value"),
            F.when(blank, "").otherwise(v).alias("value"),
            F.when(blank, 0.0).otherwise(confidence(v)).alias("confidence"),
            none.alias("repairs"),
        ),
    )


def repair_id_code(c: Column) -> Column:
    """Undo letter/digit confusion in a 3-letter + 7-digit code; other codes are only cleaned."""
    cleaned = F.regexp_replace(
        F.upper(trim_ws(F.coalesce(c, F.lit("")))), f"({WS}|[-_.:{fixed.ZERO_WIDTH}])+", ""
    )

    def repaired(base: Column) -> Column:
        head, tail = F.left(base, F.lit(3)), F.substring(base, 4, 7)
        ten = F.length(base) == 10
        new_head = F.when(ten, F.translate(head, "0158", "OISB")).otherwise(head)
        new_tail = F.when(ten, F.translate(tail, "OISBZ", "01582")).otherwise(tail)
        letters_fixed = F.when(ten, F.concat(new_head, new_tail)).otherwise(base)
        notes = [
            F.when(ten & (new_head != head), F.concat(F.lit("prefix "), head, F.lit(" -> "), new_head)),
            F.when(ten & (new_tail != tail), F.concat(F.lit("suffix "), tail, F.lit(" -> "), new_tail)),
        ]
        notes += [
            F.when(letters_fixed.contains(dev), f"digit {dev} -> {asc}")
            for dev, asc in zip(fixed.DEVANAGARI_DIGITS, fixed.ASCII_DIGITS)
        ]
        return F.struct(
            F.translate(letters_fixed, fixed.DEVANAGARI_DIGITS, fixed.ASCII_DIGITS).alias("value"),
            F.array_compact(F.array(*notes)).alias("repairs"),
        )

    def scored(r: Column) -> Column:
        confidence = (
            F.when(r["value"] == "", 0.0)
            .when(~r["value"].rlike("^[A-Z0-9/]{6,16}$"), 0.70)
            .when(F.size(r["repairs"]) > 0, 0.92)
            .otherwise(0.99)
        )
        raw = trim_ws(F.coalesce(c, F.lit("")))
        return F.struct(
            raw.alias("raw_value"), r["value"].alias("value"),
            F.when((r["value"] == "") & (raw != ""), 0.70).otherwise(confidence).alias("confidence"),
            r["repairs"].alias("repairs"),
        )

    return let(let(cleaned, repaired), scored)


def clean_name(c: Column) -> Column:
    """Name without its label and with letters only."""
    label = f"(?i)^{_any_of(fixed.OCR_NAME_PREFIXES)}{WS}*[:：.]?{WS}*"
    value = F.regexp_replace(normalize_ocr_text(c), label, "")
    value = _to_blanks(value, ("\u0900-\u097F", "a-z", "A-Z"))

    def confidence(v: Column) -> Column:
        return F.when(F.length(v) < 2, 0.40).when(F.length(v) > 50, 0.70).otherwise(0.95)

    return _field(c, value, confidence)


def clean_house(c: Column) -> Column:
    """House number without its label and without stray characters."""
    label = f"(?i)^{_any_of(fixed.OCR_HOUSE_PREFIXES)}{WS}*[:：.]?{WS}*"
    value = F.regexp_replace(normalize_ocr_text(c), label, "")
    value = F.regexp_replace(value, r"[^\u0900-\u097Fa-zA-Z0-9\s/_.-]", "")
    value = F.trim(F.regexp_replace(value, r"\s+", " "))
    return _field(c, value, lambda v: F.when(F.length(v) > 0, 0.95).otherwise(0.0))


def parse_age(c: Column) -> Column:
    """First two or three digits as an age; confidence says how plausible it is."""
    raw = trim_ws(c.cast("string"))
    digits = F.regexp_extract(
        F.translate(raw, fixed.DEVANAGARI_DIGITS, fixed.ASCII_DIGITS), "[0-9]{2,3}", 0
    )
    age = digits.try_cast("int")
    blank = F.coalesce(raw, F.lit("")) == ""
    confidence = (
        F.when(blank, 0.0).when(age.isNull(), 0.30).when(age.between(18, 130), 0.98).otherwise(0.60)
    )
    return F.struct(
        F.coalesce(raw, F.lit("")).alias("raw_value"),
        age.alias("age"),
        confidence.alias("confidence"),
    )
