"""Labelled text: every label of a text with the value behind it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws

_OPEN, _CLOSE = "\x01", "\x02"
_BEFORE, _BEHIND = r"(?<![\p{L}\p{M}])", r"(?![\p{L}\p{M}])"
_SEPARATOR = r"\s*\.?\s*[:：-]?\s*"
_COLON = r"\s*[:：]"


def _folded(label: str) -> str:
    return re.sub(r"\s+", "", label).lower()


def fold(label: Column) -> Column:
    """A label without blanks, in lower case."""
    return F.lower(F.regexp_replace(label, r"\s+", ""))


def any_label(labels: Iterable[str]) -> str:
    """Pattern of any of the labels as whole words, the longest that fits."""
    longest_first = sorted(set(labels), key=lambda x: (-len(_folded(x)), x))
    spaced = [r"\s*".join(re.escape(word) for word in x.split()) for x in longest_first]
    return f"(?i){_BEFORE}({'|'.join(spaced)}){_BEHIND}"


def entries(text: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Array of (field, value) for the labels of a text, in order.

    A value ends at the line end or where the next label starts. The text is
    scanned once, whatever the number of fields.
    """
    fields = {_folded(x): field for field, labels in vocabulary.items() for x in labels}
    names = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    plain = F.translate(text, _OPEN + _CLOSE, "")
    pattern = any_label(x for labels in vocabulary.values() for x in labels) + _SEPARATOR
    pieces = F.split(F.regexp_replace(plain, pattern, f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def entry(piece: Column) -> Column:
        label = F.substring_index(piece, _CLOSE, 1)
        value = F.substring_index(F.substring_index(piece, _CLOSE, -1), "\n", 1)
        return F.struct(names[fold(label)].alias("field"), trim_ws(value).alias("value"))

    return F.transform(F.filter(pieces, lambda x: x.contains(_CLOSE)), entry)


def first_entry(found: Column, *fields: str, when=None) -> Column:
    """The first entry of one of the fields, NULL when there is none."""

    def wanted(x: Column) -> Column:
        right = x["field"].isin(*fields)
        return right if when is None else right & when(x["value"])

    return F.get(F.filter(found, wanted), 0)


def labels_with_colon(line: Column, labels: Iterable[str]) -> Column:
    """Folded labels of a line that have a colon behind them."""
    found = F.regexp_extract_all(line, F.lit(any_label(labels) + _COLON), F.lit(1))
    return F.transform(found, fold)


def overlaps(found: Column, labels: Sequence[str]) -> Column:
    """Whether one of the labels is among the folded ones."""
    return F.arrays_overlap(found, F.array(*[F.lit(_folded(x)) for x in labels]))


def starts_with_label(line: Column, labels: Sequence[str]) -> Column:
    """Whether a trimmed line starts with one of the labels and a colon."""
    return line.rlike("^" + any_label(labels) + _COLON)
