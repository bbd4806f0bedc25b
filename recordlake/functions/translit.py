"""Latin <-> Devanagari transliteration and query expansion, as built-in expressions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import (
    detect_script,
    let,
    lookup_table,
    normalize_devanagari,
    normalize_latin,
    trim_ws,
    unspaced,
)

MAX_SPELLINGS = 5  # Fixed value: spellings kept per phrase.


def _longest_first(*tables: Mapping[str, str]) -> str:
    keys = {k for t in tables for k in t}
    return "|".join(sorted(keys, key=lambda k: (-len(k), k)))


# One token = the longest known consonant or vowel spelling, else one character.
_TOKEN = f"(?s)({_longest_first(fixed.LATIN_CONSONANTS, fixed.LATIN_VOWEL_SIGNS)}|.)"


def _spell_tokens(tokens: Column) -> Column:
    """Spellings of one tokenised word: one text, or two where it ends in a long "a" sign."""

    def variants(spelled: Column) -> Column:
        shorter = F.when(
            spelled.endswith(fixed.LONG_A_SIGN), F.left(spelled, F.length(spelled) - 1)
        )
        return F.array_compact(F.array(spelled, shorter))

    return let(_signs(tokens), variants)


def _signs(tokens: Column) -> Column:
    """The signs of one tokenised word as one text."""
    signs = lookup_table({**fixed.LATIN_CONSONANTS, **fixed.LATIN_VOWEL_SIGNS})
    initials = lookup_table(fixed.LATIN_INITIAL_VOWELS)
    last = F.size(tokens) - 1

    def sign(token: Column, i: Column) -> Column:
        first = F.when(i == 0, F.try_element_at(initials, token))
        inner_a = F.when((i > 0) & (i < last) & (token == "a"), "")
        return F.coalesce(first, inner_a, F.try_element_at(signs, token), token)

    return F.array_join(F.transform(tokens, sign), "")


def _tokens(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(_TOKEN), F.lit(1))


def _spell_word(word: Column) -> Column:
    """Devanagari spellings of one normalised Latin word: array of one or two texts."""
    common = F.try_element_at(lookup_table(fixed.COMMON_NAMES), word)
    return F.coalesce(F.nullif(F.array(common), F.array(F.lit(None).cast("string"))), let(_tokens(word), _spell_tokens))


def _first_spelling(word: Column) -> Column:
    """The first of :func:`_spell_word`."""
    return F.coalesce(F.try_element_at(lookup_table(fixed.COMMON_NAMES), word), let(_tokens(word), _signs))


def to_devanagari(c: Column) -> Column:
    """Candidate Devanagari spellings of a Latin text, best first, at most five."""
    def extend(done: Column, group: Column) -> Column:
        longer = F.flatten(
            F.transform(
                done,
                lambda head: F.transform(
                    group, lambda word: F.when(head == "", word).otherwise(F.concat_ws(" ", head, word))
                ),
            )
        )
        # Later words only lengthen a phrase, so the first five stay the first five.
        return F.slice(longer, 1, MAX_SPELLINGS)

    def combine(norm: Column) -> Column:
        groups = F.transform(F.split(norm, " "), _spell_word)
        return F.when(norm != "", F.aggregate(groups, F.array(F.lit("")), extend))

    none = F.array().cast("array<string>")
    return F.coalesce(let(normalize_latin(c), combine), none)


def first_devanagari(c: Column) -> Column:
    """The best Devanagari spelling, NULL when there is none: the first of :func:`to_devanagari`, without the others."""

    def longer(head: Column, word: Column) -> Column:
        return F.when(head == "", word).otherwise(F.concat_ws(" ", head, word))

    def combine(norm: Column) -> Column:
        words = F.transform(F.split(norm, " "), _first_spelling)
        return F.when(norm != "", F.aggregate(words, F.lit(""), longer))

    return let(normalize_latin(c), combine)


def _latin_word(word: Column) -> Column:
    consonants = "".join(fixed.DEVANAGARI_CONSONANTS)
    vowels = "".join(fixed.DEVANAGARI_VOWELS)
    # A consonant in front of anything but a vowel sign or halant carries a short "a".
    spoken = F.regexp_replace(word, f"([{consonants}])(?=[^{vowels}{fixed.HALANT}])", "$1a")
    spoken = F.replace(spoken, F.lit(fixed.HALANT), F.lit(""))
    table = lookup_table({**fixed.DEVANAGARI_VOWELS, **fixed.DEVANAGARI_CONSONANTS})
    letters = F.transform(F.split(spoken, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch))
    capital = let(
        F.array_join(letters, ""),
        lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30)),
    )
    inverse: dict[str, str] = {}
    for latin, dev in fixed.COMMON_NAMES.items():
        inverse.setdefault(dev, latin.upper())
    return F.coalesce(F.try_element_at(lookup_table(inverse), word), capital)


def to_latin(c: Column) -> Column:
    """Latin spelling of a Devanagari text: known names in capitals, others capitalised."""
    words = F.transform(F.split(normalize_devanagari(c), " "), _latin_word)
    return F.trim(F.array_join(F.filter(words, lambda w: w != ""), " "))


def _split_ending(text: Column, endings: list[str]) -> list[Column]:
    return [
        F.when(
            text.endswith(e) & (F.length(text) > len(e)),
            F.concat(F.left(text, F.length(text) - len(e)), F.lit(" " + e)),
        )
        for e in endings
    ]


def split_name_endings(c: Column) -> Column:
    """Unspaced form and "prefix ending" forms of a compound name (no transliteration)."""
    clean = trim_ws(c)
    lower = F.lower(clean)
    dev = detect_script(clean) == "devanagari"
    lat = (detect_script(clean) == "latin") & ~lower.contains(" ")
    forms = [F.when(unspaced(clean) != "", unspaced(clean))]
    forms += [F.when(dev, x) for x in _split_ending(clean, fixed.DEVANAGARI_NAME_ENDINGS)]
    forms += [F.when(lat, x) for x in _split_ending(lower, fixed.LATIN_NAME_ENDINGS)]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def query_script(c: Column) -> Column:
    """Script reported for a query; digits and symbols count as Latin."""
    script = detect_script(c)
    return F.when(script.isin("numeric", "unknown"), "latin").otherwise(script)


def expand_query(c: Column) -> Column:
    """All texts a query stands for: itself, unspaced, other script, split name endings."""
    texts = let(
        F.struct(c.alias("given"), trim_ws(c).alias("clean"), unspaced(c).alias("joined")),
        lambda q: _expansion(q["given"], q["clean"], q["joined"]),
    )
    return F.filter(F.array_distinct(F.array_compact(texts)), lambda t: t != "")


def _expansion(given: Column, clean: Column, joined: Column) -> Column:
    none = F.array().cast("array<string>")
    from_dev = F.concat(
        let(to_latin(clean), lambda x: F.array(x, F.lower(x), unspaced(x))),
        F.array(*_split_ending(clean, fixed.DEVANAGARI_NAME_ENDINGS)),
    )
    with_joined = F.flatten(F.transform(to_devanagari(clean), lambda s: F.array(s, unspaced(s))))
    of_joined = F.when(joined != clean, to_devanagari(joined)).otherwise(none)
    lower = F.lower(clean)
    split_forms = F.filter(
        F.array(*_split_ending(lower, fixed.LATIN_NAME_ENDINGS)),
        lambda s: s.isNotNull() & ~lower.contains(" "),
    )
    split_spelled = F.flatten(
        F.transform(split_forms, lambda s: F.concat(F.array(s), to_devanagari(s)))
    )
    from_latin = F.concat(with_joined, of_joined, split_spelled)
    extra = let(
        detect_script(clean),
        lambda script: F.when(script == "devanagari", from_dev)
        .when(script == "latin", from_latin)
        .otherwise(none),
    )
    return F.concat(F.array(given, joined), extra)
