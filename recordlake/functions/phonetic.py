"""One sound key for names in Devanagari and Latin letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sound class of every Devanagari letter. Aspirates go with their plain sound, long vowels with short
# ones, retroflex letters with dentals, and nasal signs with N; what is not listed here is dropped by DROPPED.
CLASSES = {
    "A": "अआइईउऊएऐओऔऑािीुूेैोौॉ",
    "K": "कखक़ख़", "G": "गघग़", "C": "चछ", "J": "जझज़", "T": "टठतथ", "D": "डढदधड़ढ़", "N": "ङञणनंँ", "P": "पफफ़", "B": "बभ",
    "M": "म", "Y": "य", "R": "रऋृ", "L": "लळ", "V": "व", "S": "शषस", "H": "ह",
}
#: Halant, nukta and visarga join or end sounds and have none of their own.
DROPPED = "़्ः"
# Latin spellings of one sound, in the order in which they are replaced.
LATIN_SPELLINGS = [
    ("chh", "C"), ("ch", "C"), ("ksh", "KS"), ("ngh", "NH"), ("kh", "K"), ("gh", "G"), ("gy", "JN"), ("jh", "J"), ("th", "T"), ("dh", "D"),
    ("ph", "P"), ("bh", "B"), ("sh", "S"), ("ck", "K"), ("x", "KS"),
]
LATIN_LETTERS = ("aeiouqcwzfbdghjklmnprstvy", "AAAAAKKVJPBDGHJKLMNPRSTVY")


def _devanagari() -> tuple[str, str]:
    pairs = {letter: sound for sound, letters in CLASSES.items() for letter in letters if letter not in DROPPED}
    return "".join(pairs) + DROPPED, "".join(pairs.values())


DEVANAGARI = _devanagari()


def sound_key(text: Column) -> Column:
    """Sounds of every word: consonant classes in order, A for a vowel at its beginning; NULL where nothing sounds.

    The key is the same for spellings that differ in aspiration, vowels behind the first letter, doubled letters, the
    nasal in front of another consonant, and for the same name in either script. Signs and digits end words.
    """
    s = F.translate(F.lower(text), *DEVANAGARI)  # Devanagari sounds are upper case from here on, so no Latin rule joins them
    for spelling, sound in LATIN_SPELLINGS:
        s = F.replace(s, F.lit(spelling), F.lit(sound))
    s = F.regexp_replace(F.translate(s, *LATIN_LETTERS), "[^A-Z]+", " ")
    s = F.regexp_replace(s, "([A-Z])A+", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"([B-Z])\1+", "$1"), "M([PB])", "N$1")
    return F.nullif(F.trim(s), F.lit(""))


def sound_key_sql(text: str) -> str:
    """The same in DuckDB SQL, which has no back references."""
    s = f"translate(lower({text}), '{DEVANAGARI[0]}', '{DEVANAGARI[1]}')"
    for spelling, sound in LATIN_SPELLINGS:
        s = f"replace({s}, '{spelling}', '{sound}')"
    s = f"regexp_replace(translate({s}, '{LATIN_LETTERS[0]}', '{LATIN_LETTERS[1]}'), '[^A-Z]+', ' ', 'g')"
    s = rf"regexp_replace({s}, '([A-Z])A+', '\1', 'g')"
    for sound in CLASSES:
        if sound != "A":
            s = f"regexp_replace({s}, '{sound}+', '{sound}', 'g')"
    return rf"nullif(trim(regexp_replace({s}, 'M([PB])', 'N\1', 'g')), '')"
