"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

The spans of four fixed patterns are found exactly and always stay. For further
candidates (keys and passwords, names, account and identity numbers) pattern,
gazetteer, context, shape and checksum labelers vote yes, no or nothing; the pattern,
gazetteer and context labelers also propose the candidates, each its own. The votes of all
documents are counted by pattern of votes; expectation-maximisation on those counts
gives every labeler's reliability and every pattern's probability. A logistic
classifier of span and context features, trained on these probabilities, then judges each candidate.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, id_and_text, in_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "person", "id_number")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place of the kind in ``BASE``), leftmost and not overlapping within a kind, in order."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# The gazetteers.
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ")
_KEY_WORDS = ("password", "passwd", "passwort", "contraseña", "token", "secret", "api_key", "apikey", "api-key", "api key", "access_key", "private_key", "credential")
_NUMBER_WORDS = ("ssn", "social security", "iban", "account", "konto", "compte", "cuenta", "passport")
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
_GIVEN = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas "
    "Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Mark Donald Steven Paul Andrew Anna Maria Peter Hans Klaus Jürgen "
    "Sabine Monika Pierre Jean Marie Claire Sophie Carlos José Juan Carmen Lucía Miguel Laura Emma".split()
)
_CONTEXT = {
    "secret": frozenset("password passwd passwort token secret key api credential login pwd contraseña access".split()),
    "person": frozenset("name named called contact author by from dear signed mr mrs ms dr prof herr frau monsieur madame".split()),
    "id_number": frozenset("ssn social security iban account konto compte cuenta id passport number no".split()),
}
_AGAINST = frozenset("version section figure table chapter page isbn sha commit hash checksum example".split())

# Months, days and words that start sentences: no names, and a name ends before them.
_NOT_NAMES = frozenset(
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday "
    "Friday Saturday Sunday A An The This That These Those It He She We They You I In On At To Of For And But Or If As When Then There Here "
    "Is Was Are Were Not No Yes Der Die Das Ein Eine Und Aber Wir Sie Er Es Ich Am Im Le La Les Un Une Et Mais Il Elle Nous El Los Las Una Y Pero".split()
)

_SECRET = re.compile(
    r"(?i:(?:password|passwd|passwort|contraseña|token|secret|api[ _-]?key|(?:access|secret|private)_key|credential)s?)"
    r"(?:\\?[\"'])?\s{0,3}[=:]\s{0,3}"
    r"(?:\"((?:[^\"\\\n]|\\[^\n])++)\"|'((?:[^'\\\n]|\\[^\n])++)'|\\?[\"']?((?:[^\s\"',;\\]|\\(?![\"'])){6,}))"
)
_KEY = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:ghp_|gho_|github_pat_|sk-|sk_live_|xoxb-|xoxp-|AIza|glpat-)[0-9A-Za-z_-]{16,}")
_JWT = re.compile(r"(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{8,}+(?:\.[0-9A-Za-z_-]*+)+")
_NAME = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’-]*+"
_NAMES = re.compile(rf"(?<![\w'’-]){_NAME}(?: (?:[A-Z]\. )*+(?:(?:von|van|de|del|der|den|di|da|du|la|le|bin|al) )*+{_NAME})*+")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b")
_NUMBERED = re.compile(
    r"(?i:\b(?:ssn|social security|iban|account|konto|compte|cuenta|passport)(?: ?(?:number|nr|no)\b\.?)?)[\"']?\s{0,3}[:=#]?\s{0,3}[\"']?"
    r"([A-Z]{0,3}[0-9][0-9A-Z-]{4,})(?![a-z])"
)
_WORD = re.compile(r"\w+")
_DIGIT = re.compile("[0-9]")
_TITLED = frozenset(_TITLES)
_MIXED = re.compile(r"[A-Z]\.|(?:[A-ZÀ-ÖØ-Þ]['’-]?[a-zß-öø-ÿ]+['’-]?)+")
_LOW_TITLES = frozenset(t.lower() for t in _TITLES)


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Capitalised words behind a title or a context word, and given names with the capitalised words behind them."""
    for run in _NAMES.finditer(text):
        start, end = run.span()
        last = _WORD.findall(text[max(0, start - 40) : start].rstrip(" \t\n:=.\"'(")[-20:])[-1:] if start else []
        before = text[max(0, start - 4) : start].strip(" \t")
        behind = bool(last) and (last[0] in _TITLED or (not before.endswith(".") and last[0].lower() in _CONTEXT["person"]))
        # a title, a context word and a word that is no name end one name; another may begin behind them
        parts, words = [], []
        for w in re.finditer("[^ ]+", run[0]):
            if w[0] in _TITLED or w[0].lower() in _CONTEXT["person"]:
                parts.append((behind, words))
                behind, words = True, []
            elif w[0] in _NOT_NAMES:
                parts.append((behind, words))
                behind, words = False, []
            else:
                words.append((start + w.start(), start + w.end(), w[0]))
        for told, found in [*parts, (behind, words)]:
            while found and not found[-1][2][:1].isupper():
                found.pop()
            while found and not told and found[0][2] not in _GIVEN:
                found.pop(0)
            if not found or not (told or len(found) > 1) or not found[0][2][:1].isupper():
                continue
            tail = re.sub(r"(?:['’]s)?['’-]*$", "", found[-1][2])
            if len(tail) > 1 or len(found) > 2:
                yield found[0][0], found[-1][0] + len(tail)


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of spans that some labeler proposes and all vote on."""
    seen = set()
    low = text.lower()
    found = [(*s, "person") for s in _names(text)]
    if any(w in low for w in _KEY_WORDS):
        found += [(*m.span(m.lastindex), "secret") for m in _SECRET.finditer(text)]
    if any(w in text for w in _KEY_STARTS):
        found += [(*m.span(), "secret") for p in (_KEY, _JWT) for m in p.finditer(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), "id_number") for m in _ID.finditer(text)]
        if any(w in low for w in _NUMBER_WORDS):
            found += [(*m.span(1), "id_number") for m in _NUMBERED.finditer(text)]
    for s in sorted(found):
        if s not in seen:
            seen.add(s)
            yield s


def _iban(span: str) -> bool:
    s = span.replace(" ", "")
    if not 15 <= len(s) <= 34 or not s[:2].isalpha():
        return False
    return int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1


def _before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-4:]


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Votes (1 yes, -1 no, 0 nothing) of the pattern, gazetteer, context, shape and checksum labelers."""
    span, before = text[start:end], _before(text, start)
    near = {p for w in before for p in (w, *w.split("_"))}
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())
    if kind == "secret":
        pattern = (
            1 if _KEY.fullmatch(span) or _JWT.fullmatch(span) or re.fullmatch("[0-9a-f]{16,}", span)
            else -1 if span.replace(" ", "").isalpha() and span[1:].islower() else 0
        )
        gazetteer = 1 if span.startswith(_KEY_STARTS) else 0
        shape = 1 if entropy >= 3 and _DIGIT.search(span) else -1 if entropy < 2 else 0
        check = -1 if len(set(span)) <= 2 else 0
    elif kind == "person":
        names = span.split()
        titled = bool(before) and (before[-1] in _LOW_TITLES or text[max(0, start - 3) : start].strip(" \"'")[-1:] in (":", "="))
        pattern = 1 if len(names) >= 2 else 0 if titled else -1
        gazetteer = 1 if names[0] in _GIVEN else 0
        fine = all(n[1:].islower() or _MIXED.fullmatch(n) for n in names)
        shape = -1 if not fine else 1 if len(names) > 1 or gazetteer else 0
        check = -1 if any(_DIGIT.search(n) for n in names) or not (gazetteer or titled or len(names) > 1) else 0
    else:
        pattern = 1 if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", span) and span[:3] not in ("000", "666") and span[0] != "9" else 0
        gazetteer = 1 if span[:2] in ("DE", "FR", "ES", "GB", "IT", "NL", "AT", "BE", "CH", "PT") else 0
        shape = -1 if len(set(re.sub("[^0-9]", "", span))) <= 2 else 1
        check = (1 if _iban(span) else -1) if span[:1].isalpha() else 0
    context = 1 if near & _CONTEXT[kind] else 0
    against = -1 if near & _AGAINST else 0
    return pattern, gazetteer, context, against, shape, check


def features(text: str, start: int, end: int, kind: str, size: int = 1024) -> np.ndarray:
    """Buckets of the span's shape, its pieces and the words before it."""
    span = text[start:end]
    shape = re.sub("[0-9]+", "9", re.sub("[a-zà-ÿ]+", "a", re.sub("[A-ZÀ-Ö]+", "A", span)))[:24]
    names = ["bias", shape, f"n{min(len(span) // 4, 12)}", f"p{span[:4]}", f"d{sum(map(str.isdigit, span)) * 4 // len(span)}"]
    names += [f"w{w}" for w in _before(text, start)]
    return np.array([zlib.crc32(f"{kind}|{x}".encode()) % size for x in names])


@dataclass
class Model:
    """``reliability``: (kind, labeler) -> probabilities of the votes (-1, 0, 1) for other and for personal spans."""

    weights: np.ndarray
    prior: dict[str, float]
    reliability: dict[tuple[str, int], np.ndarray]

    def probability(self, text: str, start: int, end: int, kind: str) -> float:
        return float(1 / (1 + np.exp(-self.weights[features(text, start, end, kind, len(self.weights))].sum())))


def aggregate_votes(patterns: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> tuple[dict, dict, dict]:
    """(prior per kind, reliabilities, probability per pattern of votes) by expectation-maximisation.

    Starts from the majority of the votes. Every probability keeps a small count of
    its own, so a labeler that never votes says nothing.
    """
    prior, reliability, posterior = {}, {}, {}
    for kind in sorted({k for k, _ in patterns}):
        rows = sorted((v, n) for (k, v), n in patterns.items() if k == kind)
        v, n = np.array([r[0] for r in rows]) + 1, np.array([r[1] for r in rows], dtype=float)
        q = 1 / (1 + np.exp(-2.0 * (v - 1).sum(1)))
        for _ in range(rounds):
            p = float(((q * n).sum() + 1) / (n.sum() + 2))
            table = np.zeros((v.shape[1], 2, 3))
            for j in range(v.shape[1]):
                for value in range(3):
                    hit = (v[:, j] == value) * n
                    table[j, 1, value], table[j, 0, value] = (hit * q).sum() + 1, (hit * (1 - q)).sum() + 1
                # what a labeler is for, as counts: yes is for personal spans, no for others
                table[j, 1, 2] += 2
                table[j, 0, 0] += 2
            table /= table.sum(2, keepdims=True)
            odds = math.log(p / (1 - p)) + sum(np.log(table[j, 1, v[:, j]] / table[j, 0, v[:, j]]) for j in range(v.shape[1]))
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior[kind] = p
        reliability |= {(kind, j): table[j] for j in range(v.shape[1])}
        posterior |= {(kind, r[0]): float(x) for r, x in zip(rows, q, strict=True)}
    return prior, reliability, posterior


def fit(docs: DataFrame, text_col: str = "text", sample: int = 20_000, size: int = 1024, steps: int = 300) -> Model:
    """Weigh the labelers by the votes of all documents and train the classifier.

    The votes are counted over every candidate of every text, by pattern (at most
    a few hundred rows). The classifier sees at most about ``sample`` candidates, those
    with the smallest hashes, each with its pattern's probability as label.
    """
    schema = T._parse_datatype_string("kind string, votes array<int>, features array<int>")

    def rows(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                for start, end, kind in candidates(text or ""):
                    yield kind, list(votes(text, start, end, kind)), features(text, start, end, kind, size).tolist()

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    found = cut_lineage(texts.mapInArrow(lambda it: in_batches(schema, rows(it)), schema), "candidates")
    patterns = {(r.kind, tuple(r.votes)): r.n for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(size)
    if not patterns:
        return Model(weights - 1, {}, {})
    prior, reliability, posterior = aggregate_votes(patterns)
    grouped = found.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    share = sample / max(sample, sum(patterns.values()))
    place = F.shiftrightunsigned(F.xxhash64("kind", "votes", "features"), 11) / float(1 << 53)
    part = grouped.where(place < F.lit(share)).orderBy(place, "kind", "features", "votes").limit(sample).collect()
    x = np.zeros((len(part), size), dtype=np.float32)
    for i, r in enumerate(part):
        np.add.at(x[i], r.features, 1)
    y = np.array([posterior[r.kind, tuple(r.votes)] for r in part])
    n = np.log1p([r.n for r in part])
    for _ in range(steps if len(part) else 0):
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= 0.5 * (x.T @ ((p - y) * n) / n.sum() + 1e-4 * weights)
    return Model(weights, prior, reliability)


def spans_of(text: str | None, model: Model, at_least: float = 0.5) -> tuple[list, list]:
    """(base spans, all spans) as (start, end, kind)."""
    if not text:
        return [], []
    base = [(s, e, BASE[k]) for s, e, k in base_spans(text)]
    more, end = [], dict.fromkeys(ADDED, -1)
    for c in sorted((c for c in candidates(text) if model.probability(text, *c) >= at_least), key=lambda c: (c[0], -c[1])):
        if c[1] > end[c[2]]:  # not inside a span of the same kind
            more.append(c)
            end[c[2]] = c[1]
    order = {k: i for i, k in enumerate((*BASE, *ADDED))}
    return base, sorted([*base, *more], key=lambda s: (s[0], order[s[2]], s[1]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are covered whole under the kind of the first."""
    out, end = [], 0
    for s, e, kind in spans:
        if s >= end:
            out += [text[end:s], f"<{kind}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def find(
    docs: DataFrame, model: Model, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, on demand the masked text.

    The counts and the hash are of the fixed patterns; ``spans`` lists these and the
    spans that the classifier adds, as kind:start:end in code points, by start, then
    kind. Null and empty texts have no spans. Repeated rows are each searched. No document: no row.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
        + ([T.StructField("masked", T.StringType())] if with_text else [])
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, every = spans_of(text, shared.value, at_least)
                told = [",".join(f"{k}:{s}:{e}" for s, e, k in x) for x in (base, every)]
                n = Counter(k for _, _, k in base)
                more = [masked(text, every) if text else text] if with_text else []
                yield doc, *(n[k] for k in BASE), hashlib.sha256(told[0].encode()).hexdigest(), told[1], *more

    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: in_batches(schema, rows(it)), schema)
