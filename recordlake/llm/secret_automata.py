"""Secrets by grammar inference: probabilistic automata of credential formats, learned by merging the states of a prefix tree.

Values of fixed patterns (behind a key word, access keys, long hexadecimal runs) are the
labelled credentials; all other long runs of the same characters are the ordinary
ones. A value is read as symbols of its format (:func:`format_of`). Per label, and for
the ordinary values, the prefix tree of the sampled formats is turned into an automaton: states
whose frequencies differ by less than a Hoeffding bound, all the way down, are merged.
Every candidate of every text is then scored by the likelihood of its format and
characters under the credentials' automata against the ordinary one. The fixed patterns' spans always stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, id_and_text, in_batches

BASE = ("assign", "access", "hex")
ADDED = "format"
ORDINARY = "ordinary"
#: Labelled values and ordinary ones that the automata are learned from, about; values with more characters are not learned from.
LABELLED, PLAIN, LONGEST = 4000, 12_000, 512
#: Characters of a candidate at least.
SHORTEST = 16

_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""")
_KEY_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}+")
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"[0-9a-f]++")
_PIECE = re.compile(r"[A-Za-z0-9]+|[+/_.=-]")
_PARTS = re.compile(r"=+(?=[^=])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place of the kind in ``BASE``) by start, then kind: whole matches, leftmost and not overlapping within a kind.

    Access keys and hexadecimal runs of the required length lie inside runs of 16 or more credential characters, so only these are searched.
    """
    out = []
    low = text.lower()
    if any(w in low for w in _KEY_WORDS):
        out += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    for run in _RUN.finditer(text):
        out += [(*m.span(), 1) for m in _ACCESS.finditer(text, *run.span()) if m.end() - m.start() >= 16]
        out += [(*m.span(), 2) for m in _HEX.finditer(text, *run.span()) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of 16 or more credential characters, cut behind equals signs, that touch no span of ``taken``; full stops around them do not count."""
    at, spans = 0, sorted(taken)
    reach = -1  # where the spans that begin before the candidate end
    for run in _RUN.finditer(text):
        begin, cuts = run.start(), [*((m.start(), m.end()) for m in _PARTS.finditer(text, *run.span())), (run.end(), run.end())]
        for stop, following in cuts:
            start, end = begin, stop
            begin = following
            while start < end and text[start] == ".":
                start += 1
            while end > start and text[end - 1] == ".":
                end -= 1
            if end - start < SHORTEST:
                continue
            while at < len(spans) and spans[at][0] < end:
                reach = max(reach, spans[at][1])
                at += 1
            if reach <= start:
                yield start, end


def _kind(piece: str) -> str:
    """Symbol of a piece of letters and digits: its least class of characters."""
    if piece.isdigit():
        return "0"
    lower, upper = piece.islower(), piece.isupper()
    if piece.isalpha():
        return "a" if lower else "A" if upper else "C" if piece[1:].islower() else "M"
    if lower:
        return "f" if all(c in "0123456789abcdef" for c in piece) else "z"
    if upper:
        return "F" if all(c in "0123456789ABCDEF" for c in piece) else "Z"
    return "X"


#: How many characters each class can be; a literal character is one.
_SIZES = {"0": 10, "a": 26, "A": 26, "C": 52, "M": 52, "f": 16, "F": 16, "z": 36, "Z": 36, "X": 62}


def format_of(value: str, heads: frozenset[str] = frozenset()) -> list[str]:
    """A symbol for every character.

    Signs, and short pieces of letters in front of ``_`` or ``-``, stand for themselves, as do the first four characters
    where they are one of ``heads``. Any other piece of letters and digits has its class as often as it has characters.
    """
    out: list[str] = []
    literal = 0
    if value[:4] in heads:
        out, literal = [f"={c}" for c in value[:4]], 4
    for m in _PIECE.finditer(value, literal):
        piece = m[0]
        if not piece[0].isalnum():
            out.append(f"={piece}")
        elif len(piece) <= 6 and piece.isalpha() and value[m.end() : m.end() + 1] in ("_", "-"):
            out += [f"={c}" for c in piece]
        else:
            out += [_kind(piece)] * len(piece)
    return out


@dataclass
class Automaton:
    """States with counts: how often each was reached, ended in, and left by each symbol to which state."""

    reached: list[float] = field(default_factory=list)
    ended: list[float] = field(default_factory=list)
    moves: list[dict[str, int]] = field(default_factory=list)
    passed: list[dict[str, float]] = field(default_factory=list)

    def state(self) -> int:
        self.reached.append(0)
        self.ended.append(0)
        self.moves.append({})
        self.passed.append({})
        return len(self.reached) - 1

    def log_likelihood(self, symbols: list[str], smooth: float = 0.2, symbols_known: int = 70) -> float:
        """Log probability of the string; what was never seen has a small share in every state and leads to a state that knows nothing."""
        at, total = 0, 0.0
        for s in symbols:
            if at < 0:
                total -= math.log(symbols_known + 1)
                continue
            share = self.passed[at].get(s, 0.0)
            total += math.log((share + smooth / symbols_known) / (self.reached[at] + smooth + smooth))
            at = self.moves[at].get(s, -1)
        if at < 0:
            return total - math.log(symbols_known + 1)
        return total + math.log((self.ended[at] + smooth) / (self.reached[at] + 2 * smooth))


def prefix_tree(strings: Iterable[tuple[tuple[str, ...], int]]) -> Automaton:
    tree = Automaton()
    tree.state()
    for symbols, n in strings:
        at = 0
        tree.reached[at] += n
        for s in symbols:
            if s not in tree.moves[at]:
                tree.moves[at][s] = tree.state()
            tree.passed[at][s] = tree.passed[at].get(s, 0) + n
            at = tree.moves[at][s]
            tree.reached[at] += n
        tree.ended[at] += n
    return tree


def compatible(a: Automaton, p: int, q: int, bound: float) -> bool:
    """Whether two states, and all that both lead to, end and go on alike within the Hoeffding bound."""
    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        n, m = a.reached[p], a.reached[q]
        if not n or not m:
            continue
        most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if abs(a.ended[p] / n - a.ended[q] / m) > most:
            return False
        for s in a.passed[p].keys() | a.passed[q].keys():
            if abs(a.passed[p].get(s, 0) / n - a.passed[q].get(s, 0) / m) > most:
                return False
            if s in a.moves[p] and s in a.moves[q]:
                todo.append((a.moves[p][s], a.moves[q][s]))
    return True


def fold(a: Automaton, into: int, tree: int) -> None:
    """Add the counts of a subtree to a state and what follows it."""
    todo = [(into, tree)]
    while todo:
        into, tree = todo.pop()
        a.reached[into] += a.reached[tree]
        a.ended[into] += a.ended[tree]
        for s, n in a.passed[tree].items():
            a.passed[into][s] = a.passed[into].get(s, 0) + n
            if s in a.moves[into]:
                todo.append((a.moves[into][s], a.moves[tree][s]))
            else:
                a.moves[into][s] = a.moves[tree][s]


def infer(strings: Iterable[tuple[tuple[str, ...], int]], alpha: float = 0.05) -> Automaton:
    """The prefix tree with its compatible states merged, those nearest the root first; deterministic."""
    a = prefix_tree(sorted(strings))
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, seen = [0], {0}
    waiting = deque((0, s) for s in sorted(a.moves[0]))
    while waiting:
        parent, s = waiting.popleft()
        blue = a.moves[parent][s]
        if blue in seen:
            continue
        for r in red:
            if compatible(a, r, blue, bound):
                a.moves[parent][s] = r
                fold(a, r, blue)
                waiting.extend((x, t) for x in red for t in sorted(a.moves[x]) if a.moves[x][t] not in seen)
                break
        else:
            red.append(blue)
            seen.add(blue)
            waiting.extend((blue, t) for t in sorted(a.moves[blue]))
    place = {r: i for i, r in enumerate(red)}
    return Automaton(
        [a.reached[r] for r in red], [a.ended[r] for r in red],
        [{s: place[x] for s, x in a.moves[r].items()} for r in red], [a.passed[r] for r in red],
    )


@dataclass
class Format:
    """An automaton of formats and the characters of its classes, by class and the character before."""

    automaton: Automaton
    heads: frozenset[str]
    single: dict[tuple[str, str], int]
    double: dict[tuple[str, str, str], int]

    @classmethod
    def learn(cls, values: list[str], alpha: float, head_share: float = 0.05) -> Format:
        heads = Counter(v[:4] for v in values)
        common = frozenset(h for h, n in heads.items() if n >= max(5, head_share * len(values)))
        single, double, formats = Counter(), Counter(), Counter()
        for v in values:
            symbols = format_of(v, common)
            formats[tuple(symbols)] += 1
            for s, before, c in zip(symbols, " " + v, v, strict=False):
                single[s, c] += 1
                single[s, ""] += 1
                double[s, before, c] += 1
                double[s, before, ""] += 1
        return cls(infer(formats.items(), alpha), common, dict(single), dict(double))

    def log_likelihood(self, value: str) -> float:
        symbols = format_of(value, self.heads)
        total = self.automaton.log_likelihood(symbols)
        for s, before, c in zip(symbols, " " + value, value, strict=False):
            size = _SIZES.get(s, 1)
            if size > 1:
                one = (self.single.get((s, c), 0) + 0.5) / (self.single.get((s, ""), 0) + 0.5 * size)
                total += math.log((self.double.get((s, before, c), 0) + 4 * one) / (self.double.get((s, before, ""), 0) + 4))
        return total


@dataclass
class Model:
    """The formats of labelled values by label, that of ordinary ones, and the log odds that a credential must beat."""

    secret: dict[str, Format]
    ordinary: Format | None
    limit: float

    def score(self, value: str) -> float:
        """Log odds of the likeliest credential format against the ordinary one; above 0 for a credential."""
        if not self.secret or self.ordinary is None:
            return -math.inf
        return max(f.log_likelihood(value) for f in self.secret.values()) - self.ordinary.log_likelihood(value) - self.limit


def learn(labelled: dict[str, list[str]], ordinary: list[str], limit: float = 0.0, alpha: float = 0.05, least: int = 20) -> Model:
    """Automata of every label with at least ``least`` different values, and of the ordinary values."""
    return Model(
        {k: Format.learn(sorted(set(v)), alpha) for k, v in sorted(labelled.items()) if len(set(v)) >= least},
        Format.learn(sorted(set(ordinary)), alpha) if ordinary else None, limit,
    )


def labelled_values(text: str) -> Iterator[tuple[str, str]]:
    """(label, value): what the fixed patterns hold, and the candidates outside of them."""
    base = base_spans(text)
    for start, end, kind in base:
        value = text[start:end] if kind else _ASSIGN.match(text, start)[1]
        yield BASE[kind], value
    for start, end in candidates(text, base):
        yield ORDINARY, text[start:end]


def fit(docs: DataFrame, text_col: str = "text", labelled: int = LABELLED, plain: int = PLAIN, alpha: float = 0.05, margin: float = 3.0) -> Model:
    """Learn the automata from a bounded sample of the labelled values of all documents.

    About ``labelled`` different values of each label and ``plain`` ordinary ones with the smallest hashes are
    used, none longer than ``LONGEST`` characters. The log odds to beat are the ratio of all different ordinary values to all
    different labelled ones, and ``margin``. Null and empty texts have no values; copies count
    once. With fewer than 20 labelled values, or no ordinary ones, nothing is added to the fixed patterns.
    """

    def rows(batches):
        for b in batches:
            found = Counter()
            for text in b.column(0).to_pylist():
                found.update(x for x in labelled_values(text or "") if len(x[1]) <= LONGEST)
            yield from found

    schema = T._parse_datatype_string("kind string, value string")
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    values = cut_lineage(texts.mapInArrow(lambda it: in_batches(schema, rows(it)), schema).distinct(), "values")
    total = {r.kind: r.n for r in values.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    place = F.shiftrightunsigned(F.xxhash64("kind", "value"), 11) / float(1 << 53)
    most = F.when(F.col("kind") == ORDINARY, F.lit(plain)).otherwise(F.lit(labelled))
    share = most / F.create_map(*(F.lit(x) for kn in (total or {"": 1}).items() for x in kn))[F.col("kind")]
    sample: dict[str, list[str]] = {}
    for r in values.where(place < share).collect():
        sample.setdefault(r.kind, []).append(r.value)
    ordinary = sample.pop(ORDINARY, [])
    secrets = sum(n for k, n in total.items() if k != ORDINARY)
    return learn(sample, ordinary, math.log(max(total.get(ORDINARY, 0), 1) / max(secrets, 1)) + margin, alpha)


def spans_of(text: str | None, model: Model, known: dict[str, bool]) -> tuple[list, list]:
    """(base spans, all spans) as (start, end, kind); ``known`` keeps the verdicts on values that came before."""
    if not text:
        return [], []
    found = base_spans(text)
    base = [(s, e, BASE[k]) for s, e, k in found]
    more = []
    for s, e in candidates(text, found):
        value = text[s:e]
        if value not in known:
            if len(known) > 50_000:
                known.clear()
            known[value] = model.score(value) > 0
        if known[value]:
            more.append((s, e, ADDED))
    order = {k: i for i, k in enumerate((*BASE, ADDED))}
    return base, sorted([*base, *more], key=lambda s: (s[0], order[s[2]], s[1]))


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, base and spans, both arrays of (kind, start, end) in code points, by start, then kind.

    ``base`` has the fixed patterns' spans, ``spans`` also those that the automata add. Null and empty
    texts have none. Repeated rows and null ids are each searched; other columns are not read. No document: no row.
    """
    span = "array<struct<kind: string, start: bigint, `end`: bigint>>"
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(n, T._parse_datatype_string(span)) for n in ("base", "spans")]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        known: dict[str, bool] = {}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield doc, *([{"kind": k, "start": s, "end": e} for s, e, k in x] for x in spans_of(text, shared.value, known))

    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: in_batches(schema, rows(it)), schema)
