"""Benchmark passages in training text, found with a generalised suffix automaton of the test items.

The automaton's symbols are words. A document is streamed through it once; the
state tells at every word how long a run of words ends here that some item holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import id_and_text, in_batches

#: Digits, a-z after lower-casing A-Z, and every character beyond ASCII (its UTF-8 bytes are all 0x80 or more).
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the items behind every window.

    A window is ``n`` consecutive words of an item, or the whole of a shorter item.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], n: int = 13):
        self.n, self.words, self.next, self.link, self.length = n, {}, {}, [-1], [0]
        self.out: list[list[int]] = [[]]  # words that lead on from a state
        items = [(name, [self.words.setdefault(w, len(self.words)) for w in ws]) for name, ws in items if ws]
        self.base = len(self.words) + 1
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: State of a window of full length -> its items; state of a short item -> (length, items).
        self.windows: dict[int, set] = {}
        self.short: dict[int, tuple[int, set]] = {}
        for name, ws in items:
            for i, (state, run) in enumerate(self.walk(ws)):
                if len(ws) >= n and i >= n - 1:
                    self.windows.setdefault(self.above(state, n), set()).add(name)
                elif len(ws) < n and i == len(ws) - 1:
                    self.short.setdefault(self.above(state, run), (run, set()))[1].add(name)
        #: The nearest state on the way up that ends a short item, the state itself included.
        self.up = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.up[s] = s if s in self.short else self.up[self.link[s]]
        self.least = min([n, *(k for k, _ in self.short.values())])

    def _extend(self, last: int, w: int) -> int:
        step, base = self.next, self.base
        there = step.get(last * base + w)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, w, there)
        new = self._state(self.length[last] + 1, 0)
        at = last
        while at != -1 and at * base + w not in step:
            step[at * base + w] = new
            self.out[at].append(w)
            at = self.link[at]
        if at != -1:
            there = step[at * base + w]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._clone(at, w, there)
        return new

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.length) - 1

    def _clone(self, at: int, w: int, there: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[there])
        for x in self.out[there]:
            self.next[copy * self.base + x] = self.next[there * self.base + x]
        self.out[copy] = list(self.out[there])
        self.link[there] = copy
        while at != -1 and self.next.get(at * self.base + w) == there:
            self.next[at * self.base + w] = copy
            at = self.link[at]
        return copy

    def above(self, state: int, run: int) -> int:
        """The state of the last ``run`` words of what was read."""
        while self.length[self.link[state]] >= run:
            state = self.link[state]
        return state

    def walk(self, numbers: Iterable[int | None]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest run that ends here) after every word."""
        state, run, step, base, link, length = 0, 0, self.next.get, self.base, self.link, self.length
        for w in numbers:
            if w is None:
                state = run = 0
            else:
                there = step(state * base + w)
                while there is None and state:
                    state = link[state]
                    run = length[state]
                    there = step(state * base + w)
                if there is None:
                    run = 0
                else:
                    state, run = there, run + 1
            yield state, run

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(disjoint spans of words hit, items whose windows occur)."""
        spans: list[list[int]] = []
        found: set = set()
        n, least, get, step = self.n, self.least, self.words.get, self.next.get
        base, link, length, up = self.base, self.link, self.length, self.up
        state = run = 0
        for i, w in enumerate(map(get, words)):
            if w is None:
                state = run = 0
                continue
            there = step(state * base + w)
            while there is None and state:
                state = link[state]
                run = length[state]
                there = step(state * base + w)
            if there is None:
                run = 0
                continue
            state = there
            run += 1
            if run < least:
                continue
            begin = None
            if run >= n:
                found |= self.windows.get(self.above(state, n), ())
                begin = i + 1 - n
            s = up[state]
            while s > 0:
                k, names = self.short[s]
                if k <= run:
                    found |= names
                    begin = i + 1 - k if begin is None else min(begin, i + 1 - k)
                s = up[link[s]]
            if begin is not None:
                while spans and spans[-1][1] >= begin and spans[-1][0] >= begin:
                    spans.pop()
                if spans and spans[-1][1] >= begin:
                    spans[-1][1] = i + 1
                else:
                    spans.append([begin, i + 1])
        return [(a, b) for a, b in spans], found


def automata(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text", most_words: int = 200_000):
    """Automata over all items, each of about ``most_words`` words, so that none outgrows a broadcast.

    Items come to the driver one after another. The documents are matched against
    every automaton of the list in one pass.
    """
    out, held, size = [], [], 0
    for r in id_and_text(benchmark, id_col, text_col).toLocalIterator():
        held.append((r.doc_id, words := words_of(r.text)))
        size += len(words)
        if size >= most_words:
            out.append(Automaton(held, n))
            held, size = [], 0
    return [*out, *([Automaton(held, n)] if held else [])]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def judged(text: str | None, machines: list[Automaton], percent: int = 5) -> tuple[int, list[tuple[int, int]], set, bool]:
    """(words, spans hit, items found, contaminated)."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    found: set = set()
    for m in machines:
        s, f = m.scan(words)
        spans += s
        found |= f
    spans = _merged(spans) if len(machines) > 1 else spans
    hit = sum(b - a for a, b in spans)
    return len(words), spans, found, hit > 0 and 100 * hit >= percent * len(words)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans of words, and what stands between their words, cut out."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, end = [], 0
    for a, b in spans:
        out.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, raw[end:]]).decode()


def report(
    docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans hit (in words).

    Contaminated: some words are hit, and at least ``percent`` of all. Null and
    empty texts have no words. Repeated rows and ids are each judged alone; a null item
    id is the item ``null``. An empty benchmark hits nothing.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")]
        + [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
           T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))]
    )
    machines = docs.sparkSession.sparkContext.broadcast(automata(benchmark, n, item_col, item_text_col))

    def rows(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n_words, spans, found, bad = judged(text, machines.value, percent)
                names = ",".join(sorted("null" if x is None else str(x) for x in found))
                hit = sum(b - a for a, b in spans)
                yield doc, n_words, hit, len(found), hashlib.sha256(names.encode()).hexdigest(), bad, spans

    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: in_batches(schema, rows(it)), schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5, longest: int | None = None,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without contaminated documents (see :func:`report`).

    With ``longest``, documents that stay also lose every span of at least that
    many words; without it their texts stay whole.
    """
    machines = docs.sparkSession.sparkContext.broadcast(automata(benchmark, n, item_col, item_text_col))
    schema, at, arrow = docs.schema, docs.columns.index(text_col), to_arrow_schema(docs.schema)

    def kept(batches):
        for b in batches:
            keep, texts = [], b.column(at).to_pylist()
            for i, text in enumerate(texts):
                _, spans, _, bad = judged(text, machines.value, percent)
                keep.append(not bad)
                if longest and not bad and (long := [s for s in spans if s[1] - s[0] >= longest]):
                    texts[i] = without_spans(text, long)
            columns = [*b.columns[:at], pa.array(texts, arrow[at].type), *b.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            ).filter(pa.array(keep))

    return docs.mapInArrow(kept, schema)
