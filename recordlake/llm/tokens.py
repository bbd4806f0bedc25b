"""Token ids of whole texts with the tokenizers library, one lookup per known word.

Both supported vocabularies cut a text at blanks and line feeds, and what comes
out for a piece does not depend on its neighbours. So each piece is encoded once
per Python worker and kept; the ids of a text are the joined ids of its pieces.
Texts with other white space or with special-token strings go to the library whole.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import sole

#: White space, or what some library version may take for it, besides blank and line feed; or a special token.
_WHOLE = re.compile("[^\\S \\n]|[\u180e\u200b\ufeff]|<\\|")
#: Letters of one byte block with their marks composed, then plain marks: the library makes one word of each part.
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
_PIECES = {"words": re.compile(r"[^ \n]+"), "bytes": re.compile(r"[ \n]*[^ \n]+|[ \n]+")}
#: Letters of one byte, perhaps behind a line feed: the library makes one word of them.
_LETTERS = "\\A\\n?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+\\z"
_ONE_BYTE_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte value in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _is_whole(text: str) -> bool:
    """Whether a text goes to the library as it is. Printable text has no white space besides blanks, so most need no scan."""
    return "<|" in text or not text.replace("\n", " ").isprintable() and _WHOLE.search(text) is not None


def _spread(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of ``data`` that the codes stand for, one behind the other; where each ends)."""
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    places = np.repeat(begins[codes] - (ends - lengths), lengths)
    places += np.arange(len(places))
    return data[places], ends


class Encoder(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers.

    At most ``keep`` pieces are kept; when full, it starts anew. Byte-level pieces
    are cut at blanks, which is several times faster than by a pattern: a key stands
    for itself behind one blank, or for itself if it begins with a line feed; a key
    that begins with a blank stands for what follows that blank.
    """

    def __init__(self, definition: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(definition)
        self.model, self.room, self.letters = self.library.model, keep, _byte_letters()
        stated = json.loads(definition)
        before, suffix = stated.get("pre_tokenizer") or {}, stated["model"].get("end_of_word_suffix")
        self.kind = None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not stated.get("normalizer"):
            self.kind = "bytes"
            self.stand_in = np.array([ord(self.letters[b]) for b in range(256)], dtype="<u2")
            self.line_feed, self.marks = _pack(self._letters("\n")), {}
        elif suffix and "Lowercase" in json.dumps(stated.get("normalizer")):
            self.kind = "words"

    def _letters(self, word: str) -> list[int]:
        plain = word if word.isascii() and word != "\n" else "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(plain)]

    def __missing__(self, piece: str) -> bytes:
        simple = _SIMPLE.fullmatch(piece) if self.kind == "words" and len(piece) < 64 else None
        if simple:
            word, marks = simple.groups()
            ids = self._letters(word.lower())
            if marks:
                ids += self._letters(marks)
        else:
            plain = piece
            if self.kind == "bytes" and piece[:1] != "\n":
                plain = piece[1:] if piece[:1] == " " else " " + piece
            ids = self.library.encode(plain, add_special_tokens=False).ids
        out = _pack(ids)
        if len(piece) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[piece] = out
        return out

    def _learn(self, column: pa.Array) -> list[bytes]:
        """The ids of new byte-level keys without marks behind letters, which are kept: words of letters by the model, others by the library."""
        keys = column.to_numpy(zero_copy_only=False).tolist()
        simple = pc.and_(pc.less(pc.binary_length(column), 64), pc.match_substring_regex(column, _LETTERS)).to_numpy(zero_copy_only=False)
        words, others = np.flatnonzero(simple).tolist(), np.flatnonzero(~simple).tolist()
        out = [b""] * len(keys)
        for i in others:
            out[i] = self[keys[i]]
        names = [keys[i] for i in words] if others else keys
        made = self._tokenized(names)
        self.update(zip(names, made, strict=True))
        if not others:
            return made
        for i, ids in zip(words, made, strict=True):
            out[i] = ids
        return out

    def _tokenized(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words of one-byte letters behind a blank, or behind the line feed that they begin with."""
        if not words:
            return []
        plain = "\n".join([word[1:] if word[0] == "\n" else " " + word for word in words])
        letters = self.stand_in[np.frombuffer(plain.encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")
        ids, ends, tokenize = [], [], self.model.tokenize
        for word in letters.split(self.letters[10]):
            ids += [t.id for t in tokenize(word)]
            ends.append(4 * len(ids))
        packed = np.array(ids, dtype="<u4").tobytes()
        return [
            self.line_feed + packed[a:b] if word[0] == "\n" else packed[a:b]
            for word, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)
        ]

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[marks] = _pack(self._letters(marks))
        return self.marks[marks]

    def ids(self, text: str | None) -> bytes:
        return self._one(text)

    def many(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; some million characters at once are a good measure."""
        if self.kind != "bytes":
            return [self._one(text) for text in texts]
        out, held, rests = [], [], []
        for i, text in enumerate(texts):
            cut = text.replace("\n", " \n") if text else ""
            if not text or "  " in cut or "\n " in cut or _is_whole(text):
                out.append(self._one(text))
                continue
            # What stands before the first blank has none before it.
            first, blank, rest = cut.partition(" ")
            out.append(self[" " + first] if first else b"")
            if blank:
                held.append(i)
                rests.append(rest)
        for i, ids in zip(held, self._joined(rests), strict=True):
            out[i] += ids
        return out

    def _joined(self, rests: list[str]) -> list[bytes]:
        """The ids of texts, each piece of which has a blank before it or begins with a line feed; a distinct piece is looked up once."""
        if not rests:
            return []
        cut = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        data, sizes = self._pieces(coded.dictionary)
        codes, begins = coded.indices.to_numpy(), np.cumsum(sizes) - sizes
        ends, out = np.cumsum(pc.list_value_length(cut).to_numpy()).tolist(), []
        for i in range(0, len(ends), 256):
            some = ends[i : i + 256]
            before = ends[i - 1] if i else 0
            ids, stops = _spread(data, begins, sizes, codes[before : some[-1]])
            ids, stops = ids.tobytes(), (stops[np.array(some) - before - 1] * 4).tolist()
            out += [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        return out

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces one behind the other, how many each has): marks behind letters are looked up apart from them."""
        rests = pc.ascii_rtrim(pieces, _MARKS)
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(rests), pc.binary_length(pieces)).to_numpy(zero_copy_only=False))
        if len(marked):
            own = rests.take(pa.array(marked))
            fit = pc.and_(pc.less(pc.binary_length(pieces.take(pa.array(marked))), 64), pc.match_substring_regex(own, _LETTERS))
            marked = marked[fit.to_numpy(zero_copy_only=False)]
        split = np.zeros(len(pieces), dtype=bool)
        split[marked] = True
        marks = pc.utf8_ltrim(pieces.take(pa.array(marked)), "\n" + _ONE_BYTE_LETTERS).dictionary_encode()
        coded = pc.if_else(pa.array(split), rests, pieces).dictionary_encode()
        found = list(map(self.get, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        new = [i for i, ids in enumerate(found) if ids is None]
        if len(self) + len(new) > self.room:
            self.clear()
        if new:
            for i, ids in zip(new, self._learn(coded.dictionary.take(pa.array(new))), strict=True):
                found[i] = ids
        parts = np.full((len(pieces), 2), len(found))  # no marks: the empty one behind the last found
        parts[:, 0] = coded.indices.to_numpy()
        parts[marked, 1] = marks.indices.to_numpy() + len(found) + 1
        found += [b"", *map(self._marks, marks.dictionary.to_pylist())]
        data, sizes = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        ids, _ = _spread(data, np.cumsum(sizes) - sizes, sizes, parts.ravel())
        return ids, sizes[parts].sum(axis=1)

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind is None or _is_whole(text):
            return _pack(self.library.encode(text, add_special_tokens=False).ids)
        pieces = _PIECES[self.kind].findall(text)
        return b"".join([self[" " + piece] for piece in pieces] if self.kind == "bytes" else map(self.__getitem__, pieces))


_known: dict[tuple[int, int], Encoder] = {}


def encoder(definition: str, keep: int = 1_000_000) -> Encoder:
    """The worker's encoder for a tokenizer definition; it lives on from task to task until another operator needs the room."""
    key = zlib.crc32(definition.encode()), keep
    if key not in _known:
        _known[key] = Encoder(definition, keep)
    return sole(_known[key])


def definition(path: str) -> str:
    """The tokenizer file's text, read on the driver and broadcast (1 to 2 MB), so executors need no file."""
    with open(path, encoding="utf-8") as f:
        return f.read()
