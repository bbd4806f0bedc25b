"""Words of many texts as Arrow and numpy arrays, without one Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes at a time; a longer text is taken alone.
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of stretches of texts of about ``most`` bytes, in order."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, before + most, side="right")))
        yield begin, end
        begin = end


def _table(of: Callable[[int], bool]) -> np.ndarray:
    return np.array([of(b) for b in range(256)])


_SOLID = _table(lambda b: not (b == 32 or 9 <= b <= 13))
_LETTER = _table(lambda b: 65 <= b <= 90 or 97 <= b <= 122)


def not_white(data: np.ndarray) -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    return _SOLID[data]


def latin_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of words ``[A-Za-z\\u00C0-\\u00FF]+``: U+00C0 to U+00FF are the characters with the first byte C3."""
    first = data == 0xC3
    out = _LETTER[data] | first
    out[1:] |= first[:-1]
    return out


def split(texts: pa.Array, inside: Callable[[np.ndarray], np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts in order, where each text's words begin and the end); a null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(texts) else np.zeros(0, np.uint8)
    data, at = data[at[0] : at[-1]], at - at[0]
    mask = inside(data)
    first, last = mask.copy(), mask.copy()
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word ends where its text ends
    joined = np.ones(max(len(data) - 1, 0), dtype=bool)
    joined[cut - 1] = False
    first[1:] &= ~(mask[:-1] & joined)
    last[:-1] &= ~(mask[1:] & joined)
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.zeros(len(begin) + 1, dtype=np.int32)
    np.cumsum(end - begin, out=ends[1:])
    words = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[mask])])
    return words, np.searchsorted(begin, at)
