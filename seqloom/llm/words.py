"""Words of whole Arrow batches as 64-bit hashes, computed with numpy on the UTF-8 bytes.

A word's hash is a polynomial in its bytes, each first mapped through a table of random numbers, and then mixed. It
doesn't depend on where the word stands or on the batch. Batches are worked through in pieces of PIECE bytes that end
between words, so memory doesn't grow with a text's length beyond the text and its words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
SLICE = 1 << 22  # bytes of texts that an operator works on at once
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def byte_table() -> np.ndarray:
    """A random odd number for each byte, the same for A-Z as for a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | np.uint64(1)
    table[65:91] = table[97:123]
    return table


@lru_cache(4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def white_space() -> np.ndarray:
    """Separators of the words [^\\x20\\x09-\\x0D]+."""
    out = np.zeros(256, bool)
    out[[32, *range(9, 14)]] = True
    return out


def not_alphanumeric() -> np.ndarray:
    """Separators of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased."""
    out = np.zeros(256, bool)
    out[:128] = True
    out[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return out


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of characters that are words of their own, as their scripts don't separate words: Thai, Lao, Burmese, Khmer, kana and Chinese characters."""
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 2 < len(data)]
    lead, second = data[at], data[at + 1]
    own = (lead >= 0xE4) & (lead <= 0xE9) | (lead == 0xE3) & (second >= 0x81) | (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
    own |= (lead == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second == 0x9E) | (second == 0x9F)) | (lead == 0xF0) & (second >= 0xA0) & (second <= 0xB2)
    at = at[own]
    return at, np.minimum(at + 3 + (data[at] == 0xF0), len(data))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column's texts, and where each begins, with the end of the last; null is empty."""
    column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, edges: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; one ends at each of the edges at the latest."""
    word = ~sep[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def apart(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words cut where one of first..last begins and ends."""
    begin = np.unique(np.concatenate([starts, first, last]))
    within = np.searchsorted(starts, begin, "right") - 1
    begin, within = begin[within >= 0], within[within >= 0]
    inside = begin < ends[within]
    begin, within = begin[inside], within[inside]
    return begin, np.minimum(ends[within], np.append(begin[1:], np.iinfo(np.int64).max))


def batch_words(column: pa.Array, sep: np.ndarray, alone: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, the words' start bytes, index of the first word of each text with the end of the last).

    alone gives starts and ends of what is a word of its own, apart from what is next to it.
    """
    data, offsets = text_bytes(column)
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            edge = offsets[np.searchsorted(offsets, end, "right") - 1]
            if edge > at:
                end = int(edge)
            else:
                stop = int(offsets[np.searchsorted(offsets, end, "right")])
                while end < stop and not sep[data[end]]:
                    end += 1
        part = data[at:end]
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        starts, ends = word_spans(part, edges, sep)
        if alone and len((own := alone(part))[0]):
            starts, ends = apart(starts, ends, *own)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte_table()[part] * powers(PIECE if len(part) <= PIECE else len(part), int(BASE))[: len(part)], out=total[1:])
        back = powers(PIECE if len(part) <= PIECE else len(part), int(INVERSE))
        hashes.append(mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64)))
        begins.append(starts + at)
        at = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return words, starts, np.searchsorted(starts, offsets)


def word_hash(word: str) -> int:
    """The hash that batch_words() gives a word."""
    return int(batch_words(pa.array([word]), np.zeros(256, bool))[0][0])


def phrase_places(words: np.ndarray, bounds: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Indices of words at which the phrase stands within one text."""
    n = len(phrase)
    if len(words) < n:
        return np.zeros(0, np.int64)
    hit = np.ones(len(words) - n + 1, bool)
    for k, h in enumerate(phrase):
        hit &= words[k : len(words) - n + 1 + k] == np.uint64(h)
    at = np.flatnonzero(hit)
    return at[np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, at + n - 1, "right")]


def parts(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about size bytes, so that what is computed for one stays small; then gives unused memory back."""
    for batch in batches:
        rows = max(1, int(size * batch.num_rows / max(1, batch.nbytes)))
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits would else keep what its last task needed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces_of(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of texts, from first to before last, of about limit bytes."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last
