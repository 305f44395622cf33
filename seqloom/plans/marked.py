"""Structured motifs of small alphabets, counted by marks, in Arrow batches.

Where the symbols that occur make few tuples of words, pairs of motifs and sequences are never rows: each sequence marks
the motifs that are near it, one bit for each tuple of words, and the marks of many sequences are added up. What is near
depends on contexts (a box's word, or the symbols that end where it does) and is worked out once for all of them. v needs
only the number of each tuple of contexts. A task yields a row for each motif at most, whatever the number of sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.params import MotifParams
from seqloom.storage import small_batches

LEAST = 1000  # sequences; fewer go by joins
MOTIFS = 1 << 20  # tuples of words at most
CONTEXTS = 1 << 23  # tuples of contexts at most
CELLS = 1 << 24  # in each table of what is near
MARKS = 1 << 22  # bytes of marks that are held at once
SLICE = 1 << 21  # places, with each choice of gaps, that are read at once
WORK = 1 << 34  # bits that a task marks, about


class Grid:
    """Words and contexts as numbers: a box's contexts are padded in front, in base symbols + 1, then ranked."""

    def __init__(self, params: MotifParams, symbols: str) -> None:
        self.params, self.symbols, size = params, symbols, len(symbols)
        self.edit = params.distance == "edit"
        self.lengths = params.lengths
        self.widths = [n + e * self.edit for n, e in zip(self.lengths, params.errors, strict=True)]
        self.first = max(1, params.k - params.e) if self.edit else params.k
        self.words = [size**n for n in self.lengths]
        self.contexts = [sum(size**n for n in range(1 if self.edit else w, w + 1)) for w in self.widths]
        block = self.words[-1]
        self.kind, self.columns = next(((f"<u{b}", 1) for b in (1, 2, 4) if block <= 8 * b), ("<u8", ceil(block / 64)))
        self.prefixes = prod(self.words[:-1])
        self.bits = self.columns * np.dtype(self.kind).itemsize * 8

    def fits(self) -> bool:
        if any((len(self.symbols) + 1) ** w > CELLS for w in self.widths) or prod(self.words) > MOTIFS or prod(self.contexts) > CONTEXTS or any(a * b > CELLS // 4 for a, b in zip(self.words, self.contexts, strict=True)):
            return False
        return prod(self.contexts[:-1]) * prod(min(w, self.most(i)) for i, w in enumerate(self.words[:-1])) <= CELLS

    def most(self, box: int) -> int:
        """The largest number of words near a context, by counting them."""
        return int(self.near(box).sum(axis=1).max(initial=0))

    def digits(self, box: int) -> np.ndarray:
        """A row for each context in the order of ranks, 0 for what it lacks in front."""
        width = self.widths[box]
        held = [np.arange(len(self.symbols) ** n)[:, None] // len(self.symbols) ** np.arange(n)[::-1] % len(self.symbols) + 1 for n in range(1 if self.edit else width, width + 1)]
        return np.concatenate([np.pad(x, ((0, 0), (width - x.shape[1], 0))) for x in held])

    def near(self, box: int) -> np.ndarray:
        """Contexts by words: whether the word is near a suffix of the context."""
        k, e, of = self.lengths[box], self.params.errors[box], self.digits(box)
        word = np.arange(self.words[box])[:, None] // len(self.symbols) ** np.arange(k)[::-1] % len(self.symbols) + 1
        differs = lambda i, j: of[:, None, j] != word[None, :, i]
        shape = (len(of), len(word))
        if not self.edit:
            return sum((differs(i, i).astype(np.int8) for i in range(k)), np.zeros(shape, np.int8)) <= e
        row = [np.zeros(shape, np.int8) for _ in range(of.shape[1] + 1)]
        for i in range(k):  # a suffix may begin anywhere; what is padded matches nothing, so none gains by it
            last, row[0] = row[0], np.full(shape, i + 1, np.int8)
            for j in range(of.shape[1]):
                last, row[j + 1] = row[j + 1], np.minimum(np.minimum(row[j + 1], row[j]) + 1, last + differs(i, j)).astype(np.int8)
        return row[-1] <= e


class Marks:
    """What a task holds: tables of what is near, and sums so far."""

    def __init__(self, grid: Grid) -> None:
        self.grid, size = grid, len(grid.symbols)
        self.base = size + 1
        self.code = np.zeros(128, np.int64)
        self.code[list(grid.symbols.encode("ascii"))] = range(1, size + 1)
        self.near = [grid.near(i) for i in range(len(grid.words))]
        self.rank = []
        for i, w in enumerate(grid.widths):
            rank = np.zeros(self.base**w, np.int32)
            rank[grid.digits(i) @ self.base ** np.arange(w)[::-1]] = range(grid.contexts[i])
            self.rank.append(rank)
        self.table = np.zeros((1, 1), np.int64)
        for near, words in zip(self.near[:-1], grid.words[:-1], strict=True):
            most = int(near.sum(axis=1).max())
            order = np.argsort(~near, axis=1, kind="stable")[:, :most]
            order = np.where(np.take_along_axis(near, order, 1), order, -1)
            both = np.where((self.table[:, None, :, None] < 0) | (order[None, :, None, :] < 0), -1, self.table[:, None, :, None] * words + order[None, :, None, :])
            self.table = both.reshape(len(self.table) * len(order), -1)
        self.table[self.table < 0] = grid.prefixes  # a place that isn't counted
        self.table = self.table.astype(np.int32)
        block = np.packbits(np.pad(self.near[-1], ((0, 0), (0, grid.bits - grid.words[-1]))), axis=1, bitorder="little")
        self.block = block.view(grid.kind)
        self.size = prod(grid.contexts)
        self.found = np.zeros(self.size, np.int64)
        self.u = np.zeros((grid.prefixes + 1) * grid.bits, np.int64)
        self.rows = max(1, MARKS // ((grid.prefixes + 1) * grid.bits // 8))
        self.cut = max(1, SLICE // len(grid.params.structures))

    def add(self, texts: list[str], times: list[int]) -> None:
        times, cut = np.array(times, np.int64), self.cut
        if len(texts) > 1 or len(texts[0]) <= cut:
            keys, counts = self.tuples(texts, 0)
        else:  # in pieces, each with what it needs of its neighbours
            before, after, (text,) = max(self.grid.widths), sum(b.gap_max + b.length for b in self.grid.params.boxes), texts
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i in range(0, len(text), cut):
                lead = min(i, before)
                more, n = self.tuples([text[i - lead : i + cut + after]], lead, lead + cut)
                keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        row, tuples = keys // self.size, keys % self.size
        np.add.at(self.found, tuples, counts * times[row])
        self.mark(row, tuples, times)

    def tuples(self, texts: list[str], first: int, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct row * size + tuple of contexts, and how often each is, of box 0's ends from first on up to last."""
        grid, pad = self.grid, max(self.grid.widths) - 1
        lengths = np.array([len(t) for t in texts])
        row = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(row)) + pad * (row + 1)
        coded = np.zeros(len(row) + pad * len(texts), np.int64)
        coded[at] = self.code[np.frombuffer("".join(texts).encode("ascii"), np.uint8)]
        place = np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
        room = lengths[row] - 1 - place
        ranks = []
        for rank, w in zip(self.rank, grid.widths, strict=True):
            context = np.zeros(len(coded), np.int64)
            for j in range(w):
                context[j:] += coded[: len(coded) - j] * self.base**j
            ranks.append(rank[context])
        keys = []
        for gaps in grid.params.structures:
            shifts = [0, *accumulate(g + n for g, n in zip(gaps, grid.lengths[1:], strict=True))]
            use = (place >= max(first, grid.first - 1)) & (room >= shifts[-1])
            if last is not None:
                use &= place < last
            end, key = at[use], row[use].astype(np.int64)
            for rank, shift, n in zip(ranks, shifts, grid.contexts, strict=True):
                key = key * n + rank[end + shift]
            keys.append(key)
        return np.unique(np.concatenate(keys), return_counts=True)

    def mark(self, row: np.ndarray, tuples: np.ndarray, times: np.ndarray) -> None:
        """Rows ascend. In each turn a sequence has one tuple at most, so no mark is lost to another."""
        grid = self.grid
        marks = np.zeros((len(times) * (grid.prefixes + 1), grid.columns), grid.kind)
        flat = marks[:, 0] if grid.columns == 1 else marks
        new = np.flatnonzero(np.diff(row, prepend=-1))
        turn = np.arange(len(row)) - np.repeat(new, np.diff(new, append=len(row)))
        order = np.argsort(turn, kind="stable")
        begun = np.searchsorted(turn[order], np.arange(turn.max(initial=-1) + 2))
        left, right, place = tuples[order] // grid.contexts[-1], tuples[order] % grid.contexts[-1], row[order] * (grid.prefixes + 1)
        for a, b in zip(begun, begun[1:], strict=False):
            where = self.table[left[a:b]] + place[a:b, None]
            block = self.block[right[a:b]]
            flat[where] |= block if grid.columns == 1 else block[:, None, :]
        marks = marks.view(np.uint8).reshape(len(times), -1)
        for t in np.unique(times):
            own = np.flatnonzero(times == t)
            for i in range(0, len(own), 255):
                self.u += int(t) * np.add.reduce(np.unpackbits(marks[own[i : i + 255]], axis=1, bitorder="little"), axis=0, dtype=np.uint8).astype(np.int64)

    def result(self) -> Iterator[pa.RecordBatch]:
        grid = self.grid
        seen = np.zeros(prod(grid.words), bool)
        found, at = np.flatnonzero(self.found), 0
        whole = np.ones(len(found), bool)  # contexts that have all symbols of their boxes' words
        for i, (place, n) in enumerate(zip(np.unravel_index(found, grid.contexts), grid.lengths, strict=True)):
            own = grid.digits(i)[:, -n:]
            whole &= (own > 0).all(axis=1)[place]
            at = at * grid.words[i] + (np.maximum(own - 1, 0) @ len(grid.symbols) ** np.arange(n)[::-1])[place]
        seen[at[whole]] = True
        v = self.found.astype(np.float64).reshape(grid.contexts)
        for near in self.near:  # each turn sums up the first axis and puts the words last
            v = np.tensordot(v, near.astype(np.float64), axes=(0, 0))
        u = self.u.reshape(-1, grid.bits)[: grid.prefixes, : grid.words[-1]].ravel()
        v, some = v.ravel(), np.flatnonzero(u)
        for i in range(0, len(some), 1 << 16):
            m = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(u[m], pa.int64()), pa.array(np.rint(v[m]).astype(np.int64), pa.int64()), pa.array(seen[m])], ["motif", "u", "v", "seen"])


def applies(params: MotifParams) -> bool:
    """Whether few symbols, if few are found, can make few tuples."""
    symbols = params.symbols
    return bool(params.boxes) and len(symbols) <= 128 and symbols.isascii() and len(set(symbols)) == len(symbols) and 2 ** sum(params.lengths) <= MOTIFS


def count_marked(texts: DataFrame, number: int, grid: Grid) -> DataFrame:
    """b0, b1, ..., u, v of all tuples that occur in texts (seq, times), which are so many and have the grid's symbols only."""
    params = grid.params

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, times, symbols = Marks(grid), [], [], 0
        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and (len(texts) >= held.rows or symbols + len(text) > held.cut):
                    held.add(texts, times)
                    texts, times, symbols = [], [], 0
                texts.append(text)
                times.append(n)
                symbols += len(text)
        if texts:
            held.add(texts, times)
        yield from held.result()

    parts = max(texts.sparkSession.sparkContext.defaultParallelism, ceil(number * grid.prefixes * grid.bits / WORK))
    long = small_batches(texts).filter(F.length("seq") >= params.total_length).select("seq", "times").repartition(parts)
    counts = long.mapInArrow(step, "motif long, u long, v long, seen boolean").groupBy("motif").agg(F.sum("u").alias("u"), F.sum("v").alias("v"), F.bool_or("seen").alias("seen")).filter("seen")
    below, columns = prod(grid.words), []
    for i, n in enumerate(grid.lengths):
        below //= grid.words[i]
        columns.append(word((F.col("motif") / below).cast("long") if below > 1 else F.col("motif"), n, grid.symbols).alias(f"b{i}"))
    return counts.select(*columns, "u", "v")


def word(number: Column, length: int, symbols: str) -> Column:
    """The word of a number's last so many digits."""
    digit = lambda j: F.floor(number / len(symbols) ** j) % len(symbols)
    return F.concat(*(F.substring(F.lit(symbols), digit(j).cast("int") + 1, F.lit(1)) for j in range(length)[::-1]))
