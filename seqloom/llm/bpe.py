"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

For each word the tree's leaves hold the rank of the merge of a symbol with its right neighbour, or no rank. The
root names the lowest rank and, of equal ones, the leftmost; merging there changes three leaves at most, so each merge
costs the logarithm of the word's length, whatever that is. Merging ends when the root has no rank.

Of the texts in a slice of a batch, each distinct word is encoded once. The trees of words of like length are rows of
one array, and a step merges the root's pair in each of them; words of more than LONG symbols have a tree each. The
words' tokens are then gathered to those of the texts.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import small_batches
from seqloom.llm.words import give_back, parts, text_bytes

LONG = 64  # symbols; longer words are merged one by one
SLICE = 1 << 20  # bytes of texts that are encoded at once
TREES = 1 << 14  # words that are merged at once
NONE = 1 << 60
#: White space beyond ASCII's, as UTF-8.
SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Letters, numbers and lower-case letters of the library's Unicode versions that older ones lack.
LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class WordBPE:
    """The tokenizer that a tokenizers file describes: NFC, lower case, words, bytes as characters, BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        self.token = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.ranks: list[dict[int, int]] = [{}] * (1 + max(self.vocab.values()))  # by left symbol, then by right
        for rank, (a, b) in enumerate(model["merges"]):
            left = self.vocab[a]
            self.ranks[left] = self.ranks[left] or {}
            self.ranks[left].setdefault(self.vocab[b], rank)
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        self.made_ids = np.array(self.made, np.int64)
        self.words = assigned(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
        self.later = regex.compile("[" + "".join(map(chr, LOWER)) + "]")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.inner = [self.vocab.get(c, -1) for c in byte_alphabet()]
        self.last = [self.vocab.get(c + self.end, -1) for c in byte_alphabet()]
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.pairs = PairRanks([(self.vocab[a], self.vocab[b]) for a, b in model["merges"]])
        n = 1 + max(self.token)
        self.decimal = pa.array([f"{i} " for i in range(n)], pa.large_string())
        self.said = pa.array([self.token.get(i, "") + " " for i in range(n)], pa.large_string())

    def merged(self, symbols: list[int]) -> list[int]:
        """The ids that are left when no adjacent pair has a merge.

        node is the tree: leaf i, at size + i, holds the rank of the pair that begins with symbol i, followed by i in
        the low bits; an inner node holds the lesser of its two children, and node[1] the next merge.
        """
        ranks, made, n = self.ranks, self.made, len(symbols)
        bits = (n - 2).bit_length()
        size = 1 << bits
        node = [NONE] * (2 * size)
        at = size
        for left, right in zip(symbols, symbols[1:], strict=False):
            if (rank := ranks[left].get(right)) is not None:
                node[at] = rank << bits | at - size
            at += 1
        for i in range(size - 1, 0, -1):
            x, y = node[2 * i], node[2 * i + 1]
            node[i] = x if x < y else y
        if node[1] == NONE:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := node[1]) != NONE:
            at = best & (size - 1)
            gone = after[at]
            symbols[at] = made_now = made[best >> bits]
            beyond = after[at] = after[gone]
            changed = [(at, NONE)]
            if beyond < n:
                before[beyond] = at
                changed.append((gone, NONE))
                if (rank := ranks[made_now].get(symbols[beyond])) is not None:
                    changed[0] = (at, rank << bits | at)
            if (first := before[at]) >= 0:
                rank = ranks[symbols[first]].get(made_now)
                changed.append((first, NONE if rank is None else rank << bits | first))
            for i, least in changed:
                i += size
                if node[i] == least:
                    continue
                node[i] = least
                while i > 1:
                    beside = node[i ^ 1]
                    if beside < least:
                        least = beside
                    i >>= 1
                    if node[i] == least:
                        break
                    node[i] = least
        at, out = 0, []
        while at < n:
            out.append(symbols[at])
            at = after[at]
        return out

    def word(self, word: str) -> list[int]:
        """The ids of one pre-token; bytes without an entry in the vocabulary have none."""
        data = word.encode()
        symbols = [i for i in (*(self.inner[b] for b in data[:-1]), self.last[data[-1]]) if i >= 0]
        return self.merged(symbols) if len(symbols) > 1 else symbols

    def pieces(self, text: str) -> list[str]:
        """The words, special tokens and line feeds of a text without other white space."""
        if "<|" in text:
            return [w for part in self.specials.split(text) for w in ([part] if part in self.special else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        """The words and line feeds of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.later.search(text):
                text = text.translate(LOWER)
        return self.words.findall(text.lower())

    def trees(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merged() for words of 2 to LONG symbols at once: (which symbols stay, their ids). symbols: a row for each word, -1 beyond its end.

        node holds a tree in each row, as in merged().
        """
        rows, width = symbols.shape
        bits = (width - 2).bit_length()
        leaves = 1 << bits
        stays = symbols >= 0
        node = np.full((rows, 2 * leaves), NONE, np.int64)
        place = np.arange(width - 1)
        node[:, leaves : leaves + width - 1] = np.where(stays[:, 1:], self.pairs.leaf(symbols[:, :-1], symbols[:, 1:], place, bits), NONE)
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            node[:, a : 2 * a] = np.minimum(node[:, 2 * a : 4 * a : 2], node[:, 2 * a + 1 : 4 * a : 2])
        after, before = np.tile(np.arange(1, width + 2), (rows, 1)), np.tile(np.arange(-1, width), (rows, 1))
        todo = np.flatnonzero(node[:, 1] != NONE)
        while len(todo):
            best = node[todo, 1]
            at, made = best & (leaves - 1), self.made_ids[best >> bits]
            gone = after[todo, at]
            beyond = after[todo, gone]
            symbols[todo, at], stays[todo, gone] = made, False
            after[todo, at], before[todo, beyond] = beyond, at
            inner = beyond < size[todo]
            right = self.pairs.leaf(made, symbols[todo, np.where(inner, beyond, at)], at, bits)
            changed = [(todo, at, np.where(inner, right, NONE)), (todo[inner], gone[inner], np.full(inner.sum(), NONE))]
            first = before[todo, at]
            left = first >= 0
            changed.append((todo[left], first[left], self.pairs.leaf(symbols[todo[left], first[left]], made[left], first[left], bits)))
            for row, i, value in changed:
                i = i + leaves
                node[row, i] = value
                for _ in range(bits):
                    i >>= 1
                    node[row, i] = np.minimum(node[row, 2 * i], node[row, 2 * i + 1])
            todo = todo[node[todo, 1] != NONE]
        return stays, symbols

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, one after the other, index of the first id of each with the end of the last)."""
        data, offsets = text_bytes(words)
        symbols = self.inner_ids[data]
        symbols[offsets[1:] - 1] = self.last_ids[data[offsets[1:] - 1]]  # no word is empty
        known = np.concatenate([[0], np.cumsum(symbols >= 0)])[offsets]
        symbols, size = symbols[symbols >= 0], np.diff(known)
        stays = np.ones(len(symbols), bool)
        low = 1
        while low < LONG:
            own = np.flatnonzero((size > low) & (size <= 2 * low))
            for k in range(0, len(own), TREES):
                some = own[k : k + TREES]
                width = int(size[some].max())
                cell = known[some][:, None] + np.arange(width)
                inside = np.arange(width) < size[some][:, None]
                here = cell[inside]
                grid = np.full(cell.shape, -1, np.int64)
                grid[inside] = symbols[here]
                left, merged = self.trees(grid, size[some])
                symbols[here], stays[here] = merged[inside], left[inside]
            low *= 2
        for i in np.flatnonzero(size > low).tolist():
            got = self.merged(symbols[known[i] : known[i + 1]].tolist())
            symbols[known[i] : known[i] + len(got)] = got
            stays[known[i] + len(got) : known[i + 1]] = False
        ends = np.concatenate([[0], np.cumsum(stays)])[known]
        special = [(i, self.special[w]) for w in self.special for i in np.flatnonzero(pc.equal(words, w)).tolist()]
        ids = symbols[stays]
        for i, own in sorted(special, reverse=True):
            ids = np.concatenate([ids[: ends[i]], [own], ids[ends[i + 1] :]])
            ends[i + 1 :] += 1 - (ends[i + 1] - ends[i])
        return ids, ends

    def ids_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts, one after the other, index of the first id of each with the end of the last)."""
        chunks, which, bounds = split(column)
        if not len(chunks):
            return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
        pieces = pa.array(self.pieces("".join([c + "\n" for c in chunks.to_pylist()])), pa.large_string()).dictionary_encode()
        ids, ends = self.word_ids(pieces.dictionary)
        word, line_feed = np.asarray(pieces.indices), pc.index(pieces.dictionary, "\n").as_py()
        feeds = np.flatnonzero(word == line_feed)
        word, word_ends = np.delete(word, feeds), np.concatenate([[0], feeds - np.arange(len(feeds))])
        of_chunk, chunk_ends = gather(word, word_ends, which)
        every, word_ends = gather(ids, ends, of_chunk)
        return every, word_ends[chunk_ends[bounds]]

    def decode(self, ids: list[int]) -> str:
        """The library's decoding without a decoder: the tokens, joined by a space."""
        return " ".join([self.token[i] for i in ids if i in self.token])

    def encode(self, text: str | None) -> list[int]:
        return self.ids_of(pa.array([text], pa.large_string()))[0].tolist()

    def digests(self, column: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of the decoded text of each text."""
        ids, ends = self.ids_of(column)
        hashed = []
        for words in (self.decimal, self.said):
            data, offsets = text_bytes(words.take(pa.array(ids)))
            view, at = memoryview(data), offsets[ends].tolist()
            hashed.append([hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:], strict=False)])
        return np.diff(ends), *hashed


class PairRanks:
    """The merges' ranks by pair, in an open table that numpy looks up."""

    def __init__(self, merges: list[tuple[int, int]], bits: int = 18):
        while len(merges) > 1 << (bits - 2):
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.code, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        pairs = np.array(merges, np.int64).reshape(-1, 2)
        codes = pairs[:, 0] << 32 | pairs[:, 1]
        left = np.unique(codes, return_index=True)[1]  # the first rank of a pair counts
        at, self.probes = self.slot(codes[left]), 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.rank[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.code[at[put]], self.rank[at[put]] = codes[left[put]], left[put]
            left, at = np.delete(left, put), (np.delete(at, put) + 1) & self.mask

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        """rank << bits | place of the merge of each pair, or NONE."""
        code = left << 32 | right
        at = self.slot(code)
        rank = np.where(self.code[at] == code, self.rank[at], -1)
        for _ in range(self.probes - 1):
            at = (at + 1) & self.mask
            rank = np.where(self.code[at] == code, self.rank[at], rank)
        return np.where(rank >= 0, rank << bits | place, NONE)


def gather(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[ends[i]:ends[i + 1]] for each i of which, one after the other, index of the first of each with the end of the last)."""
    size = (ends[1:] - ends[:-1])[which]
    to = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(to[-1]) + np.repeat(ends[which] - to[:-1], size)], to


def assigned(pattern: str) -> regex.Pattern:
    """The pattern with letters and numbers of the library's Unicode version; regex may know newer ones."""
    known = {c for a, b in [*LETTERS, *NUMBERS] for c in range(a, b + 1)}
    newer = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))) if unicodedata.category(c) == "Cn" and ord(c) not in known]
    if newer:
        runs: list[list[int]] = []
        for c in map(ord, newer):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        without = "--[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]]"
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}{without}")
    return regex.compile(pattern, regex.V1)


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct chunks between white space, the number of each chunk's text among them, index of the first chunk of each text with the end of the last)."""
    data, offsets = text_bytes(column)
    space = (data == 32) | (data >= 9) & (data <= 13)
    if (data >= 0xC2).any():
        for s in SPACES:
            at = np.flatnonzero(data[: len(data) - len(s) + 1] == s[0])
            for k, byte in enumerate(s[1:], 1):
                at = at[data[at + k] == byte]
            for k in range(len(s)):
                space[at + k] = True
    word = ~space
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    place = np.concatenate([[0], np.cumsum(word)])
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(place[starts], place[-1]).astype(np.int64)), pa.py_buffer(data[word]))
    coded = chunks.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), np.searchsorted(starts, offsets)


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself if printable Latin-1, else one from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """One tokenizer for each worker."""
    if path not in LOADED:
        LOADED[path] = WordBPE(path)
    return LOADED[path]


def bpe_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 over the whole text.

    A null text counts as empty and has no tokens. Texts of any length are encoded whole; repeated rows give repeated
    rows; an empty table gives none. path is a tokenizers file that every node can read. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in parts(batches, SLICE):
            n, ids, said = bpe.digests(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return small_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int), decoded (string). Nulls and the rest as in bpe_digests()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in parts(batches, SLICE):
            ids, ends = bpe.ids_of(batch.column(1))
            every = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            said = [bpe.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), every, pa.array(said, pa.string())], ["doc_id", "ids", "decoded"])
        give_back()

    return small_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
