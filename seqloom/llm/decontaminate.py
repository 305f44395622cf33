"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words (letters and digits, A-Z lower-cased; in scripts without spaces every character is a word).
An item of m words is in a document if some stretch of it is within allowed(m) word edits of the item: EDITS * m, rounded
down, one at least from ONE_EDIT words on, none in shorter items.

1. Windows: every word begins a window of each item's size. A window that is near an item keeps most of the item's
   word pairs, so windows with fewer of an item's pairs than edits can leave are no candidates; that loses none.
2. The CGK walk embeds a window: at each step it takes the word it stands on and moves on or stays, as a random bit for
   step and word says. Sequences at a small edit distance walk into step with each other, so their embeddings are at a
   small Hamming distance. After several edits a walk is mostly out of step, so each window has walks from several
   anchors, one more than edits are allowed: near at least one of them there is no edit.
3. Each of a number of repetitions draws a walk and SAMPLED of its steps; windows and items whose words agree at those
   from some anchor are candidates. The number is measured for each item size: the least that finds RECALL of edited
   items, whether edits are spread, clustered, inserted, deleted or changed. An unchanged copy always agrees.
4. The stretch around each candidate is aligned with the item, bit-parallel over the item's words. Only what is near
   enough is aligned once more to find where it begins.

The benchmark is the stated query set: it goes to all documents in blocks of BLOCK items, so each broadcast is bounded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import materialise, rows_with, small_batches
from seqloom.llm.words import batch_words, mix, not_alphanumeric, parts, unspaced

EDITS = 0.1
ONE_EDIT = 6  # words from which an item may have one edit
RECALL = 0.995  # of edited items of the worst kind that is measured
SAMPLED = 3
REACH = 1.5  # steps of a walk that are sampled from, by the words from one anchor to the next
COMMON = 32
BLOCK = 20_000
SCHEMA = "doc_id long, item_id long, distance int, first_word long"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text with the end of the last)."""
    words, _, bounds = batch_words(column, not_alphanumeric(), unspaced)
    return words, bounds


def allowed(m: int, edits: float) -> int:
    return max(int(edits * m), int(m >= ONE_EDIT))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)


def steps_of(m: int, k: int) -> int:
    """Steps of a walk from an anchor that are sampled from. A walk moves by one word at most, so it stays in the window."""
    return min(m, int(np.ceil(REACH * m / (k + 1))))


def anchors(m: int, k: int) -> list[int]:
    """Where an item's walks begin: evenly, but so that the sampled steps end within the item."""
    return sorted({min(i * m // (k + 1), m - steps_of(m, k)) for i in range(k + 1)})


def walk_keys(words: np.ndarray, at: np.ndarray, repetition: int, steps: int) -> np.ndarray:
    """A hash of the sampled steps of the CGK walks that begin at these places."""
    r = np.random.default_rng([repetition, steps])
    salt = r.integers(1, 1 << 63, steps, np.uint64) * np.uint64(2) + np.uint64(1)
    chosen = np.sort(r.choice(steps, min(SAMPLED, steps), replace=False))
    padded = np.concatenate([words, np.zeros(steps, np.uint64)])
    at, key = at.copy(), np.zeros(len(at), np.uint64)
    for j in range(int(chosen[-1]) + 1):
        word = padded[at]
        if j in chosen:
            key = mix(key + word * salt[j])
        at += ((word * salt[j]) >> np.uint64(63)).astype(np.int64)
    return key


def edited_copies(m: int, k: int, trials: int) -> Iterator[list[int]]:
    """Copies of the item 1..m with k edits, by kinds and by the part of the item that has them."""
    r = np.random.default_rng([m, k])
    for kind in ("delete", "insert", "change"):
        for share in (0.0, 1.0, 0.5, 0.2):
            for _ in range(trials):
                if share:
                    places = r.choice(max(k, int(share * m)), k, replace=False)
                else:  # as even as can be
                    places = (np.arange(k) * m + r.integers(m)) // k % m
                copy = list(range(1, m + 1))
                for at in sorted(map(int, places), reverse=True):
                    copy[at : at + (kind != "insert")] = [] if kind == "delete" else [int(r.integers(m + 1, 1 << 40))]
                yield copy


@lru_cache(4096)
def repetitions(m: int, k: int, recall: float = RECALL, trials: int = 16) -> int:
    """The least number of repetitions that finds this share of edited items of m words, k of them edited, of the worst kind."""
    if not k:
        return 1
    item = mix(np.arange(1, m + 1, dtype=np.uint64))
    copies = list(edited_copies(m, k, trials))
    own, steps, hits, tried = np.array(anchors(m, k)), steps_of(m, k), np.zeros(len(copies)), 0
    between = [0] * steps  # no walk goes from one copy to the next
    words = mix(np.array([w for c in copies for w in [*c, *between]], np.uint64))
    of, at = (np.concatenate(x) for x in zip(*((np.full(len(c), i), np.arange(len(c))) for i, c in enumerate(copies)), strict=True))
    at += np.concatenate([[0], np.cumsum([len(c) + steps for c in copies])])[of]
    while tried < 512:
        for tried in range(tried + 1, tried + 33):
            same = np.isin(walk_keys(words, at, tried, steps), walk_keys(item, own, tried, steps))
            hits += np.bincount(of[same], minlength=len(copies)) > 0
        miss = 1 - (hits + 0.5) / (tried + 1)
        for n in range(1, 2 * tried):
            if (miss**n).reshape(-1, trials).mean(1).max() <= 1 - recall:
                return n
    return 2 * tried


def aligned(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """(least word edits between the item and a part of the stretch, where the part begins): the first such part to end."""
    n = len(stretch)
    cost, start = [0] * (n + 1), list(range(n + 1))
    for i, word in enumerate(item.tolist(), 1):
        before_cost, before_start, cost[0], start[0] = cost[0], start[0], i, 0
        for j, other in enumerate(stretch.tolist(), 1):
            best, origin = before_cost + (word != other), before_start
            if cost[j] + 1 < best:
                best, origin = cost[j] + 1, start[j]
            if cost[j - 1] + 1 < best:
                best, origin = cost[j - 1] + 1, start[j - 1]
            before_cost, before_start = cost[j], start[j]
            cost[j], start[j] = best, origin
    j = min(range(n + 1), key=cost.__getitem__)
    return cost[j], start[j]


def nearest_end(mask: dict[int, int], m: int, stretch: list[int]) -> tuple[int, int]:
    """(least word edits between the item and a part of the stretch, where the first such part ends), a column of the alignment at a time in the bits of an integer."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, cost, best, end = full, 0, m, m, 0
    for j, word in enumerate(stretch, 1):
        same = mask.get(word, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        if more & top:
            cost += 1
        elif less & top:
            cost -= 1
            if cost < best:
                best, end = cost, j
                if not cost:
                    break
        more, less = (more << 1) & full, (less << 1) & full
        up, down = less | (full & ~(level | more)), more & level
    return best, end


def slices(doc: np.ndarray, total: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of entries, from a to before b, that end with a text and expand to about limit entries."""
    a = 0
    while a < len(doc):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + limit, "right")))
        b = int(np.searchsorted(doc, doc[b - 1], "right"))
        yield a, b
        a = b


def with_item(key: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(key + item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Index:
    """A block of items: their word pairs, and the keys of their walks by number of steps and repetition."""

    def __init__(self, items: list[tuple[int, str]], edits: float):
        words, bounds = tokens(pa.array([t for _, t in items], pa.large_string()))
        self.words = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.ids, self.edits = [i for i, _ in items], edits
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.errors = np.array([allowed(m, edits) for m in self.size.tolist()], np.int64)
        self.set_pairs()
        self.set_walks()
        self.masks: dict[int, dict[int, int]] = {}

    def set_pairs(self) -> None:
        """Word pairs with the items that count them, and how many of an item's a near window has at least.

        A window d edits from the item keeps all but 2d of the item's pairs. Pairs of more than COMMON items don't count
        for an item that can do without them.
        """
        used = np.flatnonzero(self.size > 0)
        own = [pair_hashes(self.words[k]) if self.size[k] > 1 else mix(self.words[k] + np.uint64(1)) for k in used]
        values, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_inverse=True)
        item = np.repeat(used, [len(x) for x in own])
        in_items = np.bincount(np.unique(np.stack([of, item], 1), axis=0)[:, 0], minlength=len(values)) if len(of) else np.zeros(0, np.int64)
        spare = self.spare = 4 * self.errors
        rare = in_items[of] <= COMMON
        n_rare = np.bincount(item[rare], minlength=len(self.words))
        n_all = np.bincount(item, minlength=len(self.words))
        counts = rare | (n_rare - spare < 2)[item]
        self.least = np.maximum(1, np.where(n_rare - spare < 2, n_all, n_rare) - spare)
        entries = np.unique(np.stack([of[counts], item[counts]], 1), axis=0) if counts.any() else np.zeros((0, 2), np.int64)
        kept, first = np.unique(entries[:, 0], return_index=True)
        self.pairs, self.pair_items, self.pair_first = values[kept], entries[:, 1], np.append(first, len(entries))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.pairs & np.uint64((1 << 20) - 1)] = True
        self.singles = bool((self.size == 1).any())

    def set_walks(self) -> None:
        """Steps of each item's walks; for each number of steps and repetition, the keys of the items' walks with the item, sorted."""
        self.steps = np.array([steps_of(m, k) for m, k in zip(self.size.tolist(), self.errors.tolist(), strict=True)], np.int64)
        self.keys: dict[int, list[np.ndarray]] = {}
        for steps in np.unique(self.steps[self.size > 0]).tolist():
            own = np.flatnonzero((self.steps == steps) & (self.size > 0))
            least = max(repetitions(m, k) for m, k in {*zip(self.size[own].tolist(), self.errors[own].tolist(), strict=True)})
            starts = [anchors(int(self.size[i]), int(self.errors[i])) for i in own]
            of = np.repeat(own, [len(x) for x in starts])
            begin = np.cumsum(self.size[own]) - self.size[own]
            at = np.concatenate([np.array(x, np.int64) + b for x, b in zip(starts, begin, strict=True)])
            words = np.concatenate([self.words[i] for i in own])
            self.keys[steps] = [np.unique(with_item(walk_keys(words, at, r, steps), of)) for r in range(least)]

    def candidates(self, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether, in some repetition, a walk in words low..high-1 agrees with one of the item's."""
        found = np.zeros(len(item), bool)
        for steps, keys in self.keys.items():
            left = np.flatnonzero(self.steps[item] == steps)
            for r, known in enumerate(keys):
                if not len(left):
                    break
                n = high[left] - low[left]
                begin = np.cumsum(n) - n
                at = np.arange(n.sum()) + np.repeat(low[left] - begin, n)
                key = with_item(walk_keys(words, at, r, steps), np.repeat(item[left], n))
                same = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                hit = np.logical_or.reduceat(same, begin)
                found[left[hit]] = True
                left = left[~hit]
        return found

    def stretches(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, first word, end) of what lies around windows that keep enough of the item's pairs, in order, overlapping ones as one."""
        h = np.append(pair_hashes(words), np.uint64(0))
        at = np.flatnonzero(self.maybe[h & np.uint64((1 << 20) - 1)])
        if not len(self.pairs) or not len(at) and not self.singles:
            return
        which = np.minimum(np.searchsorted(self.pairs, h[at]), len(self.pairs) - 1)
        doc = np.searchsorted(bounds, at, "right") - 1
        ok = (self.pairs[which] == h[at]) & (at + 1 < bounds[doc + 1])
        at, which, doc = at[ok], which[ok], doc[ok]
        if self.singles:  # items of one word have that word instead of pairs
            alone = mix(words + np.uint64(1))
            spot = np.flatnonzero(np.isin(alone, self.pairs))
            at = np.concatenate([at, spot])
            which = np.concatenate([which, np.searchsorted(self.pairs, alone[spot])])
            doc = np.concatenate([doc, np.searchsorted(bounds, spot, "right") - 1])
            order = np.argsort(doc, kind="stable")
            at, which, doc = at[order], which[order], doc[order]
        each = self.pair_first[which + 1] - self.pair_first[which]
        for a, b in slices(doc, np.cumsum(each)):
            n = each[a:b]
            back = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = self.pair_items[np.repeat(self.pair_first[which[a:b]], n) + back]
            pos, of = np.repeat(at[a:b], n), np.repeat(doc[a:b], n)
            order = np.lexsort((pos, item, of))
            item, pos, of = item[order], pos[order], of[order]
            place = (of * len(self.words) + item) * (len(words) + 1) + pos
            many = np.searchsorted(place, place + np.minimum(np.maximum(self.size[item] - 1, 1), len(words) - pos)) - np.arange(len(place)) >= self.least[item]
            item, pos, of = item[many], pos[many], of[many]
            if not len(item):
                continue
            # The pairs that count may all stand late in the item, so a near stretch may begin its whole length before.
            reach = self.size[item] + self.errors[item]
            low, high = np.maximum(bounds[of], pos - reach), np.minimum(bounds[of + 1], pos + reach)
            first = np.append(True, (of[1:] != of[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1]))
            last = np.append(first[1:], True)
            yield of[first], item[first], low[first], high[last]

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, first word) for each text and item in it."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        near = (zip(*(x[self.candidates(words, *some[1:])].tolist() for x in some), strict=True) for some in self.stretches(words, bounds))
        for d, item, low, high in (x for some in near for x in some):
            m, k = len(self.words[item]), int(self.errors[item])
            if best.get((d, item), (k + 1,))[0] == 0:
                continue
            cost, end = nearest_end(self.mask(item), m, words[low:high].tolist())
            if cost < best.get((d, item), (k + 1,))[0]:
                begin = max(low, low + end - m - cost)
                start = low + end - m if cost == 0 else begin + aligned(self.words[item], words[begin : low + end])[1]
                best[d, item] = cost, start - int(bounds[d])
        return [(d, item, *found) for (d, item), found in sorted(best.items())]

    def mask(self, item: int) -> dict[int, int]:
        """The places of each of the item's words, as bits."""
        if item not in self.masks:
            made = self.masks[item] = defaultdict(int)
            for i, word in enumerate(self.words[item].tolist()):
                made[word] |= 1 << i
        return self.masks[item]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs and item in it: doc_id, item_id, distance, first_word (from 0), over whole texts.

    distance is the least number of word edits, at most allowed(m, edits); first_word is where the first part with it
    begins. Items of any length are searched: one of a few words is in every document that says them. Items without a
    word and null ones are in no document. Null and empty texts have no rows, as have clean documents; repeated
    documents give repeated rows; an empty benchmark or table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-items.count() // block))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def search(b: int) -> DataFrame:
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).distinct().collect()
        ship = spark.sparkContext.broadcast(Index(sorted(((r.id, r.text) for r in own), key=lambda x: (x[0] is None, x)), edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ship.value
            for batch in parts(batches):
                words, bounds = tokens(batch.column(1))
                got = index.hits(words, bounds) if len(words) else []
                ids = batch.column(0).to_pylist()
                columns = [[ids[d] for d, *_ in got], [index.ids[i] for _, i, *_ in got], [x[2] for x in got], [x[3] for x in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "first_word"])

        return small_batches(rows).mapInArrow(run, SCHEMA)

    found = search(0)
    for b in range(1, blocks):
        found = found.union(search(b))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without an item in them, all columns as they are. Rows without doc_id stay."""
    leaks = find_leaks(docs, benchmark, text, doc_id).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(doc_id)).distinct()
    return rows_with(docs, materialise(leaks, "leaks"), "left_anti", doc_id)
