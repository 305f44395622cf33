"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups are the rows with equal texts, ordered by a hash of the text. The smallest capacity for which a greedy walk
needs no more shards than there are is found by binary search; the cuts fall there.

A group larger than an even share sets the capacity, and walks up to it would fill few shards and leave others empty.
Such groups then get a shard of their own where that keeps the capacity, and the runs between them are cut in the same
way, each into a number of shards that is found at the resolution below.

The walk needs the group sizes only near the cuts. So the order is read at a resolution: one pass sums the sizes of
2^16 equal ranges of the hash. From these, the search bounds the capacity and, for each cut, the ranges in
which it can fall; further passes split only those ranges, until each holds a single group. The capacity is then
exactly the smallest for the groups themselves. Each pass returns a bounded number of sums, whatever the input.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.shared import materialise, whole_text

FIRST_BITS, ZOOM_BITS = 16, 8  # of the hash, that the first pass and each further one resolve
CELLS = 1024  # of a shard, for numbering its rows
ROW_BYTES = 8


def walk(sums: list[int], capacity: int) -> list[int]:
    """The atoms that begin a new shard when each shard takes atoms as long as it stays within capacity."""
    cuts, load = [], 0
    for i, size in enumerate(sums):
        if load + size > capacity and load:
            cuts.append(i)
            load = 0
        load += size
    return cuts


def smallest_capacity(sums: list[int], shards: int, low: int | None = None) -> int:
    """The least capacity, at least low, for which walk() needs no more than shards."""
    low = max([-(-sum(sums) // shards), *sums, low or 0])
    high = max(sum(sums), low)
    while low < high:
        middle = (low + high) // 2
        if len(walk(sums, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def spread(sums: list[int], large: list[int], shards: int, capacity: int) -> list[tuple[int, int, int]]:
    """(first atom, end, shards) of runs that are cut by themselves: some of the large groups alone, and what lies between.

    The largest ones come first. Of the numbers of them that keep every shard within capacity, the one whose shards are
    nearest to equal is taken; without any, all atoms are one run.
    """
    loads = lambda cuts: [sum(sums[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sums)], strict=True)]
    least, best = sum(x * x for x in loads(walk(sums, capacity))), [(0, len(sums), shards)]
    by_size = sorted(large, key=lambda i: -sums[i])
    for n in range(1, len(large) + 1):
        alone = sorted(by_size[:n])
        runs = [(a, b) for a, b in zip([0, *(i + 1 for i in alone)], [*alone, len(sums)], strict=True) if a < b]
        left = shards - n
        if left < len(runs):
            break
        needed = lambda c: [len(walk(sums[a:b], c)) + 1 for a, b in runs]  # noqa: E731, B023
        low, high = max((max(sums[a:b]) for a, b in runs), default=0), capacity
        if sum(needed(high)) > left:
            continue
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if sum(needed(middle)) <= left else (middle + 1, high)
        each, size = needed(low), [sum(sums[a:b]) for a, b in runs]
        for _ in range(left - sum(each) if runs else 0):
            each[max(range(len(runs)), key=lambda r: size[r] / each[r])] += 1  # noqa: B023
        score = sum(sums[i] ** 2 for i in alone) + sum(x * x / k for x, k in zip(size, each, strict=True))
        if score < least:
            least, best = score, sorted([(i, i + 1, 1) for i in alone] + [(a, b, k) for (a, b), k in zip(runs, each, strict=True)])
    return best


def open_atoms(atoms: list[tuple[int, int, int, bool]], shards: int) -> list[int]:
    """Atoms of several groups in which a cut of the best partition may fall.

    An atom is (first hash, last hash, size, holds one group). The best capacity lies between an even share, or the
    largest single group, and what the atoms reach when none is split. A walk that may split atoms anywhere and has
    the highest capacity is never behind the best one; a walk that stays a whole atom short at each cut and has the
    lowest is never ahead of it.
    """
    sums, ends = [a[2] for a in atoms], []
    total = 0
    for s in sums:
        total += s
        ends.append(total)
    high = smallest_capacity(sums, shards)
    low = max([-(-total // shards), *(a[2] for a in atoms if a[3])])
    found: set[int] = set()
    early = late = 0
    for _ in range(shards - 1):
        late = min(total, late + high)
        k = bisect_right(ends, early + low)
        early = ends[k - 1] if k else 0
        found.update(i for i in range(min(k, len(atoms)), min(bisect_right(ends, late - 1) + 1, len(atoms))) if not atoms[i][3])
    return sorted(found)


def cuts_of(rows: DataFrame, shards: int) -> list[int]:
    """The hashes at which shards 1, 2, ... begin. rows: h, size."""
    atoms: list[tuple[int, int, int, bool]] = []
    spans, bits = [(-(2**63), 2**63 - 1)], 64
    while spans and bits:
        above, bits = bits, bits - (FIRST_BITS if bits == 64 else ZOOM_BITS)
        part = F.shiftright("h", bits)
        new = (rows if above == 64 else rows.filter(F.shiftright("h", above).isin([a >> above for a, _ in spans]))).groupBy(part.alias("part")).agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("size").alias("size"))
        atoms = sorted([x for x in atoms if (x[0], x[1]) not in set(spans)] + [(r.a, r.b, r.size, r.a == r.b) for r in new.collect()])
        if not atoms:
            return []
        share = -(-sum(x[2] for x in atoms) // shards)
        spans = [atoms[i][:2] for i in sorted({*open_atoms(atoms, shards), *(i for i, x in enumerate(atoms) if x[2] > share and not x[3])})]
    sums = [a[2] for a in atoms]
    capacity = smallest_capacity(sums, shards)
    runs = spread(sums, [i for i, x in enumerate(atoms) if x[2] > share and x[3]], shards, capacity)
    if len(runs) == 1:
        return [atoms[i][0] for i in walk(sums, capacity)]
    cuts = []
    for a, b, n in runs:
        first, last = atoms[a][0], atoms[b - 1][1]
        cuts += [first] + (cuts_of(rows.filter(F.col("h").between(first, last)), n) if n > 1 else [])
    return cuts[1:]


def shard_of(h: Column, cuts: list[int]) -> Column:
    """The number of cuts at or before the hash."""
    found: Column = F.lit(0)
    for i, cut in enumerate(cuts, 1):
        found = F.when(h >= cut, F.lit(i)).otherwise(found)
    return found


def assign_shards(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Sizes of shards in bytes are as near equal as a contiguous partition of whole groups can make them: the largest is
    the smallest possible. A row's size is its text's UTF-8 bytes plus row_bytes. Equal texts share a shard; null and
    empty texts are one group. Slots count from 0 without gaps in each shard, in the order of a hash of the row.
    Repeated rows and null doc_ids take slots of their own. An empty table gives no rows; with fewer groups than shards
    the last shards stay empty. Other columns are not read.
    """
    body = whole_text(text)
    rows = materialise(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.octet_length(body).cast("long") + row_bytes).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("h"),
            F.monotonically_increasing_id().alias("tag"),
        ),
        "sizes",
    )
    cut = rows.withColumn("shard", shard_of(F.col("h"), cuts_of(rows, shards)).cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(CELLS)))
    counts = cut.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.withColumn("start", F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n")
    place = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "tag")) - 1
    return (
        cut.withColumn("place", place)
        .join(before, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
