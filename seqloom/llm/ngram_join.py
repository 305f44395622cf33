"""N-gram Jaccard join: a grouped prefix join on the sets of word shingles, and its connected components.

Shingles are 64-bit hashes in one global order: those that many documents have come last, then by hash. Two sets with a
similarity of at least the threshold share a shingle within the prefixes of that order.

1. Equal sets collapse to the smallest doc_id; sets with equal prefixes and sizes collapse to groups of about GROUP,
   whose leader is the smallest doc_id in it.
2. Leaders are dealt out by prefix shingle, frequent ones over several parts. Each bucket yields the pairs of groups
   that the bounds on sizes and positions allow. A bucket of more than BUCKET groups yields a star (all with a few
   leaders) and neighbours only.
3. Pairs of groups expand to pairs of members. Those that a bound on their difference (a map of parities) can't rule
   out are compared by their whole sets: first one of each member, then those that its link doesn't make needless.
4. Links give components. The members of large buckets are then compared across components in rounds: buckets with one
   first document make one cluster, a cluster is cut into cells of bounded size, and each cell yields for every member
   outside the cluster's main component its nearest few of other components. Verified links join components; the next
   round takes more cells and more of the nearest, until nothing is left out. So no link between components is lost,
   and rows stay in proportion to members as long as the links found close the cluster.

Which shingles count as frequent decides only the order, not the result; at most FREQUENT of them are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.components import components, replaced
from seqloom.llm.shared import bounded, discard, materialise, partitions, rows_with, small_batches
from seqloom.llm.words import batch_words, give_back, mix, parts, white_space

SHINGLE = 5
PERCENT = 75  # least similarity
GROUP = 8  # members of a group, about
BUCKET = 64  # groups of a bucket whose pairs are all made at once
STAR, NEAR = 3, 2
FREQUENT_FROM = 24  # documents whose prefixes have the shingle
FREQUENT = 1 << 18  # frequent shingles that are broadcast, 3 MB with their parts
SPLIT = 2048  # documents of a part of a frequent shingle's bucket, about
OPEN_ROWS = 1 << 20  # rows of one bucket that are held at once
CELL = 1024  # members of a cluster that are compared with as many in one place, about
NEAREST, WIDTH, GROWTH = 16, 4, 8  # of the first round: partners of a member, cells of a member's row; and their growth
MAP_BITS = 4, 256, 1 << 17  # of the parity map of a set: for each shingle, at least, at most
FACTORS = mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def batch_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; below k words the whole sequence is one; without words none."""
    words, _, bounds = batch_words(column, white_space())
    n = len(words)
    every = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if n >= k else 0):
        every += words[j : n - k + 1 + j] * FACTORS[j]
    every = mix(every)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * FACTORS[: b - a]).sum(keepdims=True) + FACTORS[10 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares with the smallest similar set, at least."""
    return -(-percent * n // 100)


def prefix(shingles: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles in the global order, one more than a similar set can lack."""
    n = len(shingles)
    if not n:
        return shingles
    take = n - needed(n, percent) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        late = frequent[at] == shingles
        shingles = np.concatenate([shingles[~late], shingles[late]])
    return shingles[:take]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def docs_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


class Frequent:
    """Sorted frequent shingles, and for those whose buckets have several parts the parts' numbers."""

    def __init__(self, tokens: list[int] = (), counts: list[float] = ()):
        found = np.array(tokens, np.int64).view(np.uint64)
        order = np.argsort(found)
        self.tokens, self.parts = found[order], np.ceil(np.array(counts, float)[order] / SPLIT).astype(np.uint64)
        several = np.flatnonzero(self.parts > 1)
        whole = np.repeat(self.tokens[several], self.parts[several].astype(np.int64))
        part = np.concatenate([np.zeros(0, np.uint64), *(np.arange(n, dtype=np.uint64) for n in self.parts[several])])
        of = mix(whole + part)
        order = np.argsort(of)
        self.part, self.whole = of[order], whole[order]

    def buckets(self, shingles: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The bucket of each shingle of a document: the shingle, or one of its parts by the document."""
        if not len(self.part):
            return shingles
        at = np.minimum(np.searchsorted(self.tokens, shingles), len(self.tokens) - 1)
        several = (self.tokens[at] == shingles) & (self.parts[at] > 1)
        return np.where(several, mix(shingles + mix(ids.astype(np.int64).view(np.uint64)) % self.parts[at]), shingles)

    def shingles(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingle of each bucket, whether it has several parts)."""
        if not len(self.part):
            return buckets, np.zeros(len(buckets), bool)
        at = np.minimum(np.searchsorted(self.part, buckets), len(self.part) - 1)
        several = self.part[at] == buckets
        return np.where(several, self.whole[at], buckets), several


def frequent_shingles(docs: DataFrame, k: int, percent: int) -> Frequent:
    """The shingles that are in the most hash-ordered prefixes, FREQUENT at most, of all documents."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            got = [prefix(s, none, percent) for s in batch_sets(batch.column(0), k)]
            yield pa.RecordBatch.from_arrays([signed(np.concatenate([none, *got]))], ["token"])

    counts = small_batches(docs.select("text")).mapInArrow(run, "token long").groupBy("token").count().filter(F.col("count") >= FREQUENT_FROM)
    # by steps of the count, so that what is sorted or collected has a bound: the highest steps that hold FREQUENT at most
    counts = materialise(counts.select("token", F.floor(F.log2("count") * 16).alias("step")), "counts")  # few: most shingles are in one text
    least, held = None, 0
    for step in counts.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        held += step.n
        if held > FREQUENT:
            break
        least = step.step
    rows = counts.filter(F.col("step") >= least).collect() if least is not None else []
    discard(counts)
    return Frequent([r.token for r in rows], [2 ** ((r.step + 1) / 16) for r in rows])


def digests(sets: list[np.ndarray], salt: int) -> pa.Array:
    """A hash of each set as a whole."""
    size = np.array([len(s) for s in sets], np.int64)
    every = np.append(mix(np.concatenate([np.zeros(0, np.uint64), *sets]) + np.uint64(salt)), np.uint64(0))
    total = np.add.reduceat(every, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
    return signed(mix(np.where(size > 0, total, np.uint64(0)) + size.astype(np.uint64)))


def parity_map(shingles: np.ndarray) -> bytes:
    """For each value of some bits of the hash, whether an odd number of the set's shingles has it.

    Two sets differ by at least as many shingles as their maps by bits. A map has a power of two of bits by the set's
    size; the halves of a larger one, put together by exclusive or, are the map of half the bits.
    """
    each, least, most = MAP_BITS
    bits = min(most, max(least, 1 << (each * len(shingles) - 1).bit_length() if len(shingles) else 0))
    place = ((shingles >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of maps, as bytes, brought to that width."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def bits_apart(maps: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many bits each of the rows differs from the other map."""
    width = min(maps.shape[1], other.shape[1])
    return np.bitwise_count((folded(maps, width) ^ folded(other, width)).view(np.uint64)).sum(1, dtype=np.int64)


def near_enough(apart, n1, n2, percent: int):
    """Whether sets of n1 and n2 shingles whose maps are so many bits apart can be similar: similar ones differ by at most
    (100 - percent) / (100 + percent) of n1 + n2 shingles."""
    return apart * (100 + percent) <= (100 - percent) * (n1 + n2)


def read_sets(docs: DataFrame, frequent, k: int, percent: int) -> DataFrame:
    """doc_id, n, sig and sig2 (of the whole set), grp and grp2 (of its prefix), map (of parities)."""
    names = ["n", "sig", "sig2", "grp", "grp2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = batch_sets(batch.column(1), k)
            heads = [prefix(s, frequent.value.tokens, percent) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), digests(sets, 1), digests(sets, 2), digests(heads, 3), digests(heads, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([parity_map(s) for s in sets], pa.binary())], ["doc_id", *names, "map"])

    return small_batches(docs).mapInArrow(run, "doc_id long" + "".join(f", {c} long" for c in names) + ", map binary")


def prefix_rows(docs: DataFrame, frequent, k: int, percent: int) -> DataFrame:
    """bucket, doc_id, n, pos for each shingle of each prefix."""
    types = {"bucket": pa.int64(), "doc_id": pa.int64(), "n": pa.int32(), "pos": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = batch_sets(batch.column(1), k)
            heads = [prefix(s, frequent.value.tokens, percent) for s in sets]
            size = np.array([len(h) for h in heads], np.int64)
            ids = np.repeat(np.asarray(batch.column(0)), size)
            pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(s) for s in size)])
            n = np.repeat(np.array([len(s) for s in sets], np.int64), size)
            buckets = frequent.value.buckets(np.concatenate([np.zeros(0, np.uint64), *heads]), ids)
            step = 1 << 16
            for a in range(0, len(pos), step):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + step], t) for x, t in zip((buckets.view(np.int64), ids, n, pos), types.values(), strict=True)], list(types))

    return small_batches(docs).mapInArrow(run, "bucket long, doc_id long, n int, pos int")


def may_match(n1, p1, n2, p2, percent: int):
    """Whether sets of n1 and n2 shingles can be similar if their first shared shingle is at p1 and p2."""
    share = -(-percent * (n1 + n2) // (100 + percent))
    return (percent * np.maximum(n1, n2) <= 100 * np.minimum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= share)


def together(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(kept)
            kept, n = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def bucket_pairs(batches: Iterator[pa.RecordBatch], frequent: Frequent, percent: int, bucket: int, star: int, near: int, open_rows: int) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, doc_id, n, pos) sorted by bucket: pairs (a, b), and the rows of large buckets (a, token, lead, n, pos).

    token is the shingle; lead is the smallest document of what is held of the bucket. A bucket in several parts is large.
    """
    types = {"a": pa.int64(), "b": pa.int64(), "token": pa.int64(), "lead": pa.int64(), "n": pa.int32(), "pos": pa.int32()}

    def out(**columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(len(columns["a"]), t) for k, t in types.items()], list(types))

    def keep(i, j, d, n, p) -> Iterator[pa.RecordBatch]:
        ok = may_match(n[i].astype(np.int64), p[i], n[j].astype(np.int64), p[j], percent) & (d[i] != d[j])
        if ok.any():
            yield out(a=np.minimum(d[i], d[j])[ok], b=np.maximum(d[i], d[j])[ok])

    def work(columns: list[np.ndarray], going_on: int | None) -> Iterator[pa.RecordBatch]:
        """going_on: a large bucket that began in rows before these."""
        t, d, n, p = columns
        if not len(t):
            return
        first = np.concatenate([[True], t[1:] != t[:-1]])
        begins = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        size, start = np.diff(np.append(begins, len(t)))[of], begins[of]
        token, several = frequent.shingles(t.view(np.uint64))
        big = (size > bucket) | several
        if going_on is not None:
            big |= t == going_on
        i, lag = np.flatnonzero(size > 1), 1
        while len(i := i[(i - start[i] >= lag) & (~big[i] | (lag <= near))]):
            yield from keep(i, i - lag, d, n, p)
            lag += 1
        rows = np.flatnonzero(big)
        for s in range(star if len(rows) else 0):
            i = rows[rows - start[rows] > max(s, near)]
            yield from keep(i, start[i] + s, d, n, p)
        if len(rows):
            yield out(a=d[rows], token=token.view(np.int64)[rows], lead=np.minimum.reduceat(d, begins)[of[rows]], n=n[rows], pos=p[rows])

    held = [np.zeros(0, np.int64)] * 4
    going_on = None
    for batch in together(batches):
        columns = [np.asarray(batch.column(k)) for k in range(4)]
        order = np.lexsort((columns[1], columns[0]))  # documents in one order in all buckets
        columns = [np.concatenate([h, x[order]]) for h, x in zip(held, columns, strict=True)]
        t = columns[0]
        if not len(t):
            continue
        cut = int(np.searchsorted(t, t[-1]))
        if len(t) - cut <= open_rows:
            yield from work([x[:cut] for x in columns], going_on)
            held = [x[cut:] for x in columns]
            going_on = going_on if cut == 0 else None
        else:  # a bucket that isn't kept whole: its leaders stay, and what follows is compared with them
            yield from work(columns, int(t[-1]))
            held, going_on = [x[cut : cut + star] for x in columns], int(t[-1])
    yield from work(held, going_on)
    give_back()


def maps_of(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n, map of the documents with ids, a written table (doc_id)."""
    return rows_with(sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "map"), ids, "left_semi")


def members_of(pairs: DataFrame) -> DataFrame:
    return materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, that sizes and maps don't rule out, each once."""
    ids = members_of(pairs)
    maps = maps_of(sets, ids)
    one = maps.select(F.col("doc_id").alias("a"), "n", "map").hint("merge")
    two = maps.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("map").alias("map_b")).hint("merge")
    both = pairs.join(one, "a").join(two, "b").filter(percent * F.greatest("n", "n_b") <= 100 * F.least("n", "n_b")).select("a", "b", "n", "n_b", "map", "map_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            as_map = lambda column: (np.frombuffer(x, np.uint8)[None] for x in column.to_pylist())
            apart = np.array([bits_apart(x, y)[0] for x, y in zip(as_map(batch.column(4)), as_map(batch.column(5)), strict=True)], np.int64)
            ok = pa.array(near_enough(apart, np.asarray(batch.column(2)), np.asarray(batch.column(3)), percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    found = materialise(both.mapInArrow(run, "a long, b long").distinct(), "pairs")
    discard(ids)
    return found


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the distinct pairs (a, b), a written table, those whose texts' whole shingle sets are similar, each once for each pair of rows."""
    ids = members_of(pairs)
    texts = rows_with(docs, ids, "left_semi")
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            if part.num_rows:
                left = part.column(2).dictionary_encode()
                sets = batch_sets(left.dictionary, k)
                ok = []
                for i, other in zip(left.indices.to_pylist(), batch_sets(part.column(3), k), strict=True):
                    shared = len(np.intersect1d(sets[i], other, assume_unique=True))
                    ok.append(100 * shared >= percent * (len(sets[i]) + len(other) - shared) and shared > 0)
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    links = materialise(small_batches(both).mapInArrow(run, "a long, b long"), "links")
    discard(ids)
    return links


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of the pairs of groups; a group has a bounded number of members."""
    one = members.select(F.col("leader").alias("a"), F.col("doc_id").alias("x"))
    two = members.select(F.col("leader").alias("b"), F.col("doc_id").alias("y"))
    both = pairs.join(one, "a").join(two, "b").filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b")


def apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components, with these (of_a, of_b)."""
    first, second = (component.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")).hint("merge") for c in ("a", "b"))
    both = pairs.join(first, "a", "left").join(second, "b", "left")
    return both.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")).filter("of_a <> of_b")


def linked(component: DataFrame, links: DataFrame) -> DataFrame:
    """component, a written table that is used up, with what links (a, b) join. Of links between the same components one is followed."""
    above = components(apart(links, component).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    return replaced(component, above)


def clusters(large: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """cluster, doc_id, n, pos, map for the members of large buckets, each once for each cluster.

    A cluster is the buckets whose smallest document is the same: buckets of one passage have mostly one. Its members
    all share a shingle with that document, so clusters don't grow by chains. pos is the least position of a shared one.
    """
    part = large.select("token", "lead").distinct()
    whole = part.join(part.groupBy("token").agg(F.min("lead").alias("cluster")), "token")
    rows = large.join(whole.hint("merge"), ["token", "lead"]).groupBy("cluster", "a", "n").agg(F.min("pos").alias("pos"))
    each = rows.join(members.select(F.col("leader").alias("a"), "doc_id"), "a").select("cluster", "doc_id", "n", "pos")
    each = materialise(each, "cluster-members")
    ids = materialise(each.select("doc_id").distinct(), "ids")
    maps = maps_of(sets, ids).withColumnRenamed("n", "of").distinct()
    found = materialise(each.join(maps.hint("merge"), "doc_id").filter("n = of").drop("of"), "clusters")
    discard(each, ids)
    return found


def cells(rows: DataFrame, component: DataFrame, width: int) -> DataFrame:
    """The rows of clusters with several components, dealt to the cells (cluster, x, y) that compare them.

    Members outside the main component (open) are hashed to rows y of about CELL, all members to columns x; role says
    whether one stands in its cell for its row (1), its column (0) or both (2). A row meets width columns, and left is
    true where there are more of them.
    """
    placed = rows.join(component.select(F.col("node").alias("doc_id"), "component").hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    per = placed.groupBy("cluster", "component").agg(F.count("*").alias("held"))
    size = per.groupBy("cluster").agg(F.sum("held").alias("all"), F.max("held").alias("most"), F.max_by("component", "held").alias("main")).filter("most < all")
    size = size.select("cluster", "main", F.ceil(F.col("all") / CELL).cast("int").alias("across"), F.ceil((F.col("all") - F.col("most")) / CELL).cast("int").alias("down"))
    known = placed.join(bounded(size), "cluster")
    x, y = (F.pmod(F.xxhash64("doc_id", F.lit(s)), F.col(n)).cast("int") for s, n in ((1, "across"), (2, "down")))
    cell = lambda x, y, role: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(role).alias("role"))
    small = (F.col("across") == 1) & (F.col("down") == 1)
    is_open = F.col("component") != F.col("main")
    rows_of = F.filter(F.sequence(F.lit(0), F.col("down") - 1), lambda j: F.pmod(F.col("x") - j, F.col("across")) < width)
    columns_of = F.transform(F.sequence(F.lit(0), F.least(F.lit(width), F.col("across")) - 1), lambda d: F.pmod(F.col("y") + d, F.col("across")))
    both = F.concat(F.transform(rows_of, lambda j: cell(F.col("x"), j, 0)), F.when(is_open, F.transform(columns_of, lambda i: cell(i, F.col("y"), 1))).otherwise(F.array().cast("array<struct<x:int,y:int,role:int>>")))
    at = F.when(small, F.array(F.when(is_open, cell(F.lit(0), F.lit(0), 2)).otherwise(cell(F.lit(0), F.lit(0), 0)))).otherwise(both)
    dealt = known.withColumn("x", x).withColumn("y", y).withColumn("at", F.explode(at)).withColumn("left", F.col("across") > width)
    return dealt.select("cluster", "at.x", "at.y", "at.role", "doc_id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "component", "left", "map")


def cell_pairs(batches: Iterator[pa.RecordBatch], percent: int, nearest: int) -> Iterator[pa.RecordBatch]:
    """Of cells' rows sorted by cell: pairs (a, b) of different components that the bounds allow, for each open member
    the nearest ones by their maps, and (null, null) where a cell has more of them."""

    def work(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
        role, d, n, p, c, left = (rows.column(k).to_numpy() for k in ("role", "doc_id", "n", "pos", "component", "left"))
        maps = rows.column("map").to_pylist()
        width = np.array([len(x) for x in maps])
        own, others = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
        by_width = {w: (at := others[width[others] == w], np.frombuffer(b"".join([maps[j] for j in at]), np.uint8).reshape(-1, w)) for w in np.unique(width[others]).tolist()}
        a, b, more = [], [], bool(left.any()) and len(own) > 0
        for i in own.tolist():
            this, found = np.frombuffer(maps[i], np.uint8)[None], []
            for at, rest in by_width.values():
                can = np.flatnonzero(may_match(n[i], p[i], n[at], p[at], percent) & (c[at] != c[i]))
                if len(can):
                    apart = bits_apart(rest[can], this)
                    near = near_enough(apart, n[at[can]], n[i], percent)
                    found.append((at[can][near], apart[near] / (n[at[can][near]] + n[i])))
            if not found:
                continue
            ok, apart = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(ok) > nearest:
                more, ok = True, ok[np.argsort(apart, kind="stable")[:nearest]]
            a.append(np.minimum(d[ok], d[i]))
            b.append(np.maximum(d[ok], d[i]))
        return a, b, more

    def out(rows: pa.Table) -> pa.RecordBatch:
        a, b, more = work(rows)
        both = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array([*x.tolist(), *[None] * more], pa.int64()) for x in both.T], ["a", "b"])

    held: list[pa.RecordBatch] = []
    of = None
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if of != (of := tuple(key[x].tolist())) and held:
                yield out(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(x, y - x))
    if held:
        yield out(pa.Table.from_batches(held))
    give_back()


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are what white space (ASCII) separates, A-Z lower-cased; a set has the distinct k-word shingles of the whole
    text, or the whole sequence if it is shorter. Documents link at percent/100 of Jaccard similarity. component_id is
    the smallest doc_id that links reach, itself included. Null and empty texts, and those without words, have 0
    shingles and no links. Rows without doc_id have no links and a null component. If rows with different texts share a
    doc_id, that id has the links of all of them. Repeated rows give repeated rows; an empty table gives none; other
    columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs_of(docs, text, doc_id)
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    frequent = spark.sparkContext.broadcast(frequent_shingles(named, k, percent))
    sets = materialise(read_sets(docs, frequent, k, percent), "sets")

    key, group = ["sig", "sig2", "n"], ["grp", "grp2", "n"]
    classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("grp").alias("grp"), F.min("grp2").alias("grp2"))
    classes = materialise(classes, "classes")
    # groups of about GROUP: larger ones are cut by a hash of their members
    cut = materialise(classes.groupBy(*group).agg(F.ceil(F.count("*") / GROUP).alias("pieces")).filter("pieces > 1"), "cut")
    pieces = classes.join(bounded(cut), group, "left").withColumn("piece", F.pmod(F.xxhash64("rep"), F.coalesce("pieces", F.lit(1))))
    leaders = pieces.groupBy(*group, "piece").agg(F.min("rep").alias("leader"), F.count("*").alias("size"))
    members = materialise(pieces.join(leaders, [*group, "piece"]).select("leader", F.col("rep").alias("doc_id"), "size"), "members")

    first = members.filter("leader = doc_id").select("doc_id")
    rest = materialise(sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id").distinct().join(first, "doc_id", "left_anti"), "rest")
    dealt = prefix_rows(rows_with(named, rest, "left_anti"), frequent, k, percent)
    limits = percent, BUCKET, STAR, NEAR, OPEN_ROWS
    found = materialise(dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: bucket_pairs(batches, frequent.value, *limits), "a long, b long, token long, lead long, n int, pos int"), "found")

    groups_of_many = members.filter("size > 1 AND leader = doc_id").select(F.col("leader").alias("a"), F.col("leader").alias("b"))
    group_pairs = found.filter("b IS NOT NULL").select("a", "b").union(groups_of_many).distinct()
    met = materialise(expanded(group_pairs, members).distinct(), "met")
    pairs = possible(met, sets, percent)
    tested = materialise(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")  # one for each member; the rest wait for its links
    links = verify(tested, named, k, percent)
    component = components(links)
    discard(links)
    waiting = materialise(apart(pairs.join(tested, ["a", "b"], "left_anti"), component).select("a", "b"), "waiting")

    rows = clusters(found.filter("b IS NULL"), members, sets)
    discard(cut, rest, found, met)
    nearest, width, left = NEAREST, WIDTH, True
    while left:
        dealt = cells(rows, component, width).repartition(partitions(spark), "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
        late = materialise(dealt.mapInArrow(lambda batches, n=nearest: cell_pairs(batches, percent, n), "a long, b long").distinct(), "late")
        new = late.filter("a IS NOT NULL")
        new = materialise((new if nearest > NEAREST else new.union(waiting).distinct()).join(tested, ["a", "b"], "left_anti"), "new-pairs")
        if new.limit(1).count():
            links, tested = verify(new, named, k, percent), tested.union(new)
            if links.limit(1).count():
                component = linked(component, links)
            discard(links)
        left = late.filter("a IS NULL").limit(1).count()
        discard(late)
        nearest, width = GROWTH * nearest, GROWTH * width

    reached = classes.select(*key, "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    of = materialise(reached.select(*key, F.coalesce("component", "rep").alias("component")), "components")
    discard(classes, members, rows, component, pairs, waiting)
    return (
        sets.select("doc_id", *key)
        .join(of.hint("merge"), key, "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest, all columns as they are. Rows without doc_id stay."""
    copies = jaccard_components(docs, text, doc_id).filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return rows_with(docs, materialise(copies, "near-copies"), "left_anti", doc_id)
