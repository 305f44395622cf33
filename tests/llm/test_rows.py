"""BPE, sharding and exact dedup against brute force, with nulls, empties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm.bpe import WordBPE, bpe_digests, encode_ids
from seqloom.llm.exact_dedup import drop_copies, exact_dedup, merged_runs
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.sharding import assign_shards, smallest_capacity, walk

SCHEMA = "doc_id long, text string, lane string, digest int, h double, n long"


def docs(spark, texts):
    rows = [(i if isinstance(i, int) or i is None else None, t, "x", 1, 2.0, None) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sample():
    r = random.Random(3)
    texts = [None, "", " ", "a" * 50_000, "Ärger <|endoftext|> it's 12²", "x", "x", "x"]
    texts += [" ".join(r.choice(["the", "and", "thorly", "eau", "42"]) for _ in range(r.randint(0, 6))) for _ in range(400)] + ["hot text"] * 200
    return list(enumerate(texts, 5))


def test_bpe_equals_library(spark, sample):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in bpe_digests(docs(spark, sample), tokenizer_path()).collect()}
    assert len(got) == len(sample)
    for i, t in sample:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert bpe_digests(docs(spark, []), tokenizer_path()).count() == 0


def test_bpe_knows_every_code_point():
    from tokenizers import Tokenizer

    lib, bpe = Tokenizer.from_file(tokenizer_path()), WordBPE(tokenizer_path())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 16):
        texts = [f"a{chr(c)}b1{chr(c)}2 {chr(c)}{chr(c)}'s" for c in points[at : at + (1 << 16)]]
        ids, ends = bpe.ids_of(pa.array(texts, pa.large_string()))
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert ends.tolist() == [0, *accumulate(map(len, want))] and ids.tolist() == [i for x in want for i in x]


def test_bpe_of_random_texts_equals_library():
    from tokenizers import Tokenizer

    lib, bpe, r = Tokenizer.from_file(tokenizer_path()), WordBPE(tokenizer_path()), random.Random(11)
    signs = ["a", "e", "th", "ing", "Z", " ", " ", "\t", "\x1c", "\u2003", "\u0301", "é", "Σ", "İ", "ß", "中", "'s", "'ll", "'", "!", "1", "²", "<|", "|>", "<|endoftext|>", "<|STARTOFTEXT|>", "\U0001f600", "x" * 70, "\xa0", "\n"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", None, "ab" * 5000]
    n, ids, said = bpe.digests(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert n[i] == len(want) and ids[i] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), t
        assert said[i] == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_ids(spark, sample):
    bpe = WordBPE(tokenizer_path())
    for r in encode_ids(docs(spark, sample[:20]), tokenizer_path()).collect():
        assert r.ids == bpe.encode(dict(sample)[r.doc_id])


def test_bpe_merges_like_a_plain_loop():
    bpe, r = WordBPE(tokenizer_path()), random.Random(5)
    for _ in range(500):
        word = "".join(r.choice("theaninorst") for _ in range(r.randint(1, 30)))
        ids = [bpe.vocab[c] for c in word[:-1]] + [bpe.vocab[word[-1] + "</w>"]]
        while pairs := [(bpe.ranks[a][b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if b in bpe.ranks[a]]:
            rank, i = min(pairs)
            ids[i : i + 2] = [bpe.made[rank]]
        assert bpe.word(word) == ids
        assert bpe.encode(word) == ids


def test_dedup_equals_brute_force(spark, sample):
    got = {r.doc_id: r for r in exact_dedup(docs(spark, sample)).collect()}
    groups = defaultdict(list)
    for i, t in sample:
        groups[t or ""].append(i)
    assert len(got) == len(sample)
    for i, t in sample:
        own = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    low = exact_dedup(docs(spark, sample), keep="min", fan_in=3).filter("kept").collect()
    assert {r.doc_id for r in low} == {min(x) for x in groups.values()}


def test_dedup_merges_sorted_runs(spark, sample):
    entries = docs(spark, sample).select(F.expr("doc_id % 3 AS range"), F.expr("doc_id % 5 AS lane"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("check"), F.struct("doc_id").alias("best"), F.expr("1 AS n"))
    plan = merged_runs(entries)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan and plan.count("Sort [") == plan.count("Exchange") == 1


def test_dedup_edges(spark):
    got = exact_dedup(docs(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")])).collect()
    by = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert by == {(1, 1, 3, True): 1, (1, 1, 3, False): 1, (None, 1, 3, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1}
    assert exact_dedup(docs(spark, [])).count() == 0
    low = exact_dedup(docs(spark, [(-(2**63), "a"), (2**63 - 1, "a"), (None, "a")]), keep="min").filter("kept").collect()
    assert [r.keep_id for r in low] == [-(2**63)]
    mixed = drop_copies(docs(spark, [(1, "a"), (2, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "c"), (None, "b"), (7, "d")]).withColumn("body0", F.lit(1)))
    assert sorted(((r.doc_id or 0, r.text) for r in mixed.collect())) == [(0, "c"), (1, "b"), (2, "a"), (7, "d")] and mixed.columns[-1] == "body0"
    left = drop_copies(docs(spark, [(1, "a"), (2, "a"), (3, None), (4, "")]))
    assert sorted(r.doc_id for r in left.collect()) == [2, 4] and left.columns == ["doc_id", "text", "lane", "digest", "h", "n"]


def best(sizes, shards):
    """Minimax by dynamic programming."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    last = ends[1:]
    for _ in range(shards - 1):
        last = [min(max(last[j - 1] if j else 0, ends[i + 1] - ends[j]) for j in range(i + 1)) for i in range(len(sizes))]
    return last[-1]


def test_minimax():
    r = random.Random(1)
    for _ in range(60):
        sizes = [r.choice([1, 5, 9, 100]) for _ in range(r.randint(1, 40))]
        k = r.randint(1, 8)
        assert smallest_capacity(sizes, k) == best(sizes, k)
        assert len(walk(sizes, best(sizes, k))) < k


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_sharding(spark, sample, shards):
    from pyspark.sql import functions as F

    df = docs(spark, sample)
    got = assign_shards(df, shards).collect()
    text = dict(sample)
    assert len(got) == len(sample)
    home, slots, load = {}, defaultdict(list), Counter()
    for r in got:
        t = text[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        assert home.setdefault(t, r.shard) == r.shard and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    order = df.select(F.coalesce("text", F.lit("")).alias("t")).groupBy("t").count().select((F.octet_length("t") + 8).alias("size"), "count", F.xxhash64("t").alias("h")).orderBy("h").collect()
    assert max(load.values()) == best([r["size"] * r["count"] for r in order], shards)


def test_sharding_edges(spark):
    assert assign_shards(docs(spark, []), 24).count() == 0
    got = assign_shards(docs(spark, [(1, "a"), (1, "a"), (None, None)]), 24).collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3


def test_a_group_of_a_third_leaves_no_shard_empty(spark):
    rows = [(i, f"{i} " * 40) for i in range(2000)]
    third = sum(len(t) + 8 for _, t in rows) // 2
    rows += [(10_000 + i, "x" * 992) for i in range(third // 1000)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).groupBy("shard").agg(F.sum("size").alias("size")).collect()
    sizes = sorted(r["size"] for r in got)
    assert len(sizes) == 24 and sizes[-1] == 1000 * (third // 1000)
    assert sizes[-2] < 1.1 * sum(sizes[:-1]) / 23 and sizes[0] > 0.5 * sizes[-2]
