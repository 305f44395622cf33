"""The n-gram Jaccard join against brute force, small buckets and long ones."""

import random
import re

import numpy as np
import pytest

from seqloom.llm import ngram_join
from seqloom.llm.components import components
from seqloom.llm.ngram_join import jaccard_components, one_of_each

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def make(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, family = text(40), text(60)
    rows = [None, "", " \n", "one", "ONE", "one two three", "one  two\tTHREE"]
    for _ in range(n):
        kind = r.random()
        if kind < 0.3:
            words = list(family)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        elif kind < 0.5:
            words = text(r.randint(0, 30)) + passage
        elif kind < 0.7 and rows[-1]:
            words = rows[r.randrange(len(rows))] or ""
            words = words.split()
            if len(words) > 8:
                del words[r.randrange(len(words))]
        else:
            words = text(r.randint(1, 60))
        rows.append(" ".join(words))
    ids = r.sample(range(5000), len(rows))
    return list(zip(ids, rows, strict=True))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n int, token string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}


SMALL = {"STAR": 1, "NEAR": 1, "FREQUENT_FROM": 6}


@pytest.mark.parametrize(("seed", "limits"), [(1, {"FREQUENT_FROM": 6}), (2, SMALL | {"BUCKET": 3, "NEAREST": 1, "GROWTH": 2}), (3, SMALL | {"BUCKET": 4, "OPEN_ROWS": 7, "CELL": 9, "GROUP": 1}), (4, SMALL | {"BUCKET": 3, "SPLIT": 12, "CELL": 5, "NEAREST": 2, "GROWTH": 3})])
def test_equals_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = make(seed)
    assert run(spark, rows) == brute(rows)


def test_maps_bound_the_difference():
    r = np.random.default_rng(4)
    for n, m in ((3, 5), (60, 64), (200, 300), (900, 1100), (5000, 40_000)):
        every = r.integers(0, 1 << 63, n + m, np.uint64)
        one, two = np.unique(every[: m]), np.unique(every[n:])
        apart = len(np.setxor1d(one, two))
        maps = [np.frombuffer(ngram_join.parity_map(x), np.uint8)[None] for x in (one, two, one)]
        assert 0 <= ngram_join.bits_apart(maps[0], maps[1])[0] <= apart and ngram_join.bits_apart(maps[0], maps[2])[0] == 0
    assert len(ngram_join.parity_map(every[:0])) == 32 and len(ngram_join.parity_map(np.arange(1 << 20, dtype=np.uint64))) == 1 << 14
    far = [np.frombuffer(ngram_join.parity_map(r.integers(0, 1 << 63, n, np.uint64)), np.uint8)[None] for n in (3000, 3000)]
    assert not ngram_join.near_enough(ngram_join.bits_apart(*far)[0], 3000, 3000, 75)


def test_parts_of_buckets():
    tokens = [7, -5, 1000]
    frequent = ngram_join.Frequent(tokens, [100, ngram_join.SPLIT * 3, ngram_join.SPLIT * 2.5])
    shingles = np.array([7, -5, 1000, 12] * 500, np.int64).view(np.uint64)
    buckets = frequent.buckets(shingles, np.arange(2000))
    back, several = frequent.shingles(buckets)
    assert (back == shingles).all() and (several == np.isin(shingles.view(np.int64), [-5, 1000])).all()
    assert [len(set(buckets[k::4].tolist())) for k in range(4)] == [1, 3, 3, 1]


def test_a_large_group_of_equal_prefixes(spark, monkeypatch):
    """Sets of one size that differ in late shingles only, some of them too much to link with the first."""
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 3)
    monkeypatch.setattr(ngram_join, "BUCKET", 4)
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in r.sample(range(60), r.choice([1, 2, 3, 6])):
            words[at] = f"c{r.randrange(12)}"
        rows.append((i * 7 % 1000, " ".join(words)))
    assert run(spark, rows) == brute(rows)


def test_links_within_a_component_are_not_followed_again(spark, monkeypatch):
    for name, value in (SMALL | {"BUCKET": 3, "NEAREST": 1, "GROWTH": 2}).items():
        monkeypatch.setattr(ngram_join, name, value)
    calls = []

    def recorded(links):
        calls.append([(r.a, r.b) for r in links.collect()])
        return components(links)

    monkeypatch.setattr(ngram_join, "components", recorded)
    rows = make(2)
    assert run(spark, rows) == brute(rows)
    low = {}
    for links in calls:
        find = lambda i: i if low.get(i, i) == i else find(low[i])
        assert all(find(a) != find(b) for a, b in links)
        for a, b in links:
            x, y = sorted((find(a), find(b)))
            low[y] = x
    assert len(calls) > 1


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0
    got = jaccard_components(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (9, "z " * 300_000)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 2, 0), (2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 1, 9)]
    left = one_of_each(spark.createDataFrame([(3, "a b", 1), (5, "A  b", 2), (6, None, 3), (None, "a b", 4)], "doc_id long, text string, n int"))
    assert sorted((r.doc_id or 0, r.n) for r in left.collect()) == [(0, 4), (3, 1), (6, 3)]


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(70)] + [(200, 150), (None, 3), (9, 9), (150, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(71)} | {150: 150, 200: 150}
