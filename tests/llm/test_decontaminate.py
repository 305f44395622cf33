"""Benchmark decontamination against a brute-force search, planted edits, and edge cases."""

import random
import re

import numpy as np
import pyarrow as pa

from seqloom.llm.decontaminate import Index, aligned, allowed, anchors, drop_leaks, edited_copies, find_leaks, repetitions, steps_of, tokens, walk_keys
from seqloom.llm.words import word_hash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
words = lambda t: WORD.findall((t or "").translate(LOWER))


def least(item, text):
    """Sellers' least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(text, 1):
            last, row[j] = row[j], min(last + (w != x), row[j] + 1, row[j - 1] + 1)
    return min(row)


def planted(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(10, 45)))) for i in range(25)]
    docs = []
    for i in range(n):
        body = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if i % 2:
            item = words(r.choice(items)[1])
            for _ in range(r.randint(0, allowed(len(item), 0.1) + 1)):
                k, kind = r.randrange(len(item)), r.random()
                item[k : k + (kind < 0.7)] = [r.choice(vocabulary)] if 0.3 < kind else []
            at = r.randint(0, len(body))
            body[at:at] = item
        docs.append((i, ", ".join(body).upper()))
    return docs, items


def test_equals_brute_force_within_recall(spark):
    docs, items = planted(1, 300)
    truth = {(d, i): dist for d, t in docs for i, it in items if (dist := least(words(it), words(t))) <= allowed(len(words(it)), 0.1)}
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=9).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    assert len(found) == len(got) and all(truth[k] <= v <= allowed(len(words(items[k[1]][1])), 0.1) for k, v in found.items())
    exact = {k for k, v in truth.items() if v == 0}
    assert exact and exact <= set(found) and len(found) >= 0.98 * len(truth) and len(truth) > len(exact)
    text = dict(docs)
    for r in got:
        if r.distance == 0:
            item = words(items[r.item_id][1])
            assert words(text[r.doc_id])[r.first_word : r.first_word + len(item)] == item


def test_edges(spark):
    item = "one two three four five six seven"
    items = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (4, "")], "item_id long, text string")
    rows = [(1, None, 0), (2, "", 0), (3, item.upper() + "!", 0), (3, item.upper() + "!", 0), (None, f"x {item}", 0), (5, "one two three five six", 0), (7, "one two three four five six", 0), (6, "z " * 200_000 + item, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, distance int")
    got = sorted((r.doc_id or 0, r.item_id, r.distance, r.first_word) for r in find_leaks(df, items).collect())
    assert got == [(0, 1, 0, 1), (3, 1, 0, 0), (3, 1, 0, 0), (6, 1, 0, 200_000), (7, 1, 1, 0)]
    assert sorted((r.doc_id or 0) for r in drop_leaks(df, items).collect()) == [0, 1, 2, 5]
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0


def test_walks():
    r = np.random.default_rng(0)
    x = r.integers(1, 1 << 60, 400, np.uint64)
    copy = np.concatenate([r.integers(1, 1 << 60, 7, np.uint64), x[:150], x[151:]])  # moved by 7, and by 6 after a deletion
    steps = steps_of(400, 40)
    for i in range(40):
        one, two = (walk_keys(w, np.arange(len(w)), i, steps) for w in (x, copy))
        assert (one[: 150 - steps] == two[7 : 157 - steps]).all() and (one[151:-steps] == two[157:-steps]).all()
        other = walk_keys(r.integers(1, 1 << 60, 400, np.uint64), np.arange(380), i, steps)
        assert not set(one.tolist()) & set(other.tolist()) and steps <= 15
    assert all(a + steps_of(m, k) <= m for m in range(1, 60) for k in (0, 1, 2, 5) if k < m for a in anchors(m, k))
    assert aligned(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 7, 3, 4])) == (1, 1) and repetitions(5, 0) == 1 and repetitions(6, 1) > repetitions(200, 20) > 1


def test_lsh_reaches_its_recall():
    """Of copies with as many edits as are allowed, that repetitions() wasn't measured on."""
    for m in (6, 8, 10, 15, 24, 45, 130):
        k = allowed(m, 0.1)
        index = Index([(0, " ".join(f"w{i}" for i in range(1, m + 1)))], 0.1)
        tries = found = 0
        for copy in edited_copies(m, k, 60):
            text, bounds = tokens(pa.array([" ".join(["a b c", *(f"w{i}" for i in copy), "d e f"])]))
            found += bool(index.candidates(text, np.array([0]), bounds[:1], bounds[1:])[0])
            tries += 1
        assert found >= 0.985 * tries, (m, found, tries)


def test_short_items(spark):
    """Items of 1 to 12 words against brute force: exact ones up to 5 words, one edit from 6 on."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(1 + i % 12))) for i in range(36)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 50)))) for i in range(60)]
    for i, t in items:
        for kind in (0, 1, 2, 3):
            body = t.split()
            at = r.randrange(len(body))
            body[at : at + (kind in (1, 2))] = [[], ["x"], [], ["x"]][kind]
            docs.append((len(docs), " ".join(["before", *body, "after"])))
    truth = {(d, i, n) for d, t in docs for i, it in items if (n := least(words(it), words(t))) <= allowed(len(words(it)), 0.1)}
    got = {(x.doc_id, x.item_id, x.distance) for x in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= truth and {x for x in truth if x[2] == 0} <= got and len(got) >= 0.99 * len(truth)
    assert {len(items[i][1].split()) for _, i, _ in got} == set(range(1, 13))


def test_scripts_without_spaces(spark):
    chinese, thai = "太阳从东方升起，照亮了整个山谷和河流。", "ภาษาไทยไม่มีช่องว่างระหว่างคำ"
    items = spark.createDataFrame([(1, chinese), (2, thai), (3, "Ärger mit Ölen über Äpfel naïve façade")], "item_id long, text string")
    texts = ["前言" + chinese + "后记", "前言" + chinese.replace("东", "西"), "x" + thai + "y", "月亮落下，星星出来了。", "ärger"]
    got = sorted((r.doc_id, r.item_id, r.distance, r.first_word) for r in find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect())
    assert [x[:3] for x in got] == [(0, 1, 0), (1, 1, 1), (2, 2, 0)] and got[0][3] == 2
    mixed, bounds = tokens(pa.array(["ab中文cd é 日x", "文", ""]))
    assert mixed.tolist() == [word_hash(w) for w in ["ab", "中", "文", "cd", "é", "日", "x", "文"]] and bounds.tolist() == [0, 7, 8, 8]


def test_finds_all_edits_of_long_items(spark):
    r = random.Random(3)
    items = [(i, [f"w{r.randrange(400)}" for _ in range(m)]) for i, m in enumerate([60, 100, 200] * 2)]
    items += [(6, ["same"] * 30 + [f"v{i}" for i in range(70)])]  # one pair again and again before the rest
    docs = []
    for i, item in items:
        for kind in ("delete", "insert", "change"):
            for share in (1, 0.5, 0.2):  # of the item, from its start, that gets all edits
                text, k = list(item), allowed(len(item), 0.1)
                for at in sorted(r.sample(range(max(k, int(share * len(item)))), k), reverse=True):
                    text[at : at + (kind != "insert")] = [] if kind == "delete" else [f"x{r.randrange(400)}"]
                docs.append((len(docs), i, ["before"] * 30 + text + ["after"] * 30))
    assert all(least(dict(items)[i], t) <= allowed(len(dict(items)[i]), 0.1) for _, i, t in docs)
    got = find_leaks(spark.createDataFrame([(d, " ".join(t)) for d, _, t in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.distance for x in got} == {(d, i): least(dict(items)[i], t) for d, i, t in docs}


def test_all_by_brute_force(spark):
    docs, items = planted(2, 300)
    truth = {(d, i, dist) for d, t in docs for i, it in items if (dist := least(words(it), words(t))) <= allowed(len(words(it)), 0.1)}
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=9).collect()
    assert truth and {(x.doc_id, x.item_id, x.distance) for x in got} == truth
