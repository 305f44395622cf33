"""The pipeline's stages against brute force, each on its own input."""

import hashlib
from collections import defaultdict

import corpus_pipeline
from seqloom.llm.bpe import WordBPE
from seqloom.llm.langid import identify_languages
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.shared import materialise, table
from tests.llm.test_decontaminate import words
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontaminate", "bpe"]
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialise(stage(spark, steps[-1], SF), name))
        if name != "bpe":
            assert steps[-1].columns == columns
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]

    rejected = {r.doc_id for r in identify_languages(docs).filter("rejected").collect()}
    assert set(rows[1]) == set(rows[0]) - rejected and all(rows[0][i] == r for i, r in rows[1].items())
    clean = [i for i, r in rows[0].items() if len(r.text or "") > 100]
    assert sum(i in rows[1] for i in clean) > 0.98 * len(clean)

    groups = defaultdict(list)
    for i, r in rows[1].items():
        groups[r.text or ""].append(i)
    assert set(rows[2]) == {max(g) for g in groups.values()}

    near = brute([(i, r.text) for i, r in rows[2].items()])
    assert set(rows[3]) == {i for i, (_, low) in near.items() if low == i}

    items = [" ".join(words(r.text)) for r in table(spark, SF, "benchmark").collect()]
    assert set(rows[4]) == {i for i, r in rows[3].items() if not any(f" {x} " in f" {' '.join(words(r.text))} " for x in items)}

    tokenizer = WordBPE(tokenizer_path())
    for i, r in rows[5].items():
        ids = tokenizer.encode(rows[4][i].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert set(rows[5]) == set(rows[4])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns; then no rows at all."""
    prose = "The committee met on Tuesday and agreed that the report should be sent to all of its members before the end of the month."
    other = "Die Sitzung begann am Dienstag, und der Ausschuss beschloss, den Bericht noch vor dem Ende des Monats zu versenden."
    item = table(spark, SF, "benchmark").filter("text IS NOT NULL").first().text
    rows = [(i, f"{prose} {i} {i * 7}", "en", "s") for i in range(60)] + [(100 + i, f"{other} {i} {i * 7}", "de", None) for i in range(60)]
    rows += [(1000, prose, "en", "s"), (1001, prose, None, None), (1001, prose, None, None), (None, prose + " again and again", "en", None), (None, None, None, None), (1003, None, "en", "s"), (1004, "", None, "s"), (1005, f"{prose} {item} {prose}", "en", "s"), (1006, (other + " ") * 2000, "de", None)]
    docs = spark.createDataFrame([(*r, k, "x", None) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, component_id long, digest string, a double")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialise(stage(spark, steps[-1], SF), name))
        assert name == "bpe" or steps[-1].columns == docs.columns
    kept = [sorted(-1 if r.doc_id is None else r.doc_id for r in x.collect()) for x in steps]
    assert {1003, 1004} <= set(kept[0]) - set(kept[1]) and kept[1].count(1001) == 2 and 1000 in kept[1] and 1006 in kept[1]
    assert kept[2].count(1001) == 1 and 1000 not in kept[2] and -1 in kept[2]
    assert set(kept[3]) >= {0, 100, 1005, -1} and len(kept[3]) < len(kept[2]) - 50
    assert 1005 not in kept[4] and set(kept[4]) == set(kept[3]) - {1005} and kept[5] == kept[4]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_stages_keep_nulls_that_earlier_ones_would_drop(spark):
    """Each stage on its own, with null and empty texts and null ids."""
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "", 0), (None, "a b c", 0), (4, "a b c", 0)], "doc_id long, text string, n int")
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: sorted((r.doc_id or 0, r.text or "") for r in stages[name](spark, docs, SF).collect())
    assert left("exact_dedup") == [(2, ""), (4, "a b c")]
    assert left("ngram_join") == left("decontaminate") == [(0, ""), (0, "a b c"), (1, ""), (2, ""), (4, "a b c")]
    assert stages["bpe"](spark, docs, SF).count() == 5
