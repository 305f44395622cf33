"""Golden counts on a small file, brute force on random strings, invariants, thresholds, parsers and sinks."""

import random
from itertools import product

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from seqloom.functions.stats import absolute_quorum, binomial_tail, log_factorials, printed_pvalue, within_quorum
from seqloom.functions.words import smile_id
from seqloom.operators import background, extract, windows
from seqloom.operators.extract import count_occurrences, dataset_stats, extract_motifs
from seqloom.operators.simulate import accuracy, simulate_single, simulate_structured
from seqloom.operators.windows import edit_contexts, gap_structures, kmer_windows, structured_tuples
from seqloom.params import ALPHABETS, Box, MotifParams
from seqloom.plans import marked, packed
from seqloom.plans.similarity import hamming_pairs
from seqloom.queries import PRINTED, printing, tail_sql
from seqloom.sources import sinks
from seqloom.sources.fasta import read_fasta, validated
from seqloom.sources.results import parse_boxes, read_motifs, read_result

SMALL = ["GATAGCTATAGCTAGCTCGAT", "GATAGGATAAGAGATGCTATAGTCCTACGATATTTAGCTAGCTCGAT", "GATAGGATAAGAGATGCTATAGTCCTACGATATTTAGCTAGCTCGATTATGCTCGATAGATAGAATGCGCGCCTCTCTAGGAT"]
BOXES = (Box(16, 17, 6, 1), Box(15, 16, 7, 2))
SHORT_BOX = (Box(2, 4, 4, 1),)


def frame(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string")


@pytest.fixture(scope="module")
def small(spark):
    return frame(spark, SMALL).cache()


def listed(df):
    return [(r.motif, r.u, r.v) for r in df.orderBy("first").collect()]


GOLDEN = [
    ("hamming", 6, 0, 100, (), 10, "TAGCTA 3 4; GCTATA 3 3; CTATAG 3 3; AGCTAG 3 3; GCTAGC 3 3"),
    ("hamming", 6, 1, 100, (), 26, "GATAGC 3 9; ATAGCT 3 8; TAGCTA 3 8; AGCTAT 3 6; GCTATA 3 3"),
    ("hamming", 6, 1, 50, (), 59, "GATAGC 3 9; ATAGCT 3 8; TAGCTA 3 8"),
    ("hamming", 8, 1, 67, (), 15, "AGCTATAG 3 3; GCTATAGC 3 3; TATAGCTA 3 4; ATAGCTAG 3 5; TAGCTAGC 3 3"),
    ("hamming", 10, 2, 100, (), 12, "CTATAGCTAG 3 4; TATAGCTAGC 3 3; ATAGCTAGCT 3 5"),
    ("edit", 6, 0, 100, (), 10, "TAGCTA 3 4; GCTATA 3 3"),
    ("edit", 6, 1, 100, (), 36, "GATAGC 3 17; ATAGCT 3 17; TAGCTA 3 21; AGCTAT 3 11; GCTATA 3 9"),
    ("edit", 6, 1, 50, (), 66, "GATAGC 3 17"),
    ("edit", 8, 1, 67, (), 27, "GATAGCTA 3 7; ATAGCTAT 3 7; TAGCTATA 3 5; AGCTATAG 3 5; GCTATAGC 3 9"),
    ("edit", 10, 2, 100, (), 32, "GATAGCTATA 3 15; ATAGCTATAG 3 13; TAGCTATAGC 3 14"),
    ("hamming", 6, 1, 1, BOXES, 132, "GATAGG_TCCTAC_CGATTAT 1 1; GATAGG_TCCTAC_GATTATG 1 1; GATAGG_CCTACG_GATTATG 1 1"),
    ("edit", 6, 1, 1, BOXES, 132, "GATAGG_TCCTAC_CGATTAT 1 10; GATAGG_TCCTAC_GATTATG 1 10"),
    ("hamming", 6, 1, 60, BOXES, 0, ""),
    ("edit", 6, 1, 60, BOXES, 0, ""),
    ("hamming", 4, 1, 100, SHORT_BOX, 69, "GATA_TATA 3 4; GATA_ATAG 3 8; GATA_TAGC 3 8"),
    ("edit", 4, 1, 100, SHORT_BOX, 127, "GATA_TATA 3 26; GATA_ATAG 3 51; GATA_TAGC 3 47"),
]


@pytest.mark.parametrize(("distance", "k", "e", "q", "boxes", "n", "first"), GOLDEN)
def test_golden(small, distance, k, e, q, boxes, n, first):
    got = listed(extract_motifs(small, MotifParams(k, e, q, distance, boxes=boxes)))
    want = [(m, int(u), int(v)) for m, u, v in (x.split() for x in first.split("; ") if x)]
    assert len(got) == n and got[: len(want)] == want


def ends_of(word, text, e, distance):
    """End positions in the text of stretches within e of the word."""
    if distance == "hamming":
        k = len(word)
        return {i + k - 1 for i in range(len(text) - k + 1) if sum(a != b for a, b in zip(word, text[i : i + k], strict=True)) <= e}
    row = [0] * (len(text) + 1)
    for i, w in enumerate(word, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(text, 1):
            last, row[j] = row[j], min(last + (w != x), row[j] + 1, row[j - 1] + 1)
    return {j - 1 for j in range(1, len(text) + 1) if row[j] <= e}


def brute(seqs, p):
    n = len([s for s in seqs if s])
    total, found = p.total_length, {}
    gaps = p.structures or [()]
    for s in seqs:
        if len(s) < total:
            continue
        for end, g in product(range(p.k - 1, len(s)), gaps):
            boxes, at = [s[end - p.k + 1 : end + 1]], end
            for b, gap in zip(p.boxes, g, strict=True):
                at += gap + b.length
                boxes.append(s[at - b.length + 1 : at + 1] if at < len(s) else "")
            if at >= len(s) or "_".join(boxes) in found:
                continue
            u = v = 0
            for t in seqs:
                if len(t) < total:
                    continue
                hits = [ends_of(w, t, e, p.distance) for w, e in zip(boxes, p.errors, strict=True)]
                cnt = 0
                for i, g in product(hits[0], gaps):
                    place, ok = i, True
                    for x, (b, gap) in enumerate(zip(p.boxes, g, strict=True), 1):
                        place += gap + b.length
                        ok &= place in hits[x]
                    cnt += ok
                u, v = u + (cnt > 0), v + cnt
            found["_".join(boxes)] = u, v
    return [(m, u, v) for m, (u, v) in found.items() if n and p.q <= u / n * 100 <= p.q_max and p.n_min <= v <= p.n_max]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("params", [MotifParams(4, 1, 30), MotifParams(4, 2, 50, q_max=90), MotifParams(4, 1, 30, "edit"), MotifParams(5, 2, 60, "edit"), MotifParams(3, 1, 20, boxes=(Box(0, 2, 3, 0),)), MotifParams(3, 0, 20, boxes=(Box(1, 1, 2, 1), Box(0, 1, 2, 1))), MotifParams(3, 1, 40, "edit", boxes=(Box(0, 1, 3, 1),))])
def test_equals_brute_force(spark, seed, params):
    r = random.Random(seed)
    seqs = ["".join(r.choice("ACG") for _ in range(r.choice([2, 4, 9, 17]))) for _ in range(7)]
    assert listed(extract_motifs(frame(spark, seqs), params)) == brute(seqs, params)


@pytest.mark.parametrize("masked", [0, 1 << 20])
def test_masks_and_pairs_count_alike(spark, monkeypatch, masked):
    monkeypatch.setattr(extract, "MASKED", masked)
    r = random.Random(6)
    seqs = ["".join(r.choice("012") for _ in range(r.choice([3, 9, 200]))) for _ in range(20)]
    params = MotifParams(4, 2, 40, alphabet="USR")
    assert listed(extract_motifs(frame(spark, seqs), params)) == brute(seqs, params)
    given = spark.createDataFrame([("0000",), ("00x0",), ("9999",)], "motif string")
    for seen in (False, True):
        assert {tuple(x) for x in count_occurrences(given, frame(spark, ["0000", "0110", "00100"]), params, seen).collect()} == {("0000", 3, 4), ("00x0", 3, 4)}


@pytest.mark.parametrize("sizes", [{}, {"SLICE": 8, "PIECE": 2, "BLOCK": 2, "COUNTS": 3, "MOST": 5}, {"SLICE": 64, "PAIRS": 16}])
@pytest.mark.parametrize("params", [MotifParams(4, 1, 30), MotifParams(5, 1, 10, q_max=60, n_min=3, n_max=40), MotifParams(2, 1, 0, alphabet="ACGU"), MotifParams(3, 1, 5, alphabet="GCA*")])
def test_packed_words_equal_brute_force(spark, monkeypatch, sizes, params):
    monkeypatch.setattr(extract, "MASKED", 0)
    r = random.Random(8)
    seqs = ["".join(r.choice("ACG") for _ in range(r.choice([1, 4, 9, 70]))) for _ in range(9)] + ["", "A" * 40]
    texts = frame(spark, [*seqs, None]).repartition(3)
    for name, size in sizes.items():
        monkeypatch.setattr(packed, name, size)
    # Steps run in other processes: here with the sizes set, there with those of the file.
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, step, schema: here(df, step, schema))
    got = extract_motifs(texts, params)
    assert "Join" not in got.select("motif", "u", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert listed(got) == brute(seqs, params)


def here(df, step, schema):
    """mapInArrow() in this process."""
    rows = [x for b in step(iter(df.toArrow().to_batches(max_chunksize=7))) for x in b.to_pylist()]
    return df.sparkSession.createDataFrame([tuple(x.values()) for x in rows], schema)


@pytest.mark.parametrize("text", ["ACGTACGA", "ACXTACGA", "AC\u00e9TACGA"])
def test_packed_words_keep_to_sequences(spark, monkeypatch, text):
    """Rows with one seq_id, or with none, are one sequence; symbols outside the alphabet count as they do without packing."""
    monkeypatch.setattr(extract, "MASKED", 0)
    rows = spark.createDataFrame([(1, text), (2, "ACGT"), (None, "CCCC"), (1, "ACGA"), (None, "CCCA"), (3, None), (4, "AC")], "seq_id long, seq string").repartition(4)
    params = MotifParams(4, 1, 0)
    got = {(x.motif, x.u, x.num_seqs, x.v) for x in extract_motifs(rows, params).collect()}
    monkeypatch.setattr(packed, "applies", lambda params: False)
    assert got == {(x.motif, x.u, x.num_seqs, x.v) for x in extract_motifs(rows, params).collect()} and ("CCCC", 1, 6, 2) in got


def test_windows_do_not_depend_on_stretches(spark, monkeypatch):
    r = random.Random(5)
    seqs = frame(spark, ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 2, 3, 7, 8, 9, 30, 200)] + [None])
    boxes = MotifParams(3, 1, 1, boxes=(Box(0, 2, 4, 2), Box(1, 1, 2, 0)))
    rows = lambda: [sorted(map(tuple, df.collect())) for df in (kmer_windows(seqs, 3), edit_contexts(seqs, 3, 1), structured_tuples(seqs, boxes), structured_tuples(seqs, boxes, context=True))]
    whole = []
    for size in (1, 5, 1000):
        monkeypatch.setattr(windows, "STRETCH", size)
        whole.append(rows())
    assert whole[0] == whole[1] == whole[2]
    text = {r.seq_id: r.seq or "" for r in seqs.collect()}
    assert whole[0][0] == sorted((i, j + 2, t[j : j + 3]) for i, t in text.items() for j in range(len(t) - 2))


def test_a_long_sequence(spark):
    """A million symbols in one row."""
    text = "".join(random.Random(1).choices("ACGT", k=1_000_000))
    got = extract_motifs(frame(spark, [text]), MotifParams(5, 0, 0, n_max=10**9)).agg(F.sum("v").alias("v"), F.count("*").alias("n")).first()
    assert (got.v, got.n) == (999_996, 1024)


def test_strategies_agree(spark):
    r = random.Random(4)
    words = spark.createDataFrame([(w,) for w in {"".join(r.choice("ACGT") for _ in range(9)) for _ in range(400)}], "word string")
    motifs = words.withColumnRenamed("word", "motif")
    for e in (1, 2):
        mask, seed = (sorted(map(tuple, hamming_pairs(motifs, words, 9, e, s).collect())) for s in ("mask", "seed"))
        assert mask == seed and len(mask) >= 400


def test_edges(spark):
    params = MotifParams(3, 1, 0, n_min=0)
    assert extract_motifs(frame(spark, []), params).count() == 0
    got = extract_motifs(frame(spark, ["", None, "AC", "ACG", "ACG" * 4000]), MotifParams(3, 0, 0, n_max=10**9)).collect()
    assert {(r.motif, r.u, r.num_seqs) for r in got} == {("ACG", 2, 3), ("CGA", 1, 3), ("GAC", 1, 3)}
    assert extract_motifs(frame(spark, ["ACG" * 4000]), MotifParams(3, 0, 0)).count() == 3
    assert extract_motifs(frame(spark, ["A" * 10_002]), MotifParams(3, 0, 0)).count() == 1
    assert extract_motifs(frame(spark, ["A" * 10_003]), MotifParams(3, 0, 0)).count() == 0
    assert kmer_windows(frame(spark, ["AC"]), 3).count() == 0
    assert count_occurrences(spark.createDataFrame([("AAN",)], "motif string"), frame(spark, ["AAA"]), MotifParams(3, 0, 0)).count() == 0


@pytest.mark.parametrize("bad", [{"e": 3}, {"e": -1}, {"q": 101}, {"q_max": 101}, {"q": 60, "q_max": 50}, {"distance": 2}, {"k": 0}, {"n_min": 3, "n_max": 2}, {"boxes": (Box(2, 1, 3, 0),)}, {"boxes": (Box(1, 2, 3, 3),)}, {"alphabet": ""}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        MotifParams(**({"k": 3, "e": 1, "q": 50} | bad))


def test_quorum_rounds_like_doubles(spark):
    n = F.lit(100)
    at = lambda u, q, q_max: spark.range(1).select(within_quorum(F.lit(u), n, q, q_max).alias("x")).first().x
    assert [at(u, u, 100) for u in (29, 57, 58, 30)] == [False, False, False, True]
    assert [at(u, 0, u) for u in (7, 14, 28, 55, 56, 8)] == [False] * 5 + [True]


@pytest.mark.parametrize(("u", "n", "p", "value"), [(3, 3, 0.333333, 3.7036925926e-02), (3, 3, 1 / 3, 3.7037037037e-02), (5, 20, 0.1, 4.3174495284e-02), (12, 1062, 1 / 1062, 7.8915834781e-10), (4, 9, 1.0, 1), (0, 9, 0.2, 1), (2, 9, 0.0, 0), (1, 100_000, 0.5, 1)])
def test_binomial_tail(spark, u, n, p, value):
    got = spark.createDataFrame([(u, n, p)], "u long, n long, p double").select(binomial_tail(F.col("u"), F.col("n"), F.col("p")).alias("x")).first().x
    assert got == pytest.approx(value, rel=1e-9)


@pytest.mark.parametrize("distance", ["hamming", "edit"])
def test_equal_sequences_are_searched_once(spark, monkeypatch, distance):
    params = MotifParams(3, 1, 1, distance, boxes=(Box(0, 1, 2, 0), Box(1, 2, 2, 1)), alphabet="DNA", n_max=10**9)
    once = {r.motif: (r.u, r.v) for r in extract_motifs(frame(spark, SMALL), params).collect()}
    searched = []
    monkeypatch.setattr(extract, "structured_tuples", lambda texts, *a, **k: searched.append(texts.count()) or structured_tuples(texts, *a, **k))
    many = extract_motifs(frame(spark, SMALL * 40), params).collect()
    assert {r.motif: (r.u, r.v) for r in many} == {m: (40 * u, 40 * v) for m, (u, v) in once.items()}
    assert {r.num_seqs for r in many} == {120} and max(r.first.seq_id for r in many) <= 2
    assert searched == [3, 3]


STRUCTURED = {
    "smotif_ed_three": MotifParams(3, 1, 1, "edit", alphabet="USR", boxes=(Box(0, 1, 2, 0), Box(1, 2, 2, 1)), n_max=10**9),
    "smotif_ed": MotifParams(3, 1, 5, "edit", alphabet="USR", boxes=(Box(1, 2, 3, 1),), n_max=10**9),
    "smotif_hd_three": MotifParams(3, 1, 5, alphabet="USR", boxes=(Box(0, 1, 3, 0), Box(1, 2, 2, 1)), n_max=10**9),
    "errors in every box": MotifParams(3, 2, 10, "edit", alphabet="USR", boxes=(Box(0, 1, 3, 1),)),
}


@pytest.mark.parametrize("slice_", [1 << 21, 12])
@pytest.mark.parametrize("name", STRUCTURED)
def test_marks_equal_brute_force(spark, monkeypatch, name, slice_):
    monkeypatch.setattr(marked, "LEAST", 1)
    monkeypatch.setattr(marked, "SLICE", slice_)
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, step, schema: here(df, step, schema))
    r = random.Random(3)
    seqs = ["".join(r.choice("012") for _ in range(r.choice([2, 5, 9, 17, 40]))) for _ in range(9)]
    seqs += [*seqs[:3], ""]
    got = extract_motifs(frame(spark, [*seqs, None]).repartition(3), STRUCTURED[name])
    assert "Join" not in got.select("motif", "u", "v")._jdf.queryExecution().optimizedPlan().toString()
    want = brute(seqs, STRUCTURED[name])
    assert want and listed(got) == want


def test_sequences_that_all_differ_meet_no_pairs(spark):
    """With many sequences of few symbols no row is a pair of a motif and a sequence, and the counts are those of the joins."""
    params = MotifParams(2, 1, 1, "edit", alphabet="USR", boxes=(Box(0, 1, 2, 1),), n_max=10**9)
    seqs = ["".join(x) for x in product("012", repeat=7)][: marked.LEAST + 200]
    got = extract_motifs(frame(spark, seqs), params).select("motif", "u", "v")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    motifs = spark.createDataFrame([("".join(x[:2]), "".join(x[2:])) for x in product("012", repeat=4)], "b0 string, b1 string")
    joined = {(f"{r.b0}_{r.b1}", r.u, r.v) for r in extract.count_structured(motifs, frame(spark, seqs), params).collect()}
    assert {tuple(x) for x in got.collect()} == joined


def test_marks_are_for_few_symbols(spark, monkeypatch):
    """Symbols outside the alphabet, or too many words, go by joins."""
    monkeypatch.setattr(marked, "LEAST", 1)
    params = MotifParams(2, 1, 1, alphabet="DNA", boxes=(Box(0, 1, 2, 0),))
    for seqs, most in (["ACGTTA", "ACxTTAGA"], marked.MOTIFS), (["ACGTTA", "GGATTAGA"], 16):
        monkeypatch.setattr(marked, "MOTIFS", most)
        got = extract_motifs(frame(spark, seqs), params)
        assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert listed(got) == brute(seqs, params)


def test_pvalues_of_thousands_print_as_in_sql(spark):
    cases = [(1854, 4500, 0.416), (1812, 4500, 0.44), (1854, 4500, 0.396), (1812, 4500, 0.385333), (1824, 4500, 0.425333), (1866, 4500, 0.376), (1884, 4500, 0.417333), (1830, 4500, 0.446667), (7, 9, 0.3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE x AS SELECT *, " + tail_sql("u", "n", "p", None) + " AS pvalue FROM (VALUES " + ", ".join(f"({u}::BIGINT, {n}::BIGINT, {p}::DOUBLE)" for u, n, p in cases) + ") t(u, n, p)")
    want = con.execute(f"SELECT u, n, p, {PRINTED} FROM {printing('x')}").fetchall()
    got = spark.createDataFrame(cases, "u long, n long, p double").select("u", "n", "p", printed_pvalue(binomial_tail(F.col("u"), F.col("n"), F.col("p"))))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_statistics(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(5, 3, 0.5)], "u long, n long, p double").select(binomial_tail(F.col("u"), F.col("n"), F.col("p"))).collect()
    table = [r.log_factorial for r in log_factorials(spark, 6).orderBy("i").collect()]
    assert table == pytest.approx([0, 0, 0.693147180560, 1.791759469228, 3.178053830348, 4.787491742782, 6.579251212010])
    values = {1 / 9: "1.111111112e-1", 0.5: "5.000000000e-1", 0.49999999999999994: "5.000000000e-1", 1.0: "1.000000000", 0.0: "0", 2 / 3: "6.666666667e-1", 0.99999999999: "1.000000000", 9.9999999991e-5: "1.000000000e-4", 1.23e-30: "1.230000000e-30", 1.2300000001e-300: "1.230000001e-300"}
    got = spark.createDataFrame([(v,) for v in values], "p double").select("p", printed_pvalue(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in got} == values
    assert spark.range(1).select(absolute_quorum(7, F.lit(150)).alias("x")).first().x == 11
    assert spark.range(1).select(smile_id(F.lit("GATN_A"), ALPHABETS["DNA"]).alias("x")).first().x == "2034-0"
    assert [tuple(r) for r in gap_structures(spark.range(1), MotifParams(6, 1, 1, boxes=BOXES)).collect()] == [(0, 16, 15), (1, 16, 16), (2, 17, 15), (3, 17, 16)]


def test_background(spark, small, tmp_path):
    bg_seqs = frame(spark, [SMALL[0]] * 3)
    bg_params, fg_params = MotifParams(6, 1, 1), MotifParams(6, 1, 100)
    bg, fg = extract_motifs(bg_seqs, bg_params), extract_motifs(frame(spark, SMALL[1:]), fg_params)
    both = background.compare(fg, bg, 3, 1).cache()
    hit, alone = both.filter("matched").orderBy("first").collect(), both.filter("NOT matched").orderBy("first").collect()
    assert (bg.count(), len(hit), len(alone)) == (14, 10, 45)
    assert [(r.motif, r.u, r.num_seqs, r.v, r.bg_ratio, r.bg_v, r.pvalue) for r in hit[:3]] == [("GCTATA", 2, 2, 2, 1.0, 3, 1.0), ("CTATAG", 2, 2, 4, 1.0, 3, 1.0), ("TAGCTA", 2, 2, 5, 1.0, 9, 1.0)]
    assert [(r.motif, r.u, r.v) for r in alone[:3]] == [("GATAGG", 2, 6), ("ATAGGA", 2, 6), ("TAGGAT", 2, 6)] and alone[0].pvalue == pytest.approx(1 / 9)
    found = background.research(background.unmatched(fg, bg), bg_seqs, bg_params)
    rows = found.orderBy("first").collect()
    assert len(rows) == 12 and [(r.motif, r.fg_u, r.fg_n, r.fg_v, r.bg_ratio, r.bg_v, r.pvalue) for r in rows[:3]] == [("GATAGG", 2, 2, 6, 1.0, 3, 1.0), ("TGCTAT", 2, 2, 2, 1.0, 3, 1.0), ("TATAGT", 2, 2, 2, 1.0, 3, 1.0)]
    with pytest.raises(ValueError):
        background.compare(fg, bg, 3, 0)
    with pytest.raises(ValueError):
        background.research(fg.withColumn("motif", F.lit("AC")), bg_seqs, bg_params)

    sinks.write_result(bg, bg_params, bg_seqs, str(tmp_path / "bg"))
    again, n, q = read_result(spark, str(tmp_path / "bg"))
    assert (n, q, again.count()) == (3, 1, 14)
    sinks.write_background(both, 14, fg_params, small, *(str(tmp_path / x) for x in ("fg", "un", "s", "us")))
    said = lambda x: next((tmp_path / x).glob("part*")).read_text()
    assert "GATAGG 2 2 1.000000 6 0 0 1.111111112e-1\n" in said("fg")
    end = ["", "#A total of 14 background motifs were read.", "#A total of 55 valid motifs were extracted:"]
    left = ["#  45 of them were not matched with any background motif.", "", ""]
    assert said("fg").split("\n")[-7:] == [*end, "#  10 of them were matched with background motifs", *left] and said("un").split("\n")[-6:] == [*end, *left]
    assert "Nb models: 55\n" in said("s") and "Nb models: 45\n" in said("us")
    un = read_motifs(spark, str(tmp_path / "un"))
    assert [r.motif for r in un.orderBy("ordinal").limit(3).collect()] == ["GATAGG", "ATAGGA", "TAGGAT"] and un.count() == 45
    sinks.write_research(background.research(un, bg_seqs, bg_params), str(tmp_path / "re"), bg_params, bg_seqs)
    assert "GATAGG 2 2 1.000000 6 1.000000 3 1.000000000\n" in said("re")


def test_sinks(spark, small):
    found = extract_motifs(small, MotifParams(6, 0, 100))
    assert sinks.native_lines(found).first().value == "TAGCTA 3 3 1.000000 4"
    assert sinks.smile_lines(found, ALPHABETS["DNA"]).first().value == "TAGCTA 302130 3\t4".replace("302130", "".join(str(ALPHABETS["DNA"].index(c)) for c in "TAGCTA"))
    stats = dataset_stats(small, 67).first()
    head = sinks.smile_header(MotifParams(6, 1, 67, boxes=SHORT_BOX), stats)
    assert head == ["%%% 2 3/3 151 10 10 2 6 6 1 2 4 4 4 1 alphabet ACGTN$".ljust(79), " " * 79, " " * 79, "=" * 79]
    assert sinks.smile_header(MotifParams(6, 1, 67), stats)[0] == "%%% 1 3/3 151 6 6 1 alphabet ACGTN$".ljust(79)
    assert sinks.smile_header(MotifParams(3, 0, 50, alphabet="USR"), stats) == ["%%% 1 3/3 151 3 3 0 alphabet 0123456789$" + "=" * 79]
    assert [len(x) for x in sinks.smile_header(MotifParams(3, 0, 50, alphabet="PROT"), stats)] == [159, 79, 79]
    run = sinks.Run("a.fa", "o", "b.txt", "now", 4, 2.25)
    lines = sinks.native_header(MotifParams(6, 0, 10, q_max=90, n_min=2, n_max=7, boxes=SHORT_BOX), 3, run)
    rule = "#" * 36
    head = ["# Rundate: now", "# Input file: a.fa", "# Output file: o", "# For 3 input sequences"]
    assert lines[0] == lines[-2] == rule and lines[2:6] == head and lines[-1] == ""
    assert lines[6:-2] == ["#     d = 0", "#     q = 10", "#     Q = 90", "#     n = 2", "#     N = 7", "# Number of boxes: 2", "#     l0 = 6", "#     e0 = 0", "#     g1 = [2,4]", "#     l1 = 4", "#     e1 = 1", "# Boxes input file: b.txt", "# Run on 4 proc(s) in 2.250000 secs"]
    assert len(sinks.native_header(MotifParams(6, 0, 10, "edit"), 3, run)) == 13 and lines[5].split()[2] == "3" and lines[7].split()[3] == "10"


def test_a_structured_report_is_whole(spark, small, tmp_path):
    params = MotifParams(6, 1, 1, boxes=BOXES)
    sinks.write_result(extract_motifs(small, params), params, small, str(tmp_path / "n"), str(tmp_path / "s"), sinks.Run(began=0.0))
    native, smile = (next((tmp_path / x).glob("part*")).read_text().split("\n") for x in "ns")
    assert native[-4:] == ["", "#A total of 132 valid structured motifs were extracted.", "", ""] and "GATAGG_TCCTAC_CGATTAT 1 3 0.333333 1" in native
    assert smile[4] == "GATAGG_TCCTAC_CGATTAT 203022-311301-1203303 1\t1" and smile[-3] == "Nb models: 132" and len(smile) == 4 + 132 + 3


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_fasta(spark, tmp_path):
    got = read_fasta(spark, write(tmp_path / "a.fa", ">a > x\nacg\nTTN\n>b\n>c\nGG>d\nAA")).orderBy("seq_id").collect()
    assert [(r.seq_id, r.header, r.seq) for r in got] == [(0, "a > x", "ACGTTN"), (1, "c", "GG"), (2, "d", "AA")]
    assert read_fasta(spark, write(tmp_path / "empty.fa", "")).count() == 0
    for name, text in (("no", "ACG\n"), ("cr", ">a\r\nAC\r\n"), ("space", ">a\nA C\n"), ("foreign", ">a\nAXC\n"), ("blank", ">a\n\nACG\n")):
        with pytest.raises(PySparkException):
            read_fasta(spark, write(tmp_path / f"{name}.fa", text)).collect()
    assert read_fasta(spark, write(tmp_path / "p.fa", ">a\nmkx*\n"), "PROT").first().seq == "MKX*"
    assert read_fasta(spark, write(tmp_path / "e.fa", ">a\n\n>b\nA\n")).count() == 1
    with pytest.raises(PySparkException):
        validated(frame(spark, ["ACX"]), "DNA").collect()


def test_boxes():
    assert parse_boxes("2\n16\n17\n6\n1\n15\n16\n7\n2\n") == BOXES
    with pytest.raises(ValueError):
        parse_boxes("2\n16 17")


def test_simulation(spark):
    r = random.Random(8)
    seqs = frame(spark, ["".join(r.choice("ACGT") for _ in range(60)) for _ in range(60)])
    out, motifs = simulate_single(seqs, 8, 0, 1, 20, 10)
    grown = out.join(seqs.withColumnRenamed("seq", "was"), "seq_id").select((F.length("seq") - F.length("was")).alias("n")).collect()
    assert sum(x.n for x in grown) == 10 * 12 * 8 and max(x.n for x in grown) <= 10 * 8
    assert simulate_single(seqs.limit(0), 8, 0, 1, 20, 10)[0].count() == 0
    assert accuracy(motifs, extract_motifs(out, MotifParams(8, 1, 20))).first().accuracy > 0.8
    boxes = (Box(2, 3, 5, 0),)
    out, motifs = simulate_structured(seqs, 6, 0, boxes, 20, 5)
    assert accuracy(motifs, extract_motifs(out, MotifParams(6, 0, 20, boxes=boxes))).first().accuracy == 1.0
