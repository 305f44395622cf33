"""The registered queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.stats import binomial_tail, log_factorials
from seqloom.functions.words import smile_id
from seqloom.operators import background
from seqloom.operators.extract import dataset_stats, extract_motifs
from seqloom.operators.simulate import accuracy, simulate_single, simulate_structured
from seqloom.operators.windows import gap_structures, kmer_windows
from seqloom.params import ALPHABETS, Box, MotifParams
from seqloom.sources import sinks
from seqloom.sources.fasta import read_fasta, validated
from seqloom.sources.results import read_boxes, read_motifs, read_result
from seqloom.sources.sinks import Run
from seqloom.sources.views import documents_view, events_view, lineitem_view, orders_view
from seqloom.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
USR = "USR"
HD1 = MotifParams(6, 1, 14, alphabet=USR)
HD2 = MotifParams(5, 2, 30, alphabet=USR, n_max=10**9)
ED1 = MotifParams(5, 1, 5, "edit", alphabet=USR)
PROT = MotifParams(8, 1, 2, alphabet="PROT", n_max=10**9)
BAND = MotifParams(5, 1, 20, alphabet=USR, q_max=60, n_min=40, n_max=120)
SHORT = MotifParams(10, 2, 0, alphabet=USR, n_min=2)
S_HD = MotifParams(4, 1, 5, alphabet=USR, boxes=(Box(1, 2, 3, 0),))
S_ED = MotifParams(3, 1, 5, "edit", alphabet=USR, boxes=(Box(1, 2, 3, 1),), n_max=10**9)
S_HD3 = MotifParams(3, 1, 5, alphabet=USR, boxes=(Box(0, 1, 3, 0), Box(1, 2, 2, 1)), n_max=10**9)
S_ED3 = MotifParams(3, 1, 1, "edit", alphabet=USR, boxes=(Box(0, 1, 2, 0), Box(1, 2, 2, 1)), n_max=10**9)
BG = MotifParams(5, 1, 40, alphabet=USR, n_max=10**9)
FG = MotifParams(5, 1, 43, alphabet=USR, n_max=10**9)
LOW = MotifParams(5, 1, 38, alphabet=USR, n_max=10**9)
S_BG = MotifParams(3, 1, 30, alphabet=USR, boxes=(Box(1, 2, 2, 0),), n_max=10**9)
S_FG = MotifParams(3, 1, 40, alphabet=USR, boxes=(Box(1, 2, 2, 0),), n_max=10**9)
DNA1 = MotifParams(6, 1, 14)
S_DNA = MotifParams(4, 1, 25, boxes=(Box(1, 2, 3, 0),))
SIM = {"k": 8, "e_min": 0, "e_max": 1, "q": 7, "count": 20, "seed": 1}
SIM_BOXES = (Box(2, 3, 6, 0),)
S_SIM = {"k": 8, "e": 0, "boxes": SIM_BOXES, "q": 7, "count": 10, "seed": 1}
BOXES_TEXT = "2\n16\n17\n6\n1\n15\n16\n7\n2\n"
#: Fixed, so that a report can be compared whole.
RUN = Run("in.fa", "out", "boxes.txt", "Thu Jan  1 00:00:00 1970", 8, 1.5)


def counted(df: DataFrame) -> DataFrame:
    return df.select("motif", "u", "num_seqs", "ratio", "v")


def motifs_of(view: Query, params: MotifParams) -> Query:
    return lambda spark, sf_dir: counted(extract_motifs(view(spark, sf_dir), params))


def seq_build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_view(spark, sf_dir)


def seq_build_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_view(spark, sf_dir)


def kmer_windows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_windows(orders_view(spark, sf_dir), 3)


def kmer_exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_motifs(documents_view(spark, sf_dir), MotifParams(8, 0, 2, alphabet="PROT", n_max=10**9)).select("motif", "u", "v")


def motif_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_motifs(events_view(spark, sf_dir), HD1).select("motif", F.col("first.seq_id").alias("seq_id"), F.col("first.end_pos").alias("end_pos"))


def gap_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_structures(orders_view(spark, sf_dir), MotifParams(6, 1, 1, boxes=(Box(16, 17, 6, 1), Box(15, 16, 7, 2))))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """number, value: the lines of a text file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n")).alias("number", "value"))


def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' sequences through FASTA files: two lines each, one of them in lower case, and an empty record after each."""
    half = (F.length("seq") / 2).cast("int")
    record = F.concat(F.lit(">user "), F.col("seq_id").cast("string"), F.lit(" > x\n"), F.lower(F.substring(F.col("seq"), F.lit(1), half)), F.lit("\n"), F.substring(F.col("seq"), half + 1, F.length("seq")), F.lit("\n>empty"))
    path = new_path(spark, "fasta")
    dna(spark, sf_dir).orderBy("seq_id").select(record.alias("value")).write.text(path)
    return validated(read_fasta(spark, path, "DNA"), "DNA")


def boxes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "boxes")
    spark.createDataFrame([(BOXES_TEXT.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    boxes = read_boxes(spark, path)
    return spark.createDataFrame([(i, b.gap_min, b.gap_max, b.length, b.errors) for i, b in enumerate(boxes)], "gap int, gap_min int, gap_max int, length int, errors int")


def report(write: Callable[..., None]) -> Query:
    """The lines of what write(spark, sf_dir, *paths) puts to one path or to several, then with the file's number."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = [new_path(spark, "report") for _ in range(write.__code__.co_argcount - 2)]
        write(spark, sf_dir, *paths)
        parts = [lines_of(spark, p).select(F.lit(i).alias("file"), "number", "value") for i, p in enumerate(paths)]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out if len(parts) > 1 else out.drop("file")

    return query


def native_report(spark: SparkSession, sf_dir: str, path: str) -> None:
    seqs = dna(spark, sf_dir)
    sinks.write_result(extract_motifs(seqs, DNA1), DNA1, seqs, path, run=RUN)


def smile_report(spark: SparkSession, sf_dir: str, path: str) -> None:
    seqs = dna(spark, sf_dir)
    sinks.write_result(extract_motifs(seqs, DNA1), DNA1, seqs, smile_path=path, run=RUN)


def structured_report(spark: SparkSession, sf_dir: str, path: str, smile_path: str) -> None:
    seqs = dna(spark, sf_dir)
    sinks.write_result(extract_motifs(seqs, S_DNA), S_DNA, seqs, path, smile_path, RUN)


def background_files(spark: SparkSession, sf_dir: str, bg_params: MotifParams, params: MotifParams, *paths: str) -> None:
    """Background to a file; comparison with what is read from it to four."""
    bg, fg = halves(spark, sf_dir)
    at = new_path(spark, "background")
    sinks.write_result(extract_motifs(bg, bg_params), bg_params, bg, at)
    read, n, q = read_result(spark, at)
    sinks.write_background(background.compare(extract_motifs(fg, params), read, n, q), read.count(), params, fg, *paths, run=RUN)


def background_report(spark: SparkSession, sf_dir: str, path: str, unmatched: str, smile: str, unmatched_smile: str) -> None:
    background_files(spark, sf_dir, BG, FG, path, unmatched, smile, unmatched_smile)


def structured_background_report(spark: SparkSession, sf_dir: str, path: str, unmatched: str, smile: str, unmatched_smile: str) -> None:
    background_files(spark, sf_dir, S_BG, S_FG, path, unmatched, smile, unmatched_smile)


def result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background result through a file, with what its header says of it."""
    bg, _ = halves(spark, sf_dir)
    path = new_path(spark, "background")
    sinks.write_result(extract_motifs(bg, BG), BG, bg, path)
    read, n, q = read_result(spark, path)
    return read.select("motif", "u", "num_seqs", "ratio", "v", F.lit(n).cast("long").alias("header_n"), F.lit(float(q)).alias("header_q"))


def unmatched_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of unmatched motifs through its file."""
    paths = [new_path(spark, "report") for _ in range(2)]
    background_files(spark, sf_dir, BG, FG, *paths)
    return read_motifs(spark, paths[1]).select("motif", "u", "num_seqs", "ratio", "v")


def research_report(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Unmatched motifs, read from their file, searched in the background's sequences."""
    paths = [new_path(spark, "report") for _ in range(2)]
    background_files(spark, sf_dir, BG, FG, *paths)
    bg, _ = halves(spark, sf_dir)
    sinks.write_research(background.research(read_motifs(spark, paths[1]), bg, LOW), path, LOW, bg, RUN)


def factorials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_factorials(spark, 200).select("i", F.round("log_factorial", 9).alias("log_factorial"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(background, foreground): users with even and with odd ids."""
    seqs = events_view(spark, sf_dir)
    return seqs.filter("seq_id % 2 = 0"), seqs.filter("seq_id % 2 = 1")


def bg_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    bg, fg = halves(spark, sf_dir)
    n = dataset_stats(bg, BG.q).select("num_seqs").scalar()
    got = background.matched(extract_motifs(fg, FG), extract_motifs(bg, BG), n, BG.q)
    return got.select("motif", "u", "num_seqs", "v", "bg_ratio", "bg_v", F.round("pvalue", 9).alias("pvalue"))


def bg_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    bg, fg = halves(spark, sf_dir)
    n = dataset_stats(bg, BG.q).select("num_seqs").scalar()
    got = background.compare(extract_motifs(fg, FG), extract_motifs(bg, BG), n, BG.q).filter("NOT matched")
    return got.select("motif", "u", "num_seqs", "v", F.round("pvalue", 9).alias("pvalue"))


def bg_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    bg, fg = halves(spark, sf_dir)
    alone = background.unmatched(counted(extract_motifs(fg, FG)), extract_motifs(bg, BG))
    got = background.research(alone, bg, LOW)
    return got.select("motif", "fg_u", "fg_n", "fg_v", "bg_ratio", "bg_v", F.round("pvalue", 9).alias("pvalue"))


def binomial_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("x"), (F.col("n_regionkey") * 20 + 30).cast("long").alias("n"), ((F.col("n_regionkey") + 1) / F.lit(10.0)).alias("p"))
    return rows.select("x", "n", "p", F.round(binomial_tail(F.col("x"), F.col("n"), F.col("p")), 9).alias("tail"))


def smile_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_motifs(documents_view(spark, sf_dir), MotifParams(8, 0, 2, alphabet="PROT", n_max=10**9)).select("motif", smile_id(F.col("motif"), ALPHABETS["PROT"]).alias("id"))


def native_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.native_lines(extract_motifs(events_view(spark, sf_dir), HD1))


def smile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.smile_lines(extract_motifs(events_view(spark, sf_dir), HD1), ALPHABETS[USR])


def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {"events": events_view, "lineitem": lineitem_view, "orders": orders_view, "documents": documents_view}
    parts = [dataset_stats(v(spark, sf_dir), 12).select(F.lit(k).alias("view"), "num_seqs", "total_length", "quorum") for k, v in views.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' sequences with digits as letters."""
    return events_view(spark, sf_dir).withColumn("seq", F.translate("seq", "01234", "ACGTN"))


def simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate_single(dna(spark, sf_dir), **SIM)[0]


def simulation_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate_structured(dna(spark, sf_dir), **S_SIM)[0]


def simulated_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs, motifs = simulate_single(dna(spark, sf_dir), **SIM)
    return accuracy(motifs, extract_motifs(seqs, MotifParams(8, 1, 7)))


def simulated_structured_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs, motifs = simulate_structured(dna(spark, sf_dir), **S_SIM)
    return accuracy(motifs, extract_motifs(seqs, MotifParams(8, 0, 7, boxes=SIM_BOXES)))


QUERIES: dict[str, Query] = {
    "seq_build_events": seq_build_events,
    "seq_build_orders": seq_build_orders,
    "kmer_windows": kmer_windows_orders,
    "kmer_exact_counts": kmer_exact_counts,
    "motif_hd_e1": motifs_of(events_view, HD1),
    "motif_hd_e2": motifs_of(lineitem_view, HD2),
    "motif_ed_e1": motifs_of(orders_view, ED1),
    "motif_hd_prot": motifs_of(documents_view, PROT),
    "motif_quorum_band": motifs_of(events_view, BAND),
    "motif_short_rule": motifs_of(orders_view, SHORT),
    "motif_first_seen": motif_first_seen,
    "gap_structs": gap_structs,
    "smotif_hd": motifs_of(events_view, S_HD),
    "smotif_ed": motifs_of(orders_view, S_ED),
    "smotif_hd_three": motifs_of(events_view, S_HD3),
    "smotif_ed_three": motifs_of(orders_view, S_ED3),
    "bg_matched": bg_matched,
    "bg_unmatched": bg_unmatched,
    "bg_research": bg_research,
    "binomial_tail": binomial_tails,
    "smile_encode": smile_encode,
    "native_lines": native_lines,
    "smile_lines": smile_lines,
    "dataset_stats": dataset_statistics,
    "log_factorials": factorials,
    "fasta_scan": fasta_scan,
    "boxes_scan": boxes_scan,
    "result_scan": result_scan,
    "unmatched_scan": unmatched_scan,
    "native_report": report(native_report),
    "smile_report": report(smile_report),
    "structured_report": report(structured_report),
    "background_report": report(background_report),
    "structured_background_report": report(structured_background_report),
    "research_report": report(research_report),
    "simulation": simulation,
    "simulation_structured": simulation_structured,
    "accuracy": simulated_accuracy,
    "accuracy_structured": simulated_structured_accuracy,
}

EVENTS = "SELECT user_id AS seq_id, string_agg(CASE event_type WHEN 'click' THEN '0' WHEN 'error' THEN '1' WHEN 'purchase' THEN '2' WHEN 'signup' THEN '3' WHEN 'view' THEN '4' END, '' ORDER BY ts, event_id) AS seq FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1"
DNA = f"SELECT seq_id, translate(seq, '01234', 'ACGTN') AS seq FROM ({EVENTS})"
LINEITEM = "SELECT l_suppkey AS seq_id, string_agg(CASE l_returnflag || l_linestatus WHEN 'AF' THEN '0' WHEN 'AO' THEN '1' WHEN 'NF' THEN '2' WHEN 'NO' THEN '3' WHEN 'RF' THEN '4' WHEN 'RO' THEN '5' END, '' ORDER BY l_shipdate, l_orderkey, l_linenumber) AS seq FROM lineitem GROUP BY 1"
ORDERS = "SELECT o_custkey AS seq_id, string_agg(o_orderpriority[1], '' ORDER BY o_orderdate, o_orderkey) AS seq FROM orders GROUP BY 1"
DOCUMENTS = "SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z*]', '', 'g')) AS seq FROM documents WHERE regexp_matches(text, '[A-Za-z*]')"


def near_sql(left: str, right: str, k: int, e: int) -> str:
    """Pairs (motif, word) of the relations left and right (word) that differ in e places at most; by masks for one error in long words."""
    if e == 1 and k > 6:
        masks = ", ".join(f"word[:{i}] || '.' || word[{i + 2}:]" for i in range(k))
        made = lambda r: f"(SELECT word, unnest([{masks}]) AS mask FROM {r})"
        return f"SELECT DISTINCT a.word AS motif, b.word FROM {made(left)} a JOIN {made(right)} b USING (mask)"
    return f"SELECT a.word AS motif, b.word FROM {left} a JOIN {right} b ON {'a.word = b.word' if e == 0 else f'hamming(a.word, b.word) <= {e}'}"


def hamming_ctes(name: str, seqs: str, p: MotifParams) -> str:
    """CTEs name_w (windows), name_f (motif, first) and name (motif, u, num_seqs, ratio, v) over the relation seqs."""
    return f"""
      {name}_w AS (SELECT seq_id, e - 1 AS end_pos, substr(seq, e - {p.k} + 1, {p.k}) AS word FROM {seqs}, unnest(range({p.k}, length(seq) + 1)) t(e)),
      {name}_f AS (SELECT word AS motif, min(struct_pack(seq_id := seq_id, end_pos := end_pos, struct_id := 0)) AS first FROM {name}_w GROUP BY 1),
      {name}_c AS (SELECT word, seq_id, count(*) AS cnt FROM {name}_w GROUP BY 1, 2),
      {name}_d AS (SELECT DISTINCT word FROM {name}_c),
      {name}_p AS ({near_sql(f"{name}_d", f"{name}_d", p.k, p.e)}),
      {name}_s AS (SELECT motif, seq_id, sum(cnt) AS cnt FROM {name}_p JOIN {name}_c USING (word) GROUP BY 1, 2),
      {name}_a AS (SELECT motif, count(*) AS u, sum(cnt)::BIGINT AS v FROM {name}_s GROUP BY 1),
      {kept(name, seqs, p)}"""


def kept(name: str, seqs: str, p: MotifParams) -> str:
    """The CTE name: thresholds over name_a."""
    return f"""{name} AS (SELECT motif, u, n AS num_seqs, u::DOUBLE / n AS ratio, v FROM {name}_a, (SELECT count(*) AS n FROM {seqs} WHERE length(seq) > 0)
        WHERE u::DOUBLE / n * 100 >= {p.q} AND u::DOUBLE / n * 100 <= {p.q_max} AND v BETWEEN {p.n_min} AND {p.n_max})"""


def hamming_sql(view: str, p: MotifParams, select: str = "SELECT * FROM m") -> str:
    return f"WITH seqs AS ({view}), {hamming_ctes('m', 'seqs', p)} {select}"


def edit_sql(view: str, p: MotifParams) -> str:
    return f"""WITH seqs AS ({view}),
      d AS (SELECT DISTINCT substr(seq, e - {p.k} + 1, {p.k}) AS motif FROM seqs, unnest(range({p.k}, length(seq) + 1)) t(e)),
      w AS (SELECT seq_id, e AS end_pos, substr(seq, e - l + 1, l) AS word FROM seqs, unnest(range({p.k - p.e}, length(seq) + 1)) t(e), unnest(range({p.k - p.e}, {p.k + p.e + 1})) s(l) WHERE length(seq) >= {p.k} AND e >= l),
      x AS (SELECT DISTINCT word FROM w),
      p AS (SELECT motif, word FROM d JOIN x ON levenshtein(motif, word) <= {p.e}),
      h AS (SELECT DISTINCT motif, seq_id, end_pos FROM p JOIN w USING (word)),
      m_a AS (SELECT motif, count(DISTINCT seq_id) AS u, count(*) AS v FROM h GROUP BY 1),
      {kept("m", "seqs", p)} SELECT * FROM m"""


def tuples_sql(seqs: str, p: MotifParams) -> str:
    """seq_id, end_pos, struct_id, b0, b1, ... of all places where all boxes end within the sequence."""
    at, struct, words, gaps = "e", "0", [f"substr(seq, e - {p.k} + 1, {p.k}) AS b0"], []
    for i, b in enumerate(p.boxes):
        at = f"{at} + g{i} + {b.length}"
        words.append(f"substr(seq, {at} - {b.length} + 1, {b.length}) AS b{i + 1}")
        gaps.append(f"unnest(range({b.gap_min}, {b.gap_max + 1})) y{i}(g{i})")
        struct = f"({struct}) * {b.gap_max - b.gap_min + 1} + g{i} - {b.gap_min}"
    return f"""SELECT seq_id, e - 1 AS end_pos, {struct} AS struct_id, {", ".join(words)} FROM {seqs}, unnest(range({p.k}, length(seq) + 1)) x(e), {", ".join(gaps)}
            WHERE length(seq) >= {p.total_length} AND {at} <= length(seq)"""


def structured_ctes(name: str, seqs: str, p: MotifParams) -> str:
    """As hamming_ctes(), for boxes and Hamming distance; name_w has the tuples."""
    boxes = [f"b{i}" for i in range(len(p.lengths))]
    listed, motif = ", ".join(boxes), " || '_' || ".join(boxes)
    rest = [f"c.{b} = d.{b}" if e == 0 else f"hamming(c.{b}, d.{b}) <= {e}" for b, e in list(zip(boxes, p.errors, strict=True))[1:]]
    return f"""
      {name}_w AS ({tuples_sql(seqs, p)}),
      {name}_f AS (SELECT {motif} AS motif, min(struct_pack(seq_id := seq_id, end_pos := end_pos, struct_id := struct_id)) AS first FROM {name}_w GROUP BY 1),
      {name}_c AS (SELECT {listed}, seq_id, count(*) AS cnt FROM {name}_w GROUP BY ALL),
      {name}_d AS (SELECT DISTINCT {listed} FROM {name}_w),
      {name}_z AS (SELECT DISTINCT b0 AS word FROM {name}_d),
      {name}_q AS ({near_sql(f"{name}_z", f"{name}_z", p.k, p.e)}),
      {name}_s AS (SELECT {", ".join(f"d.{b}" for b in boxes)}, c.seq_id, sum(cnt) AS cnt FROM {name}_d d JOIN {name}_q q ON q.motif = d.b0 JOIN {name}_c c ON c.b0 = q.word AND {" AND ".join(rest)} GROUP BY ALL),
      {name}_a AS (SELECT {motif} AS motif, count(*) AS u, sum(cnt)::BIGINT AS v FROM {name}_s GROUP BY 1),
      {kept(name, seqs, p)}"""


def structured_hamming_sql(view: str, p: MotifParams, select: str = "SELECT * FROM m") -> str:
    return f"WITH seqs AS ({view}), {structured_ctes('m', 'seqs', p)} {select}"


def structured_edit_sql(view: str, p: MotifParams) -> str:
    boxes = [f"b{i}" for i in range(len(p.lengths))]
    ends = lambda i, k, e: f"""h{i}_d AS (SELECT DISTINCT b{i} AS motif FROM d),
      h{i}_w AS (SELECT DISTINCT seq_id, e, substr(seq, e - l + 1, l) AS word FROM seqs, unnest(range({max(1, k - e)}, length(seq) + 1)) t(e), unnest(range({max(1, k - e)}, {k + e + 1})) s(l) WHERE length(seq) >= {p.total_length} AND e >= l),
      h{i}_p AS (SELECT motif, word FROM h{i}_d JOIN (SELECT DISTINCT word FROM h{i}_w) ON levenshtein(motif, word) <= {e}),
      h{i} AS (SELECT DISTINCT motif, seq_id, e FROM h{i}_p JOIN h{i}_w USING (word))"""  # noqa: E731
    joins, at = "", "h0.e"
    for i, b in enumerate(p.boxes):
        at = f"{at} + g{i} + {b.length}"
        joins += f" CROSS JOIN unnest(range({b.gap_min}, {b.gap_max + 1})) y{i}(g{i}) JOIN h{i + 1} ON h{i + 1}.motif = d.b{i + 1} AND h{i + 1}.seq_id = h0.seq_id AND h{i + 1}.e = {at}"
    return f"""WITH seqs AS ({view}),
      d AS (SELECT DISTINCT {", ".join(boxes)} FROM ({tuples_sql("seqs", p)})),
      {", ".join(ends(i, k, e) for i, (k, e) in enumerate(zip(p.lengths, p.errors, strict=True)))},
      s AS (SELECT {", ".join(f"d.{b}" for b in boxes)}, h0.seq_id, count(*) AS cnt FROM d JOIN h0 ON h0.motif = d.b0{joins} GROUP BY ALL),
      m_a AS (SELECT {" || '_' || ".join(boxes)} AS motif, count(*) AS u, sum(cnt)::BIGINT AS v FROM s GROUP BY 1),
      {kept("m", "seqs", p)} SELECT * FROM m"""


NATIVE = "printf('%s %d %d %.6f %d', motif, u, num_seqs, ratio, v)"
TAIL = "(regexp_extract(said, 'e(.*)', 1)::INTEGER + (up >= 10000000000)::INTEGER)"
#: The p-value of a relation with pvalue, said and up, as reports print it.
PRINTED = f"""CASE WHEN pvalue = 0 THEN '0' ELSE (CASE WHEN up >= 10000000000 THEN '1.000000000' ELSE substr(up::VARCHAR, 1, 1) || '.' || substr(up::VARCHAR, 2, 9) END) || CASE WHEN {TAIL} <> 0 THEN 'e' || {TAIL} ELSE '' END END"""


def printing(relation: str) -> str:
    """The relation with said and up, for PRINTED."""
    return f"(SELECT *, (replace(said[1:14], '.', '')::BIGINT + 999) // 1000 AS up FROM (SELECT *, printf('%.12e', pvalue) AS said FROM {relation}))"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def file_sql(header: list[str], body: str, trailer: list[str], n: str = "n") -> str:
    """number, value of a report: header, body (value, first) in its order, trailer. Each line of header and trailer is an SQL expression."""
    lines = lambda part, of: " UNION ALL ".join(f"SELECT {part} AS part, {i} AS i, {x} AS value" for i, x in enumerate(of))
    return f"""SELECT (row_number() OVER (ORDER BY part, i) - 1)::INTEGER AS number, value FROM ({lines(0, header)}
      UNION ALL SELECT 1, row_number() OVER (ORDER BY first), value FROM ({body}) UNION ALL {lines(2, trailer)})"""


def native_header_sql(p: MotifParams, seqs: str) -> list[str]:
    head = sinks.native_header(p, 0, RUN)
    return [literal(x) if i != 5 else f"'# For ' || (SELECT count(*) FROM {seqs} WHERE length(seq) > 0) || ' input sequences'" for i, x in enumerate(head)]


def smile_header_sql(p: MotifParams, seqs: str) -> list[str]:
    from pyspark.sql import Row

    head = sinks.smile_header(p, Row(quorum="@", num_seqs="@", total_length="@"))
    before, after = head[0].rstrip().split("@/@ @")
    stats = f"(SELECT ceil({p.q} * count(*) / 100.0)::BIGINT || '/' || count(*) || ' ' || sum(length(seq))::BIGINT FROM {seqs} WHERE length(seq) > 0)"
    said = f"{literal(before)} || {stats} || {literal(after)}"
    width = {"DNA": 79, "PROT": 159}.get(p.alphabet)
    return [f"rpad({said}, greatest({width}, length({said}))::INTEGER, ' ')" if width else said, *map(literal, head[1:])]


def native_file_sql(name: str, seqs: str, p: MotifParams) -> str:
    word = "structured " if p.boxes else ""
    return file_sql(native_header_sql(p, seqs), f"SELECT {NATIVE} AS value, first FROM {name} JOIN {name}_f USING (motif)", ["''", f"'#A total of ' || (SELECT count(*) FROM {name}) || ' valid {word}motifs were extracted.'", "''"])


def smile_file_sql(header: list[str], rows: str, symbols: str) -> str:
    """rows: motif, u, v, first."""
    code = f"translate(motif, '{symbols}_', '{''.join(chr(48 + i) for i in range(len(symbols)))}-')"
    return file_sql(header, f"SELECT motif || ' ' || {code} || ' ' || u || chr(9) || v AS value, first FROM ({rows})", [f"'Nb models: ' || (SELECT count(*) FROM ({rows}))", f"'User time: {RUN.seconds:.6f} sec.'"])


def several(files: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS file, number, value FROM ({f})" for i, f in enumerate(files))


def background_sql(bg: str, fg: str, p_bg: MotifParams, p: MotifParams) -> str:
    """The four files of a comparison, from the CTEs of both halves (b and f)."""
    total, lines = "(SELECT count(*) FROM x)", native_header_sql(p, "fs")
    read = ["''", "'#A total of ' || (SELECT count(*) FROM b) || ' background motifs were read.'", f"'#A total of ' || {total} || ' valid motifs were extracted:'"]
    left = "'#  ' || (SELECT count(*) FROM x WHERE NOT matched) || ' of them were not matched with any background motif.'"
    found = "'#  ' || (SELECT count(*) FROM x WHERE matched) || ' of them were matched with background motifs'"
    bg_part = "CASE WHEN matched THEN printf('%.6f %d', bg_ratio, bg_v) ELSE '0 0' END"
    files = [
        file_sql(lines, f"SELECT {NATIVE} || ' ' || {bg_part} || ' ' || {PRINTED} AS value, first FROM {printing('x')}", [*read, found, left, "''"]),
        file_sql(lines, f"SELECT {NATIVE} AS value, first FROM x WHERE NOT matched", [*read, left, "''"]),
        smile_file_sql(smile_header_sql(p, "fs"), "SELECT * FROM x", p.symbols),
        smile_file_sql(smile_header_sql(p, "fs"), "SELECT * FROM x WHERE NOT matched", p.symbols),
    ]
    share = "CASE WHEN b.motif IS NULL THEN k.p ELSE round(b.ratio, 6) END"
    return f"""WITH seqs AS ({EVENTS}), fs AS (SELECT * FROM seqs WHERE seq_id % 2 = 1), bs AS (SELECT * FROM seqs WHERE seq_id % 2 = 0), {fg}, {bg},
      k AS (SELECT {p_bg.q}::DOUBLE / count(*) AS p FROM bs),
      x AS MATERIALIZED (SELECT f.*, f_f.first, b.motif IS NOT NULL AS matched, round(b.ratio, 6) AS bg_ratio, b.v AS bg_v, {tail_sql('f.u', 'f.num_seqs', share, None)} AS pvalue FROM f JOIN f_f USING (motif) LEFT JOIN b ON b.motif = f.motif, k)
      {several(files)}"""


def tail_sql(x: str, n: str, p: str, digits: int | None = 9) -> str:
    return f"""{"round" if digits else ""}(CASE WHEN {x} <= 0 OR {p} >= 1 THEN 1.0 WHEN {p} <= 0 THEN 0.0 ELSE least(1.0, list_sum(list_transform(range({x}, {n} + 1),
        lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))) END{f", {digits}" if digits else ""})"""


def draw_sql(n: str | int, *of: object) -> str:
    """A number below n; of: SQL expressions, or text in quotes."""
    return f"(('0x' || md5(concat_ws('|', {', '.join(str(x) if isinstance(x, int) else x for x in of)}))[:12])::BIGINT % {n})"


def letter_sql(*of: object) -> str:
    return f"substr('ACGT', {draw_sql(4, *of)} + 1, 1)"


def simulated_ctes(view: str, lengths: list[int], errors: list[tuple[int, int]], gaps: list[int], q: float, count: int, seed: int) -> str:
    """CTEs seqs, motifs (motif_id, w0, ...), sim (seq_id, seq)."""
    words = ", ".join(" || ".join(letter_sql("'word'", "motif_id", seed, b, i) for i in range(k)) + f" AS w{b}" for b, k in enumerate(lengths))
    parts = []
    for b, (k, (low, high)) in enumerate(zip(lengths, errors, strict=True)):
        key = ("motif_id", "seq_id", seed, b)
        if b:
            parts += [letter_sql("'gap'", *key, i) for i in range(gaps[b - 1])]
        word = f"w{b}"
        for i in range(high):
            at = draw_sql(k, "'at'", *key, i)
            word = f"CASE WHEN {draw_sql(high - low + 1, chr(39) + 'errors' + chr(39), *key)} + {low} > {i} THEN substr({word}, 1, {at}) || {letter_sql(chr(39) + 'letter' + chr(39), *key, i)} || substr({word}, {at} + 2, {k}) ELSE {word} END"
        parts.append(word)
    return f"""seqs AS ({view}), n AS (SELECT count(*) AS n FROM seqs WHERE length(seq) > 0),
      ranked AS (SELECT seq_id, row_number() OVER (ORDER BY md5(concat_ws('|', 'rank', seq_id, {seed})), seq_id) - 1 AS place FROM seqs WHERE length(seq) > 0),
      motifs AS (SELECT motif_id, {words} FROM range({count}) t(motif_id)),
      runs AS (SELECT *, {draw_sql('n', "'start'", 'motif_id', seed)} AS start, ceil({q} * n / 100.0)::BIGINT AS size FROM motifs, n),
      tails AS (SELECT seq_id, string_agg({' || '.join(parts)}, '' ORDER BY motif_id) AS tail FROM ranked JOIN runs ON (place - start + n) % n < size GROUP BY 1),
      sim AS (SELECT seq_id, seq || coalesce(tail, '') AS seq FROM seqs LEFT JOIN tails USING (seq_id))"""


SIM_SQL = simulated_ctes(DNA, [SIM["k"]], [(SIM["e_min"], SIM["e_max"])], [], SIM["q"], SIM["count"], SIM["seed"])
S_SIM_SQL = simulated_ctes(DNA, [S_SIM["k"], 6], [(0, S_SIM["e"]), (0, 0)], [2], S_SIM["q"], S_SIM["count"], S_SIM["seed"])
ACCURACY = "SELECT count(*) AS total, count(*) FILTER (motif IN (SELECT motif FROM m)) AS found, count(*) FILTER (motif IN (SELECT motif FROM m)) / count(*) AS accuracy FROM"

HALVES = f"WITH seqs AS ({EVENTS}), fs AS (SELECT * FROM seqs WHERE seq_id % 2 = 1), bs AS (SELECT * FROM seqs WHERE seq_id % 2 = 0), {hamming_ctes('f', 'fs', FG)}, {hamming_ctes('b', 'bs', BG)}"
CODE = "translate(motif, 'ARNDCQEGHILKMFPSTWYVOUBZJX*', '" + "".join(chr(48 + i) for i in range(27)) + "')"

ORACLES: dict[str, str] = {
    "seq_build_events": EVENTS,
    "seq_build_orders": ORDERS,
    "kmer_windows": f"WITH seqs AS ({ORDERS}) SELECT seq_id, e - 1 AS end_pos, substr(seq, e - 2, 3) AS word FROM seqs, unnest(range(3, length(seq) + 1)) t(e)",
    "kmer_exact_counts": hamming_sql(DOCUMENTS, MotifParams(8, 0, 2, n_max=10**9), "SELECT motif, u, v FROM m"),
    "motif_hd_e1": hamming_sql(EVENTS, HD1),
    "motif_hd_e2": hamming_sql(LINEITEM, HD2),
    "motif_ed_e1": edit_sql(ORDERS, ED1),
    "motif_hd_prot": hamming_sql(DOCUMENTS, PROT),
    "motif_quorum_band": hamming_sql(EVENTS, BAND),
    "motif_short_rule": hamming_sql(ORDERS, SHORT),
    "motif_first_seen": hamming_sql(EVENTS, HD1, "SELECT motif, min(struct_pack(seq_id := seq_id, end_pos := end_pos)).seq_id AS seq_id, min(struct_pack(seq_id := seq_id, end_pos := end_pos)).end_pos AS end_pos FROM m JOIN m_w ON word = motif GROUP BY 1"),
    "gap_structs": "SELECT (row_number() OVER (ORDER BY g0, g1) - 1)::INTEGER AS struct_id, g0::INTEGER AS g0, g1::INTEGER AS g1 FROM unnest([16, 17]) a(g0), unnest([15, 16]) b(g1)",
    "smotif_hd": structured_hamming_sql(EVENTS, S_HD),
    "smotif_ed": structured_edit_sql(ORDERS, S_ED),
    "smotif_hd_three": structured_hamming_sql(EVENTS, S_HD3),
    "smotif_ed_three": structured_edit_sql(ORDERS, S_ED3),
    "bg_matched": f"{HALVES} SELECT f.motif, f.u, f.num_seqs, f.v, round(b.ratio, 6) AS bg_ratio, b.v AS bg_v, {tail_sql('f.u', 'f.num_seqs', 'round(b.ratio, 6)')} AS pvalue FROM f JOIN b USING (motif)",
    "bg_unmatched": f"{HALVES}, k AS (SELECT {BG.q}::DOUBLE / count(*) AS p FROM bs) SELECT f.motif, f.u, f.num_seqs, f.v, {tail_sql('f.u', 'f.num_seqs', 'k.p')} AS pvalue FROM f, k WHERE f.motif NOT IN (SELECT motif FROM b)",
    "bg_research": f"""{HALVES}, x AS (SELECT * FROM f WHERE motif NOT IN (SELECT motif FROM b)),
      r_s AS (SELECT x.motif, seq_id, sum(cnt) AS cnt FROM x JOIN b_c ON hamming(x.motif, b_c.word) <= 1 GROUP BY 1, 2), r_a AS (SELECT motif, count(*) AS u, sum(cnt)::BIGINT AS v FROM r_s GROUP BY 1), {kept("r", "bs", LOW)}
      SELECT x.motif, x.u AS fg_u, x.num_seqs AS fg_n, x.v AS fg_v, r.ratio AS bg_ratio, r.v AS bg_v, {tail_sql("x.u", "x.num_seqs", "r.ratio")} AS pvalue FROM x JOIN r USING (motif)""",
    "binomial_tail": f"SELECT x, n, p, {tail_sql('x', 'n', 'p')} AS tail FROM (SELECT n_nationkey::BIGINT AS x, (n_regionkey * 20 + 30)::BIGINT AS n, ((n_regionkey + 1) / 10.0)::DOUBLE AS p FROM nation)",
    "smile_encode": hamming_sql(DOCUMENTS, MotifParams(8, 0, 2, n_max=10**9), f"SELECT motif, {CODE} AS id FROM m"),
    "native_lines": hamming_sql(EVENTS, HD1, "SELECT printf('%s %d %d %.6f %d', motif, u, num_seqs, ratio, v) AS value FROM m"),
    "smile_lines": hamming_sql(EVENTS, HD1, "SELECT motif || ' ' || motif || ' ' || u || chr(9) || v AS value FROM m"),
    "dataset_stats": "SELECT view, num_seqs, total_length, ceil(12.0 * num_seqs / 100.0)::BIGINT AS quorum FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS view, count(*) AS num_seqs, sum(length(seq))::BIGINT AS total_length FROM ({v})" for k, v in (("events", EVENTS), ("lineitem", LINEITEM), ("orders", ORDERS), ("documents", DOCUMENTS))) + ")",
    "log_factorials": "SELECT i::BIGINT AS i, round(lgamma(i + 1), 9) AS log_factorial FROM range(201) t(i)",
    "fasta_scan": f"SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, 'user ' || seq_id || ' > x' AS header, seq FROM ({DNA})",
    "boxes_scan": "SELECT * FROM (VALUES (0, 16, 17, 6, 1), (1, 15, 16, 7, 2)) t(gap, gap_min, gap_max, length, errors)",
    "result_scan": f"{HALVES} SELECT motif, u, num_seqs, round(ratio, 6) AS ratio, v, num_seqs AS header_n, {BG.q}::DOUBLE AS header_q FROM b",
    "unmatched_scan": f"{HALVES} SELECT motif, u, num_seqs, round(ratio, 6) AS ratio, v FROM f WHERE motif NOT IN (SELECT motif FROM b)",
    "native_report": f"WITH seqs AS ({DNA}), {hamming_ctes('m', 'seqs', DNA1)} {native_file_sql('m', 'seqs', DNA1)}",
    "smile_report": f"WITH seqs AS ({DNA}), {hamming_ctes('m', 'seqs', DNA1)} {smile_file_sql(smile_header_sql(DNA1, 'seqs'), 'SELECT * FROM m JOIN m_f USING (motif)', DNA1.symbols)}",
    "structured_report": f"WITH seqs AS ({DNA}), {structured_ctes('m', 'seqs', S_DNA)} {several([native_file_sql('m', 'seqs', S_DNA), smile_file_sql(smile_header_sql(S_DNA, 'seqs'), 'SELECT * FROM m JOIN m_f USING (motif)', S_DNA.symbols)])}",
    "background_report": background_sql(hamming_ctes("b", "bs", BG), hamming_ctes("f", "fs", FG), BG, FG),
    "structured_background_report": background_sql(structured_ctes("b", "bs", S_BG), structured_ctes("f", "fs", S_FG), S_BG, S_FG),
    "research_report": f"""{HALVES}, y AS (SELECT f.*, first FROM f JOIN f_f USING (motif) WHERE motif NOT IN (SELECT motif FROM b)),
      r_s AS (SELECT y.motif, seq_id, sum(cnt) AS cnt FROM y JOIN b_c ON hamming(y.motif, b_c.word) <= 1 GROUP BY 1, 2), r_a AS (SELECT motif, count(*) AS u, sum(cnt)::BIGINT AS v FROM r_s GROUP BY 1), {kept("r", "bs", LOW)},
      x AS (SELECT y.*, r.ratio AS bg_ratio, r.v AS bg_v, {tail_sql("y.u", "y.num_seqs", "r.ratio", None)} AS pvalue FROM y JOIN r USING (motif))
      {file_sql(native_header_sql(LOW, 'bs'), f"SELECT {NATIVE} || ' ' || printf('%.6f %d', bg_ratio, bg_v) || ' ' || {PRINTED} AS value, first FROM {printing('x')}", ["''", "'#A total of ' || (SELECT count(*) FROM x) || ' valid motifs were extracted.'", "''"])}""",
    "simulation": f"WITH {SIM_SQL} SELECT * FROM sim",
    "simulation_structured": f"WITH {S_SIM_SQL} SELECT * FROM sim",
    "accuracy": f"WITH {SIM_SQL}, {hamming_ctes('m', 'sim', MotifParams(8, 1, 7))} {ACCURACY} (SELECT w0 AS motif FROM motifs)",
    "accuracy_structured": f"WITH {S_SIM_SQL}, {structured_ctes('m', 'sim', MotifParams(8, 0, 7, boxes=SIM_BOXES))} {ACCURACY} (SELECT w0 || '_' || w1 AS motif FROM motifs)",
}
