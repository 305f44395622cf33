"""Results as text: native and SMILE lines, with headers and trailers.

Lines are DataFrame projections in first-seen order; write_report() puts them into one text file. Whatever is written
more than once is computed once, to a table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Row
from pyspark.sql import functions as F

from seqloom.functions.stats import printed_pvalue
from seqloom.functions.words import smile_id
from seqloom.operators.extract import dataset_stats
from seqloom.params import MotifParams
from seqloom.storage import discard, materialise


@dataclass(frozen=True)
class Run:
    """What a header says of a run besides its parameters. began: time.perf_counter() of its start, for the seconds."""

    input: str = "-"
    output: str = "-"
    boxes: str = "-"
    date: str = ""
    processors: int = 1
    seconds: float = 0.0
    began: float | None = None

    def now(self) -> Run:
        """With the date and the seconds until now, where they aren't given."""
        return replace(self, date=self.date or time.ctime(), seconds=self.seconds if self.began is None else time.perf_counter() - self.began)


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy("first") if "first" in df.columns else df.orderBy("ordinal") if "ordinal" in df.columns else df


def native_line() -> Column:
    return F.format_string("%s %d %d %.6f %d", "motif", "u", "num_seqs", "ratio", "v")


def native_lines(found: DataFrame) -> DataFrame:
    """value: 'motif u N ratio v' for each motif."""
    return ordered(found).select(native_line().alias("value"))


def background_lines(compared: DataFrame) -> DataFrame:
    """value: the native line with 'bg_ratio bg_v pvalue'; unmatched motifs have '0 0' for the first two."""
    bg = F.when(F.col("matched"), F.format_string("%.6f %d", "bg_ratio", "bg_v")).otherwise("0 0")
    return ordered(compared).select(F.concat_ws(" ", native_line(), bg, printed_pvalue(F.col("pvalue"))).alias("value"))


def research_lines(found: DataFrame) -> DataFrame:
    """value: 'motif fg_u fg_n fg_r fg_v bg_ratio bg_v pvalue', one line for each kept row of the input."""
    return ordered(found).select(F.format_string("%s %d %d %.6f %d %.6f %d %s", "motif", "fg_u", "fg_n", "fg_ratio", "fg_v", "bg_ratio", "bg_v", printed_pvalue(F.col("pvalue"))).alias("value"))


def smile_lines(found: DataFrame, symbols: str) -> DataFrame:
    """value: 'motif id u<tab>v'; the id codes each symbol by its place in the alphabet."""
    return ordered(found).select(F.concat(F.col("motif"), F.lit(" "), smile_id(F.col("motif"), symbols), F.lit(" "), F.col("u").cast("string"), F.lit("\t"), F.col("v").cast("string")).alias("value"))


def native_header(params: MotifParams, num_seqs: int, run: Run = Run()) -> list[str]:
    """The header's lines; the sixth's third word is the number of sequences, the eighth's fourth the quorum."""
    rule = "#" * 36
    lines = [rule, "# Program: seqloom", f"# Rundate: {run.date}", f"# Input file: {run.input}", f"# Output file: {run.output}", f"# For {num_seqs} input sequences"]
    lines += [f"#     d = {int(params.distance == 'edit')}", f"#     q = {params.q:g}"]
    lines += [f"#     {name} = {value}" for name, value, usual in (("Q", params.q_max, 100), ("n", params.n_min, 1), ("N", params.n_max, 10000)) if value != usual]
    if params.boxes:
        lines += [f"# Number of boxes: {1 + len(params.boxes)}", f"#     l0 = {params.k}", f"#     e0 = {params.e}"]
        for i, b in enumerate(params.boxes, 1):
            lines += [f"#     g{i} = [{b.gap_min},{b.gap_max}]", f"#     l{i} = {b.length}", f"#     e{i} = {b.errors}"]
        lines.append(f"# Boxes input file: {run.boxes}")
    else:
        lines += [f"#     l = {params.k}", f"#     e = {params.e}"]
    return [*lines, f"# Run on {run.processors} proc(s) in {run.seconds:.6f} secs", rule, ""]


def smile_header(params: MotifParams, stats: Row) -> list[str]:
    """One line that sums up the run, padded as its readers expect, blank lines of the same width, and a rule. stats: a row of dataset_stats()."""
    length, errors = sum(params.lengths), sum(params.errors)
    said = f"%%% {1 + len(params.boxes)} {stats.quorum}/{stats.num_seqs} {stats.total_length} {length} {length} {errors} "
    if params.boxes:
        said += f"{params.k} {params.k} {params.e} " + "".join(f"{b.gap_min} {b.gap_max} {b.length} {b.length} {b.errors} " for b in params.boxes)
    said += f"alphabet {params.symbols}$"
    rule, blank = "=" * 79, " " * 79
    if params.alphabet == "DNA":
        return [said.ljust(79), blank, blank, rule]
    if params.alphabet == "PROT":
        return [said.ljust(159), blank, rule]
    return [said + rule]


def native_trailer(n: int, structured: bool = False) -> list[str]:
    return ["", f"#A total of {n} valid {'structured ' * structured}motifs were extracted.", ""]


def background_trailer(read: int, n: int, n_matched: int, unmatched_only: bool = False) -> list[str]:
    matched = [] if unmatched_only else [f"#  {n_matched} of them were matched with background motifs"]
    return ["", f"#A total of {read} background motifs were read.", f"#A total of {n} valid motifs were extracted:", *matched, f"#  {n - n_matched} of them were not matched with any background motif.", ""]


def smile_trailer(n: int, seconds: float = 0.0) -> list[str]:
    return [f"Nb models: {n}", f"User time: {seconds:.6f} sec."]


def write_report(lines: DataFrame, path: str, header: list[str] = (), trailer: list[str] = ()) -> None:
    """One text file in a folder at path. A report is for reading and exchange; keep large results as Parquet."""
    spark = lines.sparkSession
    with_order = lambda rows, part: spark.createDataFrame([(part, i, x) for i, x in enumerate(rows)], "part int, i long, value string")
    body = lines.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("i"), "value")
    every = with_order(header, 0).union(body).union(with_order(trailer, 2))
    every.coalesce(1).sortWithinPartitions("part", "i").select("value").write.mode("overwrite").text(path)


def _write_smile(rows: DataFrame, path: str, params: MotifParams, stats: Row, run: Run) -> None:
    write_report(smile_lines(rows, params.symbols), path, smile_header(params, stats), smile_trailer(rows.count(), run.seconds))


def write_result(found: DataFrame, params: MotifParams, sequences: DataFrame, path: str | None = None, smile_path: str | None = None, run: Run = Run()) -> None:
    """A result in native form at path and in SMILE form at smile_path, where given."""
    found, stats = materialise(found, "result"), dataset_stats(sequences, params.q).first()
    run = run.now()
    if path:
        write_report(native_lines(found), path, native_header(params, stats.num_seqs, run), native_trailer(found.count(), bool(params.boxes)))
    if smile_path:
        _write_smile(found, smile_path, params, stats, run)
    discard(found)


def write_background(compared: DataFrame, read: int, params: MotifParams, sequences: DataFrame, path: str, unmatched_path: str, smile_path: str | None = None, unmatched_smile_path: str | None = None, run: Run = Run()) -> None:
    """All motifs with their background at path, the unmatched in native form at unmatched_path; in SMILE form too where paths are given. read: motifs of the background."""
    compared, stats = materialise(compared, "compared"), dataset_stats(sequences, params.q).first()
    run = run.now()
    alone = compared.filter("NOT matched")
    n, n_matched = compared.count(), compared.filter("matched").count()
    header = native_header(params, stats.num_seqs, run)
    write_report(background_lines(compared), path, header, background_trailer(read, n, n_matched))
    write_report(native_lines(alone), unmatched_path, header, background_trailer(read, n, n_matched, unmatched_only=True))
    for to, rows in ((smile_path, compared), (unmatched_smile_path, alone)):
        if to:
            _write_smile(rows, to, params, stats, run)
    discard(compared)


def write_research(found: DataFrame, path: str, params: MotifParams, sequences: DataFrame, run: Run = Run()) -> None:
    found, stats = materialise(found, "research"), dataset_stats(sequences, params.q).first()
    write_report(research_lines(found), path, native_header(params, stats.num_seqs, run.now()), native_trailer(found.count()))
    discard(found)
