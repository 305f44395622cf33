"""The command line: extraction, background comparison and re-search from FASTA files to reports.

python -m seqloom.cli -a DNA -i in.fa -o out -d 0 -k 6 -e 1 -q 12
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from seqloom.operators import background
from seqloom.operators.extract import extract_motifs
from seqloom.params import MotifParams
from seqloom.sources import sinks
from seqloom.sources.fasta import read_fasta
from seqloom.sources.results import read_boxes, read_motifs, read_result


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-a", "--alphabet", required=True, help="DNA, PROT, USR or a string of symbols")
    p.add_argument("-i", "--input-file", required=True, help="FASTA")
    p.add_argument("-o", "--output-file", required=True, help="folder of the report")
    p.add_argument("-d", "--distance", required=True, type=int, choices=(0, 1), help="0 Hamming, 1 edit")
    p.add_argument("-k", "--motifs-length", required=True, type=int)
    p.add_argument("-e", "--max-num-of-errors", required=True, type=int)
    p.add_argument("-q", "--quorum", required=True, type=int, help="least percentage of sequences")
    p.add_argument("-Q", "--max-quorum", type=int, default=100)
    p.add_argument("-n", "--num-of-occ", type=int, default=1)
    p.add_argument("-N", "--max-num-of-occ", type=int, default=10000)
    p.add_argument("-s", "--boxes-in-file")
    p.add_argument("-S", "--SMILE-out-file")
    p.add_argument("-b", "--background-file")
    p.add_argument("-t", "--num-of-threads", type=int, help="local threads; else the session's own master")
    p.add_argument("-u", "--unmatched-out-file")
    p.add_argument("-U", "--unmatched-SMILE-out-file")
    p.add_argument("-I", "--unmatched-in-file")
    return p


def checked(args: argparse.Namespace) -> argparse.Namespace:
    wrong = [
        ((args.unmatched_out_file or args.unmatched_SMILE_out_file) and not args.background_file, "-u and -U need -b"),
        (args.background_file and not args.unmatched_out_file, "-b needs -u"),
        (args.background_file and args.unmatched_SMILE_out_file and not args.SMILE_out_file, "-U needs -S"),
        (args.unmatched_in_file and (args.background_file or args.boxes_in_file), "-I excludes -b and -s"),
    ]
    if found := [text for is_wrong, text in wrong if is_wrong]:
        raise ValueError("; ".join(found))
    return args


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = checked(parser().parse_args(argv))
    if spark is None:
        builder = SparkSession.builder.appName("seqloom")
        spark = (builder.master(f"local[{args.num_of_threads}]") if args.num_of_threads else builder).getOrCreate()
    began = time.perf_counter()
    boxes = read_boxes(spark, args.boxes_in_file) if args.boxes_in_file else ()
    params = MotifParams(args.motifs_length, args.max_num_of_errors, args.quorum, ("hamming", "edit")[args.distance], args.alphabet, args.max_quorum, args.num_of_occ, args.max_num_of_occ, boxes)
    sequences = read_fasta(spark, args.input_file, args.alphabet)
    run = sinks.Run(args.input_file, args.output_file, args.boxes_in_file or "-", processors=spark.sparkContext.defaultParallelism, began=began)
    if args.unmatched_in_file:
        sinks.write_research(background.research(read_motifs(spark, args.unmatched_in_file), sequences, params), args.output_file, params, sequences, run)
        return
    found = extract_motifs(sequences, params)
    if args.background_file:
        bg, n, q = read_result(spark, args.background_file)
        sinks.write_background(background.compare(found, bg, n, q), bg.count(), params, sequences, args.output_file, args.unmatched_out_file, args.SMILE_out_file, args.unmatched_SMILE_out_file, run)
        return
    sinks.write_result(found, params, sequences, args.output_file, args.SMILE_out_file, run)


if __name__ == "__main__":
    main()
