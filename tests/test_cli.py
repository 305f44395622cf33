"""The command line over small files, from extraction to re-search."""

import pytest

from seqloom.cli import checked, main, parser
from tests.test_motifs import SMALL


def fasta(path, seqs):
    path.write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(seqs)))
    return str(path)


def body(folder):
    return next(folder.glob("part*")).read_text()


BASE = ["-a", "DNA", "-d", "0", "-k", "6", "-e", "1"]


def test_pipeline_of_runs(spark, tmp_path):
    bg, fg = fasta(tmp_path / "bg.fa", [SMALL[0]] * 3), fasta(tmp_path / "fg.fa", SMALL[1:])
    at = lambda n: str(tmp_path / n)
    main([*BASE, "-i", bg, "-o", at("bg"), "-q", "1", "-S", at("smile")], spark)
    assert "#A total of 14 valid motifs were extracted." in body(tmp_path / "bg") and "Nb models: 14" in body(tmp_path / "smile")
    main([*BASE, "-i", fg, "-o", at("fg"), "-q", "100", "-b", at("bg"), "-u", at("un")], spark)
    assert "#  10 of them were matched with background motifs" in body(tmp_path / "fg")
    assert "#A total of 14 background motifs were read." in body(tmp_path / "un") and "#  45 of them were not matched" in body(tmp_path / "un")
    assert f"# Input file: {fg}" in body(tmp_path / "fg") and "# Run on 8 proc(s) in " in body(tmp_path / "fg")
    main([*BASE, "-i", bg, "-o", at("fg2"), "-q", "1", "-I", at("un")], spark)
    assert "#A total of 12 valid motifs were extracted." in body(tmp_path / "fg2")


def test_boxes(spark, tmp_path):
    (tmp_path / "boxes.txt").write_text("2\n16\n17\n6\n1\n15\n16\n7\n2\n")
    main([*BASE, "-i", fasta(tmp_path / "a.fa", SMALL), "-o", str(tmp_path / "out"), "-q", "1", "-s", str(tmp_path / "boxes.txt")], spark)
    assert "#A total of 132 valid structured motifs were extracted." in body(tmp_path / "out")


@pytest.mark.parametrize("more", [["-u", "x"], ["-U", "x"], ["-b", "x"], ["-b", "x", "-u", "y", "-U", "z"], ["-I", "x", "-s", "y"], ["-I", "x", "-b", "y", "-u", "z"]])
def test_options_that_exclude_each_other(more):
    with pytest.raises(ValueError):
        checked(parser().parse_args([*BASE, "-i", "a", "-o", "b", "-q", "1", *more]))
