"""The command line: ``python -m seqloom.cli extract …`` and ``… tag …``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from seqloom import __version__
from seqloom.operators import patterns as pats
from seqloom.operators import tagging
from seqloom.operators.extract import extract, extract_pairs, zip_mates
from seqloom.sinks import alignment as alignment_sink
from seqloom.sinks import fastx as fastx_sink
from seqloom.sinks import logs
from seqloom.sources import alignment, fastx
from seqloom.sources.files import PathError, refuse_directory


def _positive(x: str) -> int:
    if int(x) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return int(x)


def _common(p: argparse.ArgumentParser) -> None:
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("-s", "--kmer-seq", nargs="+", metavar="SEQ", help="patterns")
    which.add_argument("-f", "--kmer-file", metavar="FILE", help="file of patterns, plain or FASTA")
    strand = p.add_mutually_exclusive_group()
    strand.add_argument("-r", "--reverse-complement", action="store_true", help="search the other strand too")
    strand.add_argument("-c", "--canonical", action="store_true", help="search canonical patterns")
    case = p.add_mutually_exclusive_group()
    case.add_argument("-I", "--case-insensitive", action="store_true")
    case.add_argument("-L", "--lowercase", action="store_true", help="patterns in lower case")
    case.add_argument("-U", "--uppercase", action="store_true", help="patterns in upper case")
    search = p.add_mutually_exclusive_group()
    search.add_argument("-q", "--q-size", type=_positive, help="single-pattern search, with this window")
    search.add_argument("-a", "--aho-corasick", action="store_true", help="multi-pattern search")
    p.add_argument("-l", "--out-log", nargs="?", const=logs.STDOUT, metavar="FILE", help="text log")
    p.add_argument("-j", "--json-log", nargs="?", const=logs.STDOUT, metavar="FILE", help="JSON log")
    p.add_argument("--tables", metavar="FOLDER", help="counts and positions as tab-separated tables")
    p.add_argument("--parts", action="store_true", help="write the output as a folder of parts, by all tasks at once")
    p.add_argument("-S", "--suppress-output", action="store_true", help="write no records; needs a log")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", description="Search records for many patterns at once.")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    e = commands.add_parser("extract", help="records of FASTA and FASTQ that hold a pattern")
    e.add_argument("-i", "-1", "--in-fastx", required=True, metavar="FILE")
    e.add_argument("-2", "--in-fastq-2", metavar="FILE", help="second file of read pairs")
    e.add_argument("-o", "--out-fastx", metavar="FILE")
    e.add_argument("-v", "--invert-match", action="store_true", help="records that hold none")
    _common(e)
    t = commands.add_parser("tag", help="label alignments of SAM and BAM")
    t.add_argument("-i", "--in-file", required=True, metavar="FILE")
    t.add_argument("-o", "--out-file", metavar="FILE")
    t.add_argument("-t", "--tag", default="km")
    t.add_argument("-p", "--threads", type=_positive, default=1, help="local threads, where no session runs")
    keep = t.add_mutually_exclusive_group()
    keep.add_argument("-m", "--filter-matching", action="store_true", help="only alignments with a match")
    keep.add_argument("-v", "--invert-match", action="store_true", help="only alignments without one")
    _common(t)
    return top


def parse(argv: list[str]) -> argparse.Namespace:
    top = parser()
    a = top.parse_args(argv)
    out = a.out_fastx if a.command == "extract" else a.out_file
    if a.suppress_output and out is not None:
        top.error("-S conflicts with -o")
    if a.suppress_output and a.out_log is None and a.json_log is None and a.tables is None:
        top.error("-S needs a log")
    if a.parts and out in (None, logs.STDOUT):
        top.error("--parts needs -o")
    return a


def _query(a: argparse.Namespace) -> pats.PatternList:
    found = pats.prepare(a.kmer_seq, a.kmer_file, reverse_complement=a.reverse_complement, canonical=a.canonical, lowercase=a.lowercase, uppercase=a.uppercase)
    return pats.plan(found, q_size=None if a.case_insensitive else a.q_size, force_multi=a.aho_corasick, case_insensitive=a.case_insensitive)


def _logs(a: argparse.Namespace, result, run: logs.Run) -> None:
    if a.out_log:
        logs.write_text(result, run, a.out_log)
    if a.json_log:
        logs.write_json(result, run, a.json_log)
    if a.tables:
        logs.write_tables(result, a.tables)


def run_extract(spark: SparkSession, a: argparse.Namespace, line: list[str]) -> None:
    logs.check_conflicts(a.out_log, a.json_log, a.out_fastx, a.suppress_output)
    query = _query(a)
    refuse_directory(a.in_fastx, "the read file")
    paired = a.in_fastq_2 is not None
    records = fastx.read_fastx(spark, a.in_fastx)
    if paired:
        refuse_directory(a.in_fastq_2, "the second read file")
        records = zip_mates(records, fastx.read_fastx(spark, a.in_fastq_2, 2))
    result = (extract_pairs if paired else extract)(records, query, invert=a.invert_match)
    if not a.suppress_output:
        if a.parts:
            fastx_sink.write_parts(result.kept, a.out_fastx, paired)
        elif a.out_fastx is None or a.out_fastx == logs.STDOUT:
            fastx_sink.write_stdout(result.kept, paired)
        elif paired:
            # File names differ between mates and do not order them; places do.
            fastx_sink.write_pairs(result.kept, a.out_fastx, a.in_fastx)
        else:
            fastx_sink.write(result.kept, a.out_fastx, a.in_fastx)
    _logs(a, result, logs.Run("extract", [a.in_fastx] + [a.in_fastq_2] * paired, line, a.kmer_file, a.invert_match))


def run_tag(spark: SparkSession, a: argparse.Namespace, line: list[str]) -> None:
    logs.check_conflicts(a.out_log, a.json_log, a.out_file, a.suppress_output)
    refuse_directory(a.in_file, "the alignment file")
    query, name = _query(a), tagging.check_tag(a.tag)
    kind = a.in_file.rsplit(".", 1)[-1] if "." in os.path.basename(a.in_file) else ""
    records = alignment.read_alignments(spark, a.in_file, kind)
    mode = tagging.MATCHING if a.filter_matching else tagging.NOT_MATCHING if a.invert_match else tagging.ALL
    result = tagging.tag(records, query, tag=name, mode=mode)
    if not a.suppress_output:
        to = None if a.out_file == logs.STDOUT else a.out_file
        header = [*alignment.header(a.in_file, kind), alignment_sink.program_line(" ".join(line))]
        bam = alignment_sink.output_kind(to, kind) == "bam"
        if a.parts:
            (alignment_sink.write_bam_parts if bam else alignment_sink.write_sam_parts)(result.kept, header, to)
        elif bam:
            alignment_sink.write_bam(result.kept, header, to)
        else:
            alignment_sink.write_sam(result.kept, header, to)
    _logs(a, result, logs.Run("tag", [a.in_file], line, a.kmer_file, a.invert_match, name))


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    a = parse(argv)
    threads = a.threads if a.command == "tag" else "*"
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{threads}]")).appName("seqloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        (run_extract if a.command == "extract" else run_tag)(spark, a, ["seqloom", *argv])
    except (pats.PatternError, PathError, tagging.TagError, logs.LogError, alignment.FormatError, fastx.FormatError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
