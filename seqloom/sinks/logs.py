"""The report of a search as text and as JSON; hits are streamed from the sorted table, never held."""

from __future__ import annotations

import json
import os
import sys
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import functions as F

from seqloom import __version__
from seqloom.operators.extract import Result
from seqloom.operators.matching import in_report_order

STDOUT = "STDOUT"
PROGRAM = "seqloom"
# The lines of the text report and the keys of the JSON report below are fixed values of those formats.


class LogError(ValueError):
    pass


def check_conflicts(log: str | None, json_log: str | None, out: str | None, suppress: bool) -> None:
    """At most one of records, text and JSON goes to standard output; records do so without a path."""
    if log == STDOUT and json_log == STDOUT:
        raise LogError("both logs cannot go to standard output")
    if STDOUT in (log, json_log) and not suppress and out in (None, STDOUT):
        raise LogError("a log and the records cannot share standard output")


@dataclass
class Run:
    """What a report says of a run besides its results."""

    command: str  # extract or tag
    files: list[str]
    command_line: list[str] = field(default_factory=list)
    kmer_file: str | None = None
    inverted: bool = False
    tag: str | None = None
    time: str = field(default_factory=lambda: datetime.now().astimezone().isoformat(timespec="seconds"))


@contextmanager
def _to(path: str):
    if path == STDOUT:
        yield sys.stdout
    else:
        with open(path, "w", encoding="utf-8") as f:
            yield f


def _hits(result: Result):
    return in_report_order(result.hits, result.query).select("file", "record_id", "pattern", "position").toLocalIterator()


def _facts(result: Result):
    counts = {r["pattern"]: r["count"] for r in result.pattern_counts.collect()}  # the query list is on the driver anyway
    ordered = [(p, counts[p]) for p in result.query.patterns]
    return ordered, result.summary.first(), result.paired_summary.first()


def write_tables(result: Result, folder: str) -> None:
    """counts.tsv and positions.tsv: folders of tab-separated parts with a header each, written by the tasks."""
    # Column names of the two tables are fixed values.
    counts = result.pattern_counts.select(F.col("pattern").alias("Pattern"), F.col("count").alias("Count"))
    hits = result.hits.select(F.col("pattern").alias("Pattern"), F.col("position").alias("Position"), F.col("file").alias("File"), F.col("record_id").alias("ReadID"))
    for name, table in (("counts", counts), ("positions", hits)):
        table.write.mode("errorifexists").options(sep="\t", header=True, quote="").csv(os.path.join(folder, f"{name}.tsv"))


def write_text(result: Result, run: Run, path: str) -> None:
    counts, s, pairs = _facts(result)
    n = len(counts)
    with _to(path) as f:
        f.write(f"#{PROGRAM} {run.command} log\n#{run.time}\n#Running {PROGRAM} version {__version__}\n#Command line: {' '.join(run.command_line)}\n")
        if run.tag:
            f.write(f"#Tag used for labeling records: {run.tag}\n")
        f.write(f"#Searching for {n} pattern{'s' if n > 1 else ''} {'(inverted matching)' if run.inverted else ''}\n")
        f.write("#\n#File\tRecord\tPattern\tPosition (zero-based)\n")
        for h in _hits(result):
            f.write(f"{h.file}\t{h.record_id}\t{h.pattern}\t{h.position}\n")
        f.write(f"#\n#Number of patterns found: {s.patterns_found}/{n} ({s.found_percent} %)\n#Pattern\tCount\n")
        f.writelines(f"#{p}\t{c}\n" for p, c in counts)
        f.write(f"#\n#Total number of records searched: {s.records_searched}\n#Total number of characters searched: {s.characters_searched}\n")
        f.write(f"#Total number of hits: {s.matches}\n#Number of distinct records with a hit: {s.records_hit}\n")
        if result.paired:
            f.write(f"#\n#Total number of hits in file 1: {pairs.hits_1}\n#Total number of hits in file 2: {pairs.hits_2}\n")
            f.write(f"#Number of distinct records with a hit in file 1: {pairs.records_hit_1}\n#Number of distinct records with a hit in file 2: {pairs.records_hit_2}\n")
            f.write(f"#Total number of extracted records: {pairs.extracted}\n")


def write_json(result: Result, run: Run, path: str) -> None:
    counts, s, pairs = _facts(result)
    names = [os.path.basename(x) for x in run.files]
    files = {"kmer_file": run.kmer_file, "record_file_1": names[0]}
    if run.command == "extract":
        files["record_file_2"] = names[1] if result.paired else None
    meta = {
        "program": PROGRAM, "version": __version__, "timestamp": run.time, "subcommand": run.command, "command_line": run.command_line, "search_algorithm": result.query.algorithm,
        "inverted_matching": run.inverted, "case_insensitive": result.query.case_insensitive, "input_files": files,
    }
    if run.tag:
        meta["tag"] = run.tag
    rest = {"meta_information": meta}
    if run.command == "extract":
        second = (lambda x: x) if result.paired else lambda x: None
        rest["paired_end_reads_statistics"] = {
            "searching_paired_end_reads": result.paired, "number_of_hits_in_file_1": pairs.hits_1, "number_of_hits_in_file_2": second(pairs.hits_2),
            "number_of_distinct_records_with_a_hit_in_file_1": pairs.records_hit_1, "number_of_distinct_records_with_a_hit_in_file_2": second(pairs.records_hit_2),
            "number_of_extracted_records": pairs.extracted,
        }
    rest["pattern_hit_counts"] = dict(counts)
    rest["summary_statistics"] = {
        "number_of_patterns_searched": len(counts), "number_of_patterns_found": s.patterns_found, "number_of_records_searched": s.records_searched,
        "number_of_characters_searched": s.characters_searched, "number_of_matches": s.matches, "number_of_distinct_records_with_a_hit": s.records_hit,
    }
    with _to(path) as f:
        f.write('{\n  "matching_records": [')
        for i, h in enumerate(_hits(result)):
            one = {"file": h.file, "pattern": h.pattern, "position": str(h.position), "record_id": h.record_id}
            f.write(("," if i else "") + "\n    " + json.dumps(one, ensure_ascii=False))
        f.write("\n  ],\n")
        f.write(json.dumps(rest, indent=2, sort_keys=True, ensure_ascii=False)[2:] + "\n")
