import bz2
import gzip
import json
import lzma

import pytest

from seqloom import cli
from seqloom.sinks import alignment as AS
from seqloom.sinks import fastx as FS
from seqloom.sinks import logs
from seqloom.sources import alignment as A
from seqloom.sources import fastx as X
from seqloom.sources import files

FASTA = ">seq1 one\nACGTACGT\n>seq2\nTTTTTTTT\n>seq3\nGGACGTCC"
WRAPPED = ">p\n" + "\n".join(["M" * 78 + "DK", "AT" + "M" * 78, "MMMM"]) + "\n"
ONE = "@seq1/1\nACTTGGGG\n+\n@@IIIIII\n@seq2/1\nGGGGGGGG\n+\nIIIIIIII"
TWO = "@seq1/2\nGGGGGGGG\n+\nIIIIIIII\n@seq2/2\nGGGCTTGG\n+\n@IIIIIII"
SAM = (
    "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:1\tLN:100000\n"
    "r:100\t99\t1\t1000\t60\t20M\t=\t1100\t120\tAGCTTAGCTCGCTACGATCG\tFFFFFFFFFFFFFFFFFFFF\tNM:i:1\tMD:Z:10A9\tXB:B:c,1,-2\tXF:f:1.5\n"
    "r:100\t147\t1\t1100\t60\t5S15M\t=\t1000\t-120\tTTCGATCGATCGATCGATCG\tFFFFFFFFFFFFFFFFFFFF\tNM:i:0\n"
    "r:101\t4\t*\t0\t0\t*\t*\t0\t0\tCAGTGAGTCAGTCAGTCAGTA\t*\tXA:A:q\n"
)


@pytest.fixture
def put(tmp_path):
    def f(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return f


def rows(df):
    return [(r.rec_no, r.id, r.seq, r.qual) for r in df.orderBy("rec_no").collect()]


def test_fasta_plain_and_compressed(spark, put):
    want = [(0, "seq1 one", "ACGTACGT", None), (1, "seq2", "TTTTTTTT", None), (2, "seq3", "GGACGTCC", None)]
    for name, pack in (("a.fasta", lambda x: x), ("a.fa.gz", gzip.compress), ("a.fa.bz2", bz2.compress), ("a.fa.xz", lzma.compress)):
        assert rows(X.read_fastx(spark, put(name, pack(FASTA.encode())))) == want
    r = X.read_fastx(spark, put("w.faa", WRAPPED)).first()
    assert len(r.seq) == 164 and r.seq.index("DKAT") == 78 and r.raw == WRAPPED
    assert rows(X.read_fastx(spark, put("e.fa", ""))) == []


def test_fastq_and_its_faults(spark, put):
    got = X.read_fastx(spark, put("a.fastq", ONE))
    assert rows(got) == [(0, "seq1/1", "ACTTGGGG", "@@IIIIII"), (1, "seq2/1", "GGGGGGGG", "IIIIIIII")]
    assert "".join(r.raw for r in got.orderBy("rec_no").collect()) == ONE + "\n"
    for bad in ("@a\nACG\n+\nII\n", "ACGT\n"):
        with pytest.raises(Exception, match="FormatError"):
            X.read_fastx(spark, put("bad.fastq", bad)).collect()


def test_split_files_have_the_same_records(spark, put):
    fasta = "".join(f">r{i}\n{'ACGT' * (i % 7)}\nTT\n" for i in range(500))
    fastq = "".join(f"@r{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@+II' * (i % 7 + 1)}\n" for i in range(500))
    for name, text in (("s.fa", fasta), ("s.fq", fastq)):
        path = put(name, text)
        whole, split = X.read_fastx(spark, path), X.read_fastx(spark, path, split_mb=0.001)
        assert split.rdd.getNumPartitions() > 5
        assert [x[1:] for x in rows(split)] == [x[1:] for x in rows(whole)]


def test_sam_and_bam_round_trip(spark, put, tmp_path):
    path = put("a.sam", SAM)
    df, head = A.read_alignments(spark, path, "sam"), A.header(path, "sam")
    assert head == SAM.split("\n")[:2] and df.count() == 3
    AS.write_sam(df, head, str(tmp_path / "b.sam"))
    assert (tmp_path / "b.sam").read_text() == SAM
    AS.write_bam(df, head, str(tmp_path / "c.bam"))
    back = A.read_alignments(spark, str(tmp_path / "c.bam"), "bam")
    AS.write_sam(back, A.header(str(tmp_path / "c.bam"), "bam"), str(tmp_path / "d.sam"))
    assert (tmp_path / "d.sam").read_text() == SAM
    with pytest.raises(A.FormatError):
        A.read_alignments(spark, path, "cram")


def test_parts_make_one_file(spark, put, tmp_path):
    many = SAM + "".join(f"q{i}\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*\tXA:Z:{i}\n" for i in range(200))
    path = put("many.sam", many)
    df, head = A.read_alignments(spark, path, "sam").repartition(3), A.header(path, "sam")
    AS.write_sam_parts(df, head, str(tmp_path / "s"))
    parts = sorted((tmp_path / "s").glob("part-*"))
    assert "".join(p.read_text() for p in [tmp_path / "s" / "_header.sam", *parts]) == many
    AS.write_bam_parts(df, head, str(tmp_path / "b"))
    parts = sorted((tmp_path / "b").glob("*"))
    assert len(parts) >= 3 and all(p.name.startswith("part-") for p in parts)
    (tmp_path / "one.bam").write_bytes(b"".join(p.read_bytes() for p in parts))
    back = A.read_alignments(spark, str(tmp_path / "one.bam"), "bam")
    AS.write_sam(back, A.header(str(tmp_path / "one.bam"), "bam"), str(tmp_path / "back.sam"))
    assert (tmp_path / "back.sam").read_text() == many


def test_tables_and_parts_of_a_command(spark, put, tmp_path):
    fasta = put("in.fasta", FASTA)
    assert cli.main(["extract", "-i", fasta, "-r", "-s", "ACG", "-o", str(tmp_path / "out"), "--parts", "--tables", str(tmp_path / "t")]) == 0
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == ">seq1 one\nACGTACGT\n>seq3\nGGACGTCC\n"
    lines = {n: sorted({x for p in (tmp_path / "t" / f"{n}.tsv").glob("part-*") for x in p.read_text().splitlines()}) for n in ("counts", "positions")}
    assert lines["counts"] == ["ACG\t2", "CGT\t2", "Pattern\tCount"]
    assert "Pattern\tPosition\tFile\tReadID" in lines["positions"] and "ACG\t4\tin.fasta\tseq1 one" in lines["positions"] and len(lines["positions"]) == 7
    with pytest.raises(SystemExit):
        cli.parse(["extract", "-i", fasta, "-s", "A", "--parts"])


def test_split_sam_has_the_same_records(spark, put):
    head = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:c{i}\tLN:{i + 1}\n" for i in range(100))
    path = put("s.sam", head + "".join(f"q{i}\t4\t*\t0\t0\t*\t*\t0\t0\t{'ACGT' * (i % 9)}\t*\tXA:Z:{i}\n" for i in range(500)))
    whole, split = A.read_alignments(spark, path, "sam"), A.read_alignments(spark, path, "sam", split_mb=0.001)
    assert split.rdd.getNumPartitions() > 10
    assert [r.qname for r in split.orderBy("rec_no").collect()] == [r.qname for r in whole.orderBy("rec_no").collect()] == [f"q{i}" for i in range(500)]


def test_stores(spark, put, tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(files, "store_of", lambda p: (fs.LocalFileSystem(), p.removeprefix("store://")) if p.startswith("store://") else (None, p))
    (tmp_path / "d").mkdir()
    for name, data in (("d/a.fa", FASTA.encode()), ("d/b.fa.gz", gzip.compress(FASTA.encode())), ("d/_c", b"")):
        put(name, data)
    found = files.listed(f"store://{tmp_path}/d")
    assert found == [f"store://{tmp_path}/d/a.fa", f"store://{tmp_path}/d/b.fa.gz"] and files.listed(found[0]) == found[:1]
    assert [files.opened(p).read() for p in found] == [FASTA.encode()] * 2 and files.size_of(found[0]) == len(FASTA) and files.is_compressed(found[1])
    assert [r[3:5] for r in X.records(files.opened(found[1]), "b.fa.gz", 1)] == [("seq1 one", "ACGTACGT"), ("seq2", "TTTTTTTT"), ("seq3", "GGACGTCC")]
    with pytest.raises(FileNotFoundError):
        files.listed(f"store://{tmp_path}/none")


def test_paths(tmp_path):
    assert files.uncompressed_type("x/a.fastq.gz") == "fastq" and files.uncompressed_type("a.b.fa") == "fa"
    assert files.uncompressed_type("a.gz") == "gz"
    for bad in ("plain", str(tmp_path)):
        with pytest.raises(files.PathError):
            files.uncompressed_type(bad)
    assert files.add_suffix("d.x/sample.sorted.fasta", "_1") == "d.x/sample_1.sorted.fasta"
    assert FS.output_path("o/out.txt", "in.fq.gz") == "o/out.fq"
    assert AS.output_kind(None, "bam") == "sam" and AS.output_kind("x", "bam") == "bam" and AS.output_kind("x.sam", "bam") == "sam"
    with pytest.raises(A.FormatError):
        AS.output_kind("x.txt", "sam")


def test_log_conflicts():
    for bad in ((logs.STDOUT, logs.STDOUT, "o", False), (logs.STDOUT, None, None, False), (None, logs.STDOUT, logs.STDOUT, False)):
        with pytest.raises(logs.LogError):
            logs.check_conflicts(*bad)
    logs.check_conflicts(logs.STDOUT, "j", None, True)
    logs.check_conflicts("l", "j", None, False)


@pytest.mark.parametrize(
    "line",
    [
        "extract -i a", "extract -i a -s A -f b", "extract -i a -s A -r -c", "extract -i a -s A -I -L", "extract -i a -s A -q 2 -a", "extract -i a -s A -S",
        "extract -i a -s A -S -l x -o y", "tag -i a -s A -m -v", "tag -i a -s A -p 0", "tag -s A", "other",
    ],
)
def test_wrong_arguments(line):
    with pytest.raises(SystemExit):
        cli.parse(line.split())


def body(path):
    return [x for x in open(path).read().split("\n")]


def test_extract_command(spark, put, tmp_path, capsys):
    fasta, log, js = put("in.fasta", FASTA), str(tmp_path / "l"), str(tmp_path / "j")
    assert cli.main(["extract", "-i", fasta, "-r", "-s", "ACG", "-o", str(tmp_path / "out.x"), f"-l{log}", f"-j{js}"]) == 0
    assert (tmp_path / "out.fasta").read_text() == ">seq1 one\nACGTACGT\n>seq3\nGGACGTCC\n"
    text = body(log)
    assert text[4:8] == ["#Searching for 2 patterns ", "#", "#File\tRecord\tPattern\tPosition (zero-based)", "in.fasta\tseq1 one\tACG\t0"]
    assert text[13:] == [
        "#", "#Number of patterns found: 2/2 (100.00 %)", "#Pattern\tCount", "#ACG\t2", "#CGT\t2", "#", "#Total number of records searched: 3",
        "#Total number of characters searched: 24", "#Total number of hits: 6", "#Number of distinct records with a hit: 2", "",
    ]
    j = json.load(open(js))
    assert j["matching_records"][1] == {"file": "in.fasta", "pattern": "ACG", "position": "4", "record_id": "seq1 one"}
    assert j["pattern_hit_counts"] == {"ACG": 2, "CGT": 2} and j["paired_end_reads_statistics"]["number_of_hits_in_file_2"] is None
    assert j["paired_end_reads_statistics"]["number_of_extracted_records"] == 2 and j["meta_information"]["search_algorithm"] == "BNDMq"
    assert j["summary_statistics"]["number_of_matches"] == 6
    capsys.readouterr()
    assert cli.main(["extract", "-i", fasta, "-s", "ACG", "-v"]) == 0
    assert capsys.readouterr().out == ">seq2\nTTTTTTTT\n"
    assert cli.main(["extract", "-i", fasta, "-s", "zzz", "-S", "-l"]) == 0
    assert "#Number of patterns found: 0/1 (0.00 %)" in capsys.readouterr().out
    assert cli.main(["extract", "-i", str(tmp_path), "-s", "A"]) == 1


def test_paired_command(spark, put, tmp_path, capsys):
    one, two, log = put("p1.fastq", ONE), put("p2.fastq", TWO), str(tmp_path / "l")
    assert cli.main(["extract", "-1", one, "-2", two, "-s", "CTT", "-o", str(tmp_path / "o.fq"), "-l", log]) == 0
    assert (tmp_path / "o_1.fastq").read_text() == ONE + "\n" and (tmp_path / "o_2.fastq").read_text() == TWO + "\n"
    assert body(log)[7:9] == ["p1.fastq\tseq1/1\tCTT\t1", "p2.fastq\tseq2/2\tCTT\t3"]
    assert body(log)[-7:-1] == ["#", "#Total number of hits in file 1: 1", "#Total number of hits in file 2: 1", "#Number of distinct records with a hit in file 1: 1", "#Number of distinct records with a hit in file 2: 1", "#Total number of extracted records: 4"]
    capsys.readouterr()
    assert cli.main(["extract", "-1", one, "-2", two, "-s", "ACTT"]) == 0
    assert capsys.readouterr().out == "@seq1/1\nACTTGGGG\n+\n@@IIIIII\n@seq1/2\nGGGGGGGG\n+\nIIIIIIII\n"
    assert cli.main(["extract", "-1", one, "-2", put("p3.fastq", TWO + "\n" + TWO), "-s", "A"]) == 1


def test_tag_command(spark, put, tmp_path, capsys):
    path, js = put("in.sam", SAM), str(tmp_path / "j")
    assert cli.main(["tag", "-i", path, "-o", str(tmp_path / "o.sam"), "-s", "CTC", "-r", "-m", "-j", js]) == 0
    lines = (tmp_path / "o.sam").read_text().split("\n")
    assert lines[:2] == SAM.split("\n")[:2] and lines[2].startswith("@PG\tID:seqloom")
    assert [x.split("\t")[-1] for x in lines[3:-1]] == ["km:Z:CTC", "km:Z:GAG"]
    j = json.load(open(js))
    assert j["meta_information"]["tag"] == "km" and "paired_end_reads_statistics" not in j
    assert j["summary_statistics"]["number_of_records_searched"] == 3 and j["summary_statistics"]["number_of_characters_searched"] == 61
    assert cli.main(["tag", "-i", path, "-o", str(tmp_path / "o.bam"), "-s", "CTC", "-t", "kx"]) == 0
    back = A.read_alignments(spark, str(tmp_path / "o.bam"), "bam").orderBy("rec_no").collect()
    assert [r.tags[-1].value for r in back] == ["CTC", "", ""] and back[0].tags[-1].tag == "kx"
    capsys.readouterr()
    assert cli.main(["tag", "-i", str(tmp_path / "o.bam"), "-s", "GAG", "-v", "-t", "kx"]) == 0
    out = capsys.readouterr().out.split("\n")
    assert [x.split("\t")[-1] for x in out if not x.startswith("@") and x] == ["kx:Z:CTC", "kx:Z:"]
    assert cli.main(["tag", "-i", path, "-s", "A", "-t", "toolong"]) == 1
    assert cli.main(["tag", "-i", put("x.txt", ""), "-s", "A"]) == 1
