import gzip
import random

import pytest

from strandloom import cli
from strandloom.sources import bam, bcf, fasta, text
from strandloom.streaming import pileup as streaming


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_bed(spark):
    rows = text.parse_bed(lines(spark, "c\t1\t5", "", "c\t2\t9\tn\t0\t-", "d\t0\t1\tx", "c\t3\t4\t\t.\t+extra\tmore")).collect()
    assert [tuple(r) for r in rows] == [("c", 1, 5, "", "."), ("c", 2, 9, "n", "-"), ("d", 0, 1, "x", "."), ("c", 3, 4, "", "+")]
    assert text.parse_bed(lines(spark, "", "  ")).count() == 0
    with pytest.raises(Exception, match="must end after its start"):
        text.parse_bed(lines(spark, "c\t5\t5")).collect()


def test_gff(spark):
    rows = text.parse_gff(lines(spark, "#x", "", "c\ts\texon\t11\t20\t.\t+\t.\tID", "c\ts\tGene\t1\t1\t.\t-", "c\ts\tCDS\t1\t2\t.\t+", "c\ts\tgene\t1\t2\t.\t.")).collect()
    assert [tuple(r) for r in rows] == [("c", 10, 20, "exon", "+"), ("c", 0, 1, "gene", "-")]


def test_vcf(spark):
    rows = text.parse_vcf(lines(spark, "##h", "#CHROM", "c\t7\t.\tA\tG,T\t9\tPASS\t.\tDP:GT\t3:1/2", "c\t8\t.\tA\tG\t9\t.\t.\tDP\t3")).collect()
    assert [tuple(r) for r in rows] == [("c", 6, "A", "G,T", "PASS", "1/2"), ("c", 7, "A", "G", ".", ".")]


def test_fasta_and_gzip(spark, tmp_path):
    seq = "".join(random.Random(0).choices("ACGTacgtNR", k=3000))
    body = ">c one\n" + "\n".join(seq[k : k + 60] for k in range(0, 3000, 60)) + "\n>d\nAC\n"
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(body)
    tiles = text.read_fasta(spark, str(tmp_path / "x.fa.gz"))
    assert tiles.count() == 4
    bases = {(r["contig"], r["pos"]): r["refnuc"] for r in text.positions(tiles).collect()}
    assert len(bases) == 3002 and all(bases["c", k] == (x.upper() if x.upper() in "ACGT" else "N") for k, x in enumerate(seq))
    ranges = spark.createDataFrame([(1, "c", 1000, 2100), (2, "d", 0, 1), (3, "c", 5, 5)], "k long, contig string, start_ long, end_ long")
    assert {r["k"]: r["seq"] for r in text.fetch(tiles, ranges, "k").collect()} == {1: seq[1000:2100], 2: "A"}


def fasta_text(contigs, width):
    return "".join(f">{name}\n" + "".join(f"{seq[k : k + width]}\n" for k in range(0, len(seq), width)) for name, seq in contigs)


@pytest.mark.parametrize(("width", "break_"), [(60, "\n"), (61, "\r\n"), (1024, "\n"), (5000, "\n")])
@pytest.mark.parametrize("index", [True, False])
def test_fasta_in_pieces(spark, tmp_path, width, break_, index):
    """Headers may hold any sign, also those that start records; a last line may have no break."""
    rnd = random.Random(width)
    seqs = {f"c{k}": "".join(rnd.choices("ACGTacgtNR", k=n)) for k, n in enumerate((9000, 1, 1024, 2048, 3333))}
    path = tmp_path / "x.fa"
    path.write_bytes(fasta_text([(f"{c} A>G change > more\t>x", s) for c, s in seqs.items()], width).replace("\n", break_).rstrip().encode())
    if index:
        (tmp_path / "x.fa.fai").write_text(fasta.make_index(str(path)))
    tiles = text.read_fasta(spark, str(path), split=2048)
    assert (tiles.rdd.getNumPartitions() > 5) is index
    rows = sorted((r["contig"], r["tile"], r["seq"]) for r in tiles.collect())
    assert rows == sorted((c, k // 1024, s[k : k + 1024]) for c, s in seqs.items() for k in range(0, len(s), 1024))


def test_fasta_that_is_odd(spark, tmp_path):
    (tmp_path / "empty.fa").write_text("")
    (tmp_path / "odd.fa").write_text("no record\n>a\n\n>b x\nAC\n\nGT\n>c\n")
    assert text.read_fasta(spark, str(tmp_path / "empty.fa")).count() == 0
    assert [tuple(r) for r in text.read_fasta(spark, str(tmp_path / "odd.fa")).collect()] == [("b", 0, "ACGT")]
    (tmp_path / "bad.fa").write_text(">a\nAC\nACG\n")
    with pytest.raises(ValueError, match="differ in length"):
        fasta.make_index(str(tmp_path / "bad.fa"))


def test_a_long_contig_is_read_in_time(spark, tmp_path):
    """32 Mb on one line and in lines, with and without an index: seconds, not a power of the length."""
    import time

    seq = "".join(random.Random(1).choices("ACGT", k=1 << 15)) * (1 << 10)
    for width in (80, len(seq)):
        path = tmp_path / f"{width}.fa"
        path.write_text(f">chr1 A>G\n" + "\n".join(seq[k : k + width] for k in range(0, len(seq), width)))
        for _ in range(2):
            began = time.perf_counter()
            assert text.read_fasta(spark, str(path)).agg({"tile": "max"}).first()[0] == len(seq) // 1024 - 1
            assert time.perf_counter() - began < 30
            (tmp_path / f"{width}.fa.fai").write_text(fasta.make_index(str(path)))


def test_vcf_has_one_sample(spark):
    for line in ("c\t7\t.\tA\tG\t9\tPASS\t.\tGT\t0/1\t0/1", "c\t7\t.\tA\tG\t9\tPASS\t."):
        with pytest.raises(Exception, match="exactly one sample"):
            text.parse_vcf(lines(spark, line)).collect()


def test_bcf(spark, tmp_path):
    rows = [("a", 5, "A", "G", "PASS", "0/1"), ("b", 7, "A", "G,T", "q10", "1|2"), ("b", 8, "AT", "A", ".", "./1"), ("b", 9, "A" * 400, ".", "PASS;q10", "."), ("a", 2**30, "C", "T", "PASS", "1")]
    path = str(tmp_path / "x.bcf")
    bcf.write_bcf(path, [("a", 2**31 - 1), ("b", 99)], rows * 300, ["q10"])
    assert sorted(tuple(r) for r in text.read_vcf(spark, path).collect()) == sorted(rows * 300)
    with pytest.raises(ValueError, match="exactly one sample"):
        bcf.decode(bytes(20) + (2).to_bytes(4, "little"), b"", ["a"], {})


def test_tables_are_one_file_in_order(spark, tmp_path):
    rows = spark.range(1000).repartition(7).selectExpr("id", "concat('a,', id) as name").orderBy("id")
    text.write_table(rows, f"{tmp_path}/t")
    got = (tmp_path / "t" / "table.csv").read_text().splitlines()
    assert got == ["id,name", *(f'{k},"a,{k}"' for k in range(1000))]
    with pytest.raises(FileExistsError):
        text.write_table(rows, f"{tmp_path}/t")
    text.write_table(rows.limit(1), f"{tmp_path}/t", "overwrite")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").count() == 1


def test_contigs_must_agree(spark):
    same = spark.createDataFrame([("a", 5), ("a", 5), ("b", 1)], "contig string, len long")
    assert sorted(tuple(r) for r in text.contigs(same).collect()) == [("a", 5), ("b", 1)]
    with pytest.raises(Exception, match="disagree"):
        text.contigs(same.union(spark.createDataFrame([("a", 6)], same.schema))).collect()


def records(n=500, seed=0):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        seq = "".join(rnd.choices("ACGTN", k=rnd.choice([20, 21])))
        rows.append((rnd.choice("ab"), rnd.randrange(0, 60_000), rnd.choice([0, 16, 99]), 60, f"5M{rnd.randrange(1, 9)}N{len(seq) - 5}M", seq, "".join(chr(33 + rnd.randrange(41)) for _ in seq), f"r{k % 9}"))
    return sorted(rows) + [(None, -1, 4, 0, "*", "ACG", "III", "u")]


@pytest.mark.parametrize("index", [True, False])
def test_bam(spark, tmp_path, index):
    rows, path = records(), str(tmp_path / "x.bam")
    bam.write_bam(path, [("a", 100_000), ("b", 100_000)], rows, block=700, index=index)
    spark.dataSource.register(bam.BamSource)
    found = spark.read.format("bam").option("split", "1500").load(path)
    assert sorted(map(str, (tuple(r)[1:] for r in found.collect()))) == sorted(map(str, rows))
    assert found.select("read_id").distinct().count() == len(rows)
    assert (found.rdd.getNumPartitions() > 3) is index
    for contig, start, end in (("b", 20_000, 21_000), ("a", 0, 100_000), ("b", 59_990, 10**6), ("z", 0, 9)):
        part = bam.read_bam(spark, path, contig=contig, start=start, end=end)
        want = [r for r in rows if r[0] == contig and r[1] < end and r[1] + bam._span(r[4]) > start]
        assert sorted(map(str, (tuple(r)[1:] for r in part.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("gap", [0, 1 << 20])
def test_bam_near_many_ranges(spark, tmp_path, index, gap, monkeypatch):
    """Each alignment in a window that a range touches comes once, and little else is read."""
    monkeypatch.setattr(bam, "GAP", gap)
    rnd = random.Random(5)
    rows, path = records(900, 7), str(tmp_path / "x.bam")
    bam.write_bam(path, [("a", 100_000), ("b", 100_000), ("c", 9)], rows, block=700, index=index)
    for count in (1, 3, 9):
        ranges = [(rnd.choice("abz"), s := rnd.randrange(-50, 70_000), s + rnd.randrange(1, 20_000)) for _ in range(count)]
        near = spark.createDataFrame(ranges, "contig string, start_ long, end_ long")
        found = bam.read_bam(spark, path, near=near)
        got = sorted(str(tuple(r)[1:]) for r in found.collect())
        held = lambda r, c, s, e: r[0] == c and r[1] >> 14 <= e - 1 >> 14 and r[1] + bam._span(r[4]) - 1 >> 14 >= max(0, s) >> 14
        assert got == sorted(str(r) for r in rows if any(held(r, *x) for x in ranges))
    reader = bam.BamReader({"path": path, "ranges": '{"a": [[0, 16384], [49152, 65536]], "b": [[16384, 32768]]}'})
    assert len(reader.partitions()) == (1 if not index else 3 if not gap else 2)


def test_a_file_given_twice_counts_twice(spark, tmp_path):
    path = str(tmp_path / "x.bam")
    bam.write_bam(path, [("a", 100_000), ("b", 9)], records(20))
    both = bam.read_bam(spark, path, path)
    assert both.count() == 42 and both.select("read_id").distinct().count() == 42
    assert sorted(tuple(r) for r in bam.header_contigs(spark, path).collect()) == [("a", 100_000), ("b", 9)]


@pytest.fixture
def inputs(tmp_path):
    genome = "ACGT" * 30
    (tmp_path / "g.fa").write_text(f">c\n{genome}\n")
    reads = []
    for k in range(12):
        seq = list(genome[8:48])
        if k < 4:
            seq[0] = "G"  # an A at 8 read as G
        reads.append(("c", 8, 0, 60, "40M", "".join(seq), "I" * 40, f"r{k}"))
    bam.write_bam(str(tmp_path / "x.bam"), [("c", 120)], reads)
    (tmp_path / "r.bed").write_text("c\t0\t60\troi\t0\t+\n")
    (tmp_path / "a.gff3").write_text("c\ts\tgene\t1\t60\t.\t+\n")
    return tmp_path


def test_cli_site(spark, inputs, capsys):
    cli.main(["site", "-i", f"{inputs}/x.bam", "-r", f"{inputs}/g.fa", "-s", "u", "--str-min-mismatches", "4"])
    said = capsys.readouterr()
    assert said.err.strip().endswith("finished with 1 items, processed reads: . 12")
    assert said.out.split() == ["contig,pos,trstrand,refnuc,prednuc,A,C,G,T", "c,8,+,A,A,8,0,4,0"]


def test_cli_roi_with_index(spark, inputs):
    args = ["roi", "-i", f"{inputs}/x.bam", "-r", f"{inputs}/g.fa", "-s", "s", "--rois", f"{inputs}/r.bed", "--annotation", f"{inputs}/a.gff3", "--out-min-mismatches", "4", "--out-min-freq", "0.005", "-o", f"{inputs}/out", "--ei", f"{inputs}/ei", "-n", "run"]
    cli.main(args)
    out = spark.read.option("header", True).csv(f"{inputs}/out").collect()
    assert len(out) == 1 and (out[0]["trstrand"], out[0]["A->G"], out[0]["coverage"], out[0]["#A"]) == ("+", "4", "12", "15")
    args[args.index(f"{inputs}/out")] = f"{inputs}/out2"
    cli.main(args)
    assert (inputs / "ei").read_text().count("experiment") == 1
    ei = spark.read.option("header", True).csv(f"{inputs}/ei").collect()
    assert len(ei) == 2 and float(ei[0]["A->G"]) == pytest.approx(4 / 120)


@pytest.mark.parametrize("args", [["site"], ["site", "-i", "/nowhere", "-r", "/nowhere", "-s", "u"], ["other"]])
def test_cli_rejects(args):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(args)


def test_streaming_counts(spark, tmp_path):
    schema = "read_id bigint, contig string, pos bigint, flags int, mapq int, cigar string, seq string, qual string"
    first = spark.createDataFrame([(1, "c", 0, 0, 60, "3M", "ACG", "III")], schema)
    first.write.parquet(str(tmp_path / "in"))
    query = streaming.start(streaming.read_stream(spark, str(tmp_path / "in"), first.schema), str(tmp_path / "state"), "running")
    try:
        query.processAllAvailable()
        first.write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        assert sorted((r["pos"], r["A"], r["C"], r["G"]) for r in spark.table("running").collect()) == [(0, 2, 0, 0), (1, 0, 2, 0), (2, 0, 0, 2)]
    finally:
        query.stop()
