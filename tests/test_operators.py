"""Cases of single operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import nucleotides as nuc
from strandloom.functions import strands
from strandloom.operators import filters, index, pileup, refpred, rois, sites, strand

READ = "read_id bigint, contig string, pos bigint, flags int, mapq int, cigar string, seq string, qual string"
SITE = "contig string, pos bigint, refnuc string, n1 string, n2 string, A bigint, C bigint, G bigint, T bigint"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column).first()[0]


def read(seq, cigar, pos=0, flags=0, qual=None, rid=1):
    return rid, "c", pos, flags, 60, cigar, seq, qual or "I" * len(seq)


def observed(spark, reads, **options):
    return [(r["pos"], r["base"]) for r in pileup.bases(spark.createDataFrame(reads, READ), **options).orderBy("pos").collect()]


def test_flags(spark):
    """By the rule itself: every bit of include is there and none of exclude; each bit of either mask is tried alone."""
    include, exclude = 0b1000_0010, 0b0100_0001_0100
    wanted = [include, include | 1 << 9, 0xFFF & ~exclude]
    missing = [include & ~(1 << bit) for bit in range(12) if include >> bit & 1]
    excluded = [include | 1 << bit for bit in range(12) if exclude >> bit & 1]
    rows = spark.createDataFrame([(f,) for f in [*wanted, *missing, *excluded, 0]], "flags int")
    passed = [r["flags"] for r in rows.where(filters.by_flags(include, exclude)).collect()]
    assert sorted(passed) == sorted(wanted)
    assert rows.where(filters.by_flags(0, 0)).count() == rows.count()


@pytest.mark.parametrize(("mapq", "least", "no255", "passed"), [(0, 1, False, False), (1, 1, False, True), (255, 1, False, True), (255, 1, True, False), (254, 254, True, True)])
def test_mapq(spark, mapq, least, no255, passed):
    assert one(spark, filters.by_mapq(least, no255), mapq=mapq) is passed


@pytest.mark.parametrize(
    ("seq", "cigar", "want"),
    [
        ("AGC", "1M2N2M", [(0, "A"), (3, "G"), (4, "C")]),
        ("ACGT", "4M", [(0, "A"), (1, "C"), (2, "G"), (3, "T")]),
        ("ACGT", "1S3M", [(0, "C"), (1, "G"), (2, "T")]),
        ("ACGT", "5H2=1X1M", [(0, "A"), (1, "C"), (2, "G"), (3, "T")]),
        ("ACGT", "2M1I1M", [(0, "A"), (1, "C"), (2, "T")]),
        ("ACGT", "2M3D2M", [(0, "A"), (1, "C"), (5, "G"), (6, "T")]),
        ("ACGT", "2M2P2M", [(0, "A"), (1, "C"), (2, "G"), (3, "T")]),
        ("aRnt", "4M", [(0, "A"), (1, "N"), (2, "N"), (3, "T")]),
        ("", "*", []),
        ("AC", "2S", []),
    ],
)
def test_cigar(spark, seq, cigar, want):
    assert observed(spark, [read(seq, cigar)]) == want


@pytest.mark.parametrize(("flags", "want"), [(0, [(1, "C")]), (16, [(2, "G")])])
def test_trimming(spark, flags, want):
    assert observed(spark, [read("ACGT", "4M", flags=flags)], trim5=1, trim3=2) == want


def test_trimming_a_short_read_drops_it(spark):
    assert observed(spark, [read("ACG", "3M")], trim5=1, trim3=2) == []


def test_base_quality(spark):
    assert observed(spark, [read("ACG", "3M", qual="4!5")]) == [(2, "G")]


def test_matched_blocks(spark):
    reads = spark.createDataFrame([read("ACNGTAC", "4M2N3M", qual="III!III")], READ)
    assert sorted((r["start_"], r["end_"]) for r in pileup.matched_blocks(reads).collect()) == [(0, 3), (6, 9)]
    cut = spark.createDataFrame([read("AGCC", "1M2N3M")], READ)
    assert sorted((r["start_"], r["end_"]) for r in pileup.matched_blocks(cut, trim3=1).collect()) == [(0, 1), (3, 5)]


def test_a_read_past_the_contigs_end_is_kept(spark):
    assert observed(spark, [read("ACGT", "4M", pos=98)])[-1] == (101, "T")


@pytest.mark.parametrize(("counts", "base"), [((0, 0, 0, 0), "A"), ((1, 1, 1, 1), "A"), ((1, 2, 2, 1), "C"), ((0, 0, 3, 3), "G"), ((0, 0, 0, 1), "T")])
def test_most_frequent(spark, counts, base):
    assert one(spark, nuc.most_frequent(), **dict(zip("ACGT", counts))) == base


@pytest.mark.parametrize(("reference", "want"), [("A", 9), ("C", 8), ("G", 7), ("T", 6), ("N", 10)])
def test_mismatches(spark, reference, want):
    assert one(spark, nuc.mismatches(F.lit(reference)), A=1, C=2, G=3, T=4) == want


@pytest.mark.parametrize(("n1", "n2", "want"), [("A", None, "A"), ("T", "G", "G/T"), ("N", "A", "N"), ("N", None, "N")])
def test_symbol(spark, n1, n2, want):
    assert one(spark, nuc.symbol(F.lit(n1), F.lit(n2).cast("string"))) == want


@pytest.mark.parametrize(("part", "whole", "least", "want"), [(81, 100, 0.81, True), (4, 10, 0.4, True), (4, 10, 0.41, False), (0, 0, 0.0, False)])
def test_frequency_is_single_precision(spark, part, whole, least, want):
    assert one(spark, nuc.frequent(F.lit(part), F.lit(whole), least)) is want


def test_strands_by_design(spark):
    flags = {"+1": 64, "-1": 80, "+2": 128, "-2": 144, "+": 0, "-": 16}
    want = {"u": "......", "s": "+-+-+-", "f": "-+-+-+", "s/f": "+--+-+", "f/s": "-++-+-"}
    for design, strands_ in want.items():
        assert "".join(one(spark, strands.deduce(F.lit(f), design)) for f in flags.values()) == strands_
    with pytest.raises(ValueError):
        strands.deduce(F.lit(0), "x")


def site(spark, n1, n2, counts, **more):
    return spark.createDataFrame([("c", 1, "A", n1, n2, *counts)], SITE)


@pytest.mark.parametrize(
    ("n1", "n2", "counts", "want"),
    [("A", None, (7, 0, 3, 0), True), ("A", None, (8, 0, 2, 0), False), ("A", None, (6, 0, 3, 0), False), ("A", "G", (7, 0, 3, 0), True), ("N", None, (10, 0, 0, 0), True), ("A", None, (0, 0, 0, 0), False)],
)
def test_site_threshold(spark, n1, n2, counts, want):
    assert (site(spark, n1, n2, counts).where(filters.site_threshold()).count() == 1) is want


def test_zero_coverage_fails_even_without_thresholds(spark):
    assert site(spark, "A", None, (0, 0, 0, 0)).where(filters.site_threshold(0, 0, 0.0)).count() == 0


@pytest.mark.parametrize(
    ("assembly", "counts", "cov", "freq", "hyper", "want"),
    [
        ("G", (1, 13, 0, 2), 16, 0.8125, False, "C"),  # coverage and frequency at their bounds
        ("G", (1, 13, 0, 2), 17, 0.5, False, "G"),
        ("G", (1, 13, 0, 2), 1, 0.82, False, "G"),
        ("A", (1, 0, 30, 0), 5, 0.9, True, "A"),  # may be edited in full
        ("A", (1, 0, 30, 0), 5, 0.9, False, "G"),
        ("A", (1, 30, 0, 0), 5, 0.9, True, "C"),
        ("T", (0, 30, 0, 1), 5, 0.9, True, "T"),
        ("C", (0, 1, 0, 30), 5, 0.9, True, "T"),  # the other way round it isn't editing
        ("N", (0, 0, 7, 0), 5, 0.9, True, "G"),
        ("T", (6, 6, 0, 0), 5, 0.5, False, "A"),
        ("T", (0, 0, 0, 0), 0, 0.0, False, "T"),
    ],
)
def test_autoref(spark, assembly, counts, cov, freq, hyper, want):
    assert one(spark, refpred.infer(F.lit(assembly), cov, freq, hyper), **dict(zip("ACGT", counts))) == want


@pytest.mark.parametrize(
    ("n1", "n2", "counts", "want"),
    [
        ("A", None, (57, 0, 3, 0), "+"), ("A", None, (58, 0, 3, 0), "."), ("A", None, (9, 0, 2, 0), "."), ("A", None, (9, 40, 3, 40), "+"),
        ("T", None, (0, 3, 0, 57), "-"), ("T", None, (3, 0, 0, 57), "."), ("G", None, (3, 0, 57, 0), "."), ("N", None, (9, 9, 9, 9), "."),
        ("A", "G", (5, 0, 5, 0), "+"), ("C", "T", (0, 5, 0, 5), "-"), ("A", "T", (5, 5, 5, 5), "."), ("A", "T", (5, 2, 5, 5), "+"), ("C", "G", (5, 5, 5, 5), "."),
    ],
)
def test_site_editing(spark, n1, n2, counts, want):
    """Three at least, and a twentieth of those that are the allele or its edited form."""
    assert site(spark, n1, n2, counts).select(strand.by_editing_site(3, 0.05)).first()[0] == want


@pytest.mark.parametrize(
    ("aa", "ag", "tt", "tc", "want"),
    [(95, 5, 100, 0, "+"), (100, 0, 95, 5, "-"), (96, 5, 100, 0, "."), (0, 4, 0, 0, "."), (60, 20, 60, 20, "."), (60, 20, 61, 20, "+"), (61, 20, 60, 20, "-"), (0, 5, 9, 4, "+"), (0, 0, 0, 0, ".")],
)
def test_roi_editing(spark, aa, ag, tt, tc, want):
    """Five at least and a twentieth; where both sides hold, the more frequent one."""
    assert one(spark, strand.by_editing_roi(5, 0.05), a_to_a=aa, a_to_g=ag, t_to_t=tt, t_to_c=tc) == want


def test_annotation(spark):
    gff = spark.createDataFrame([("c", 10, 20, "gene", "+"), ("c", 12, 15, "exon", "-"), ("c", 30, 40, "gene", "-"), ("c", 35, 50, "gene", "+")], "contig string, start_ long, end_ long, type string, strand string")
    rows = spark.createDataFrame([(k, "c", s, e) for k, (s, e) in enumerate([(0, 5), (10, 12), (11, 13), (16, 20), (30, 35), (36, 37), (20, 22), (28, 30)])], "k long, contig string, s long, e long")
    got = {r["k"]: r["strand"] for r in strand.by_annotation(rows, strand.features(gff, 2), ["k"], "s", "e").collect()}
    assert got == {1: "+", 2: "-", 3: "+", 4: "-", 5: ".", 6: "+", 7: "-"}


@pytest.mark.parametrize(("length", "want"), [(0, 0), (2, 3), (100, 3)])
def test_utr3(spark, length, want):
    gff = spark.createDataFrame([("c", 10, 20, "gene", "+"), ("c", 30, 40, "gene", "-"), ("c", 35, 50, "Gene", "+"), ("c", 1, 2, "exon", "+")], "contig string, start_ long, end_ long, type string, strand string")
    made = strand.features(gff, length).where("class = 'utr3'")
    assert made.count() == want
    if length == 100:
        assert ("c", -70, 30, "-") in [tuple(r)[:4] for r in made.collect()]


def test_genotypes(spark):
    cases = [("A", "G", "0/1"), ("A", "G", "1|1"), ("A", "G,T", "1/2"), ("A", "G", "0/0"), ("A", "G", "./1"), ("A", "G", "."), ("A", "GT", "0/1"), ("AT", "c", "1/1"), ("AT", "A", "0/1"), ("A", "G", "0/1/1"), ("A", "G", "1"), ("A", "G", "0")]
    vcf = spark.createDataFrame([("c", k, *c[:2], "PASS", c[2]) for k, c in enumerate(cases)] + [("c", 90, "A", "G", "q10", "0/1"), ("c", 91, "A", "G", ".", "0/1")], "contig string, pos long, ref string, alt string, filter_ string, gt string")
    got = {r["pos"]: (r["n1"], r["n2"]) for r in refpred.genotypes(vcf).collect()}
    assert got == {0: ("A", "G"), 1: ("G", None), 2: ("G", "T"), 4: ("G", None), 7: ("C", None), 10: ("G", None), 91: ("A", "G")}


def genome(spark, letters):
    return spark.createDataFrame([("c", 0, letters)], "contig string, tile long, seq string")


def test_forced_sites(spark):
    ref, reads = genome(spark, "ACGTA"), spark.createDataFrame([read("ACG", "3M", rid=k) for k in range(3)], READ)
    force = spark.createDataFrame([("c", 2, 4)], "contig string, start_ long, end_ long")
    for design, want in (("u", [(2, ".", 3), (3, ".", 0)]), ("s", [(2, "+", 3), (2, "-", 0), (3, "+", 0), (3, "-", 0)])):
        observed = pileup.bases(reads, design)
        found = sites.keep(sites.site_table(ref, observed, design), sites.forced(ref, observed, force, design))
        assert sorted((r["pos"], r["trstrand"], r["G"]) for r in found.collect()) == want


def test_regions_and_index(spark):
    ref = genome(spark, "AAAATTNA")
    reads = spark.createDataFrame([read("AAGATTCA", "8M", rid=k, flags=0 if k < 6 else 16) for k in range(10)], READ)
    regions = spark.createDataFrame([(1, "c", 0, 8, "x", "+"), (2, "c", 0, 8, "x", "+"), (3, "c", 1, 3, "", ".")], "roi_id long, contig string, start_ long, end_ long, name string, strand string")
    exclude = spark.createDataFrame([("c", 1, 3), ("c", 5, 6)], "contig string, start_ long, end_ long")
    assembly = refpred.assembly_only
    table = rois.roi_table(regions, ref, reads, exclude, "s", assembly).orderBy("roi_id", "trstrand").collect()
    assert [(r["roi_id"], r["trstrand"], r["coverage"], r["nucmasked"], r["n_a"], r["a_to_a"], r["t_to_t"]) for r in table] == [(1, "+", 6, 3, 3, 18, 6), (1, "-", 4, 3, 3, 12, 4), (2, "+", 6, 3, 3, 18, 6), (2, "-", 4, 3, 3, 12, 4)]
    full = rois.roi_table(regions, ref, reads, None, "s", assembly)
    row = index.editing_index(full, "e", "r").first()
    assert row["#unstranded"] == 0
    sums = index.sums(full).first()
    assert sums["a_to_g"] == 6 * 3 and sums["t_to_c"] == 4 * 3 and sums["t_to_t"] == (6 * 2 * 2) + 4 * (4 * 2 + 1)
    assert row["G->A"] is None
    force = spark.createDataFrame([("c", 0, 8, "x", "+")], "contig string, start_ long, end_ long, name string, strand string")
    kept = rois.keep(full, force, least_cov=10**6).collect()
    assert sorted((r["roi_id"], r["trstrand"]) for r in kept) == [(1, "+"), (1, "-"), (2, "+"), (2, "-")]


def test_forced_sites_have_their_variants(spark):
    """Also where no read is; and a site that passes and is forced comes once."""
    ref, reads = genome(spark, "ACGTA"), spark.createDataFrame([read("AT", "2M", rid=k) for k in range(12)], READ)
    calls = spark.createDataFrame([("c", 4, "C", "G"), ("c", 1, "G", None)], "contig string, pos long, n1 string, n2 string")
    force = spark.createDataFrame([("c", 1, 2), ("c", 3, 99)], "contig string, start_ long, end_ long")
    predictor = lambda at: refpred.with_variants(at, calls)
    observed = pileup.bases(reads)
    found = sites.keep(sites.site_table(ref, observed, "u", predictor), sites.forced(ref, observed, force, "u", predictor))
    assert sorted((r["pos"], r["n1"], r["n2"], r["T"]) for r in found.collect()) == [(1, "G", None, 12), (3, "T", None, 0), (4, "C", "G", 0)]


def test_bases_within_ranges_are_all_that_ranges_hold(spark):
    """Blocks are cut at buckets: nothing in a range is lost, and nothing comes twice."""
    reads = spark.createDataFrame([read("ACGT" * 300, "500M2000N700M", pos=k * 37, rid=k) for k in range(20)], READ)
    ranges = spark.createDataFrame([("c", 600, 620), ("c", 610, 1030), ("c", 1023, 1025), ("c", 3000, 3001), ("d", 0, 9999)], "contig string, r_start long, r_end long")
    whole = [(r["read_id"], r["pos"], r["base"]) for r in pileup.bases(reads).collect()]
    some = [(r["read_id"], r["pos"], r["base"]) for r in pileup.bases(reads, within=ranges).collect()]
    held = lambda p: 600 <= p < 1030 or p == 3000
    assert len(some) == len(set(some)) < len(whole) and set(some) <= set(whole)
    assert {x for x in some if held(x[1])} == {x for x in whole if held(x[1])}


def test_matched_runs_of_long_reads(spark):
    """Against a walk over each base."""
    import random

    rnd = random.Random(4)
    rows = [read("".join(rnd.choices("ACGTN", k=180)), f"{rnd.randrange(1, 90)}M7N{90}M", pos=k, rid=k, qual="".join(rnd.choices("!0I5~", k=180))) for k in range(30)]
    for phred in (0, 15, 20, 95):
        want = []
        for rid, _, pos, _, _, cigar, _, qual in rows:
            first = int(cigar.split("M")[0])
            for start, marks in ((pos, qual[:first]), (pos + first + 7, qual[first : first + 90])):
                runs = [k for k in range(len(marks) + 1) if k < len(marks) and ord(marks[k]) - 33 >= phred]
                for k in runs:
                    if want and want[-1][0] == rid and want[-1][2] == start + k and k:
                        want[-1][2] += 1
                    else:
                        want.append([rid, start + k, start + k + 1])
        got = sorted([r["read_id"], r["start_"], r["end_"]] for r in pileup.matched_blocks(spark.createDataFrame(rows, READ), phred=phred).collect())
        assert got == sorted(want)


def test_output_columns(spark):
    assert rois.HEADER[:12] == ["contig", "start", "end", "strand", "name", "trstrand", "coverage", "nucmasked", "heterozygous", "#A", "A->A", "A->C"] and len(rois.HEADER) == 29
    assert sites.COLUMNS == ["contig", "pos", "trstrand", "refnuc", "prednuc", "A", "C", "G", "T"]
    assert len(index.PAIRS) == 16


def mixed_reads(n, seed, contigs="cd"):
    """Reads with introns, gaps of low quality, clips and letters of all kinds; some cross tiles, one place has very many."""
    import random

    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        cigar, size = rnd.choice([("40M", 40), ("10M5N30M", 40), ("3S30M2I5M", 40), ("12M700N28M", 40), ("20=1X1500N9M2D10M", 40), ("60M", 50), ("*", 40), ("5H38M", 40)])
        seq = "".join(rnd.choices("ACGTacgNR", k=size))
        qual = "".join(rnd.choices("!5I", weights=[2, 1, 6], k=rnd.choice([size, size, size, size - 7])))
        rows.append((k, rnd.choice(contigs), rnd.choice([1000, rnd.randrange(900, 3200)]), rnd.choice([0, 16, 64, 83, 99, 128, 147]), 60, cigar, seq, qual))
    return rows


@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("options", [{}, {"trim5": 3, "trim3": 5, "phred": 0}])
def test_counts_of_pieces_are_counts_of_bases(spark, options, dense):
    """Also where a slice's counts of a tile take the place of its pieces; with the genome, ranges and both."""
    from strandloom.operators import kernels

    rows = mixed_reads(300, 7) + [(1000 + k, "c", 2040, 16 * (k % 2), 60, "40M", "ACGTA" * 8, "I" * 40) for k in range(2000 if dense else 3)]
    assert not dense or 2000 * 8 * 2 < kernels.DENSE < 2000 * 24
    reads = spark.createDataFrame(rows, READ)
    for design in ("u", "s/f"):
        want = sorted(tuple(r) for r in pileup.count(pileup.bases(reads, design, **options), "contig", "pos", "trstrand").collect())
        got = sorted((r["contig"], r["pos"], r["trstrand"], r["A"], r["C"], r["G"], r["T"]) for r in pileup.stranded_pileup(pileup.pieces(reads, design, **options), design).collect())
        assert got == want and len(got) > 1500
    import random

    letters = "".join(random.Random(1).choices("ACGTNacgtR", k=3000))
    tiles = spark.createDataFrame([("c", k, letters[k * 1024 : (k + 1) * 1024]) for k in range(3)], "contig string, tile long, seq string")
    counts = {(r["contig"], r["pos"]): tuple(r[n] for n in "ACGT") for r in pileup.pileup(pileup.pieces(reads, **options)).collect()}
    base = {p: x.upper() if x.upper() in "ACGT" else "N" for p, x in enumerate(letters)}
    row = lambda p: ("c", p, base[p], *counts.get(("c", p), (0, 0, 0, 0)))
    covered = {p for c, p in counts if c == "c" and p in base}
    spans = [(-5, 3), (1000, 1050), (1020, 2100), (1020, 1021), (2990, 5000), (7, 7)]
    inside = {p for s, e in spans for p in range(s, e) if p in base}
    ranges = spark.createDataFrame([("c", *x) for x in spans] + [("d", 0, 9)], "contig string, start_ long, end_ long")
    seen = pileup.pieces(reads, **options)
    assert sorted(tuple(r) for r in pileup.positions(seen, tiles=tiles).collect()) == [row(p) for p in sorted(covered)]
    assert sorted(tuple(r) for r in pileup.positions(seen, tiles=tiles, ranges=ranges).collect()) == [row(p) for p in sorted(inside)]
    also = sorted(tuple(r) for r in pileup.positions(seen, tiles=tiles, ranges=ranges, also=True).collect())
    assert also == [(*row(p), p in inside) for p in sorted(covered | inside)]
    near = pileup.pieces(reads, **options, within=ranges.withColumnsRenamed({"start_": "r_start", "end_": "r_end"}))
    assert sorted(tuple(r) for r in pileup.positions(near, tiles=tiles, ranges=ranges).collect()) == [row(p) for p in sorted(inside)]


def test_no_hash_table_of_positions(spark):
    """Counts need no aggregation in Spark: a task's memory doesn't grow with the positions that its reads cover."""
    reads = spark.createDataFrame(mixed_reads(20, 1), READ)
    plan = pileup.pileup(pileup.pieces(reads))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 2


@pytest.mark.parametrize("shortest", [1, 9, 70, 600, 1100])
@pytest.mark.parametrize("design", ["u", "f/s"])
def test_region_coverage_and_matrix_by_brute_force(spark, design, shortest):
    """Regions of one base to several tiles, with introns and gaps that hold some of them whole."""
    import random

    rnd = random.Random(shortest)
    rows = mixed_reads(250, 3)
    reads = spark.createDataFrame(rows, READ)
    letters = "".join(rnd.choices("ACGTN", k=4200))
    tiles = spark.createDataFrame([("c", k, letters[k * 1024 : (k + 1) * 1024]) for k in range(5)], "contig string, tile long, seq string")
    regions = [(k, rnd.choice("cde"), s := rnd.choice([0, 1000, 1024, rnd.randrange(900, 3300)]), s + rnd.choice([shortest, shortest, shortest + rnd.randrange(1500)]), "n", ".") for k in range(60)]
    frame = spark.createDataFrame(regions, "roi_id long, contig string, start_ long, end_ long, name string, strand string")
    runs = [r for r in pileup.matched_blocks(reads).collect()]
    of = {r[0]: one_strand(design, r[3]) for r in rows}
    found = {(r["roi_id"], r["trstrand"]): r for r in rois.roi_table(frame, tiles, reads, None, design, refpred.assembly_only).collect()}
    single = [(r["contig"], r["pos"], r["base"], r["trstrand"]) for r in pileup.bases(reads, design).collect()]
    assert len(found) == 60 * (1 if design == "u" else 2)
    for (k, s), row in found.items():
        _, contig, start, end, *_ = regions[k]
        assert row["coverage"] == len({r["read_id"] for r in runs if r["contig"] == contig and r["start_"] < end and start < r["end_"] and of[r["read_id"]] == s})
        if contig != "c":
            assert row["n_a"] is None
            continue
        assert [row[f"n_{n.lower()}"] for n in "ACGT"] == [letters[start:end].count(n) for n in "ACGT"]
        for a in "ACGT":
            for b in "ACGT":
                assert row[f"{a}_to_{b}".lower()] == sum(c == contig and start <= p < min(end, 4200) and letters[p] == a and x == b and t == s for c, p, x, t in single)


def one_strand(design, flags):
    own, other = "-+" if flags & 16 else "+-"
    return "." if design == "u" else own if bool(flags & 64) == (design == "s/f") else other
