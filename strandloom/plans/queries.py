"""One query per operator over the views of ``sources.fixtures``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nucleotides import ACGT, coverage, mismatches, most_frequent, normalize, symbol
from ..functions.strands import DESIGNS, FIRST, deduce, of_read
from ..operators import filters, intervals, pileup, refpred, rois, sites, strand
from .. import cli
from ..sources import bam, bcf, text
from ..sources.fixtures import Fixtures
from . import analyses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Thresholds that the fixtures' coverage of about 20 can pass.
SITE_EDITING = {"least": 3, "least_freq": 0.05}
ROI_EDITING = {"least": 10, "least_freq": 0.05}
UTR3 = 25


def query(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
    return f


def _passed(x: Fixtures) -> DataFrame:
    return x.reads().where(filters.reads())


def _bases(x: Fixtures, design: str = "u") -> DataFrame:
    return pileup.bases(_passed(x), design)


def _pieces(x: Fixtures, design: str = "u") -> DataFrame:
    return pileup.pieces(_passed(x), design)


def _counted(x: Fixtures) -> DataFrame:
    """Covered positions with reference base and counts."""
    return pileup.positions(_pieces(x), tiles=x.tiles())


def _sites(x: Fixtures) -> DataFrame:
    return sites.site_table(x.tiles(), _pieces(x))


def _force_rois(x: Fixtures) -> DataFrame:
    """Regions on the forward strand are forced: those of the other strands have to pass."""
    return x.rois().where("strand = '+'")


def _table(x: Fixtures, exclude: bool = False) -> DataFrame:
    return rois.roi_table(x.rois(), x.tiles(), _passed(x), x.exclude() if exclude else None)


def _near(x: Fixtures) -> DataFrame:
    """What reads have near the regions only, as the region table counts it."""
    ranges = x.rois().select("contig", F.col("start_").alias("r_start"), F.col("end_").alias("r_end"))
    return pileup.pieces(_passed(x), within=ranges)


def _lower(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({n: f"n_{n.lower()}" for n in ACGT})


@query
def scan_reads(x):
    """Alignments that overlap c1:100-400."""
    end = F.col("pos") + pileup.reference_length(F.col("cigar"))
    return x.reads().where((F.col("contig") == "c1") & (F.col("pos") < 400) & (end > 100))


@query
def pool_replicates(x):
    reads = _passed(x)
    again = reads.withColumn("read_id", -F.col("read_id") - 1)
    return _lower(pileup.pileup(pileup.pieces(reads.unionByName(again))))


@query
def contigs(x):
    lengths = x.genome().groupBy("contig").agg((F.max("pos") + 1).alias("len"))
    return text.contigs(lengths.unionByName(lengths))


@query
def scan_fasta(x):
    return text.fetch(x.tiles(), x.rois(), "roi_id")


@query
def scan_bed(x):
    line = F.concat_ws("\t", "contig", "start_", "end_", "name", F.lit("0"), "strand")
    return text.parse_bed(x.rois().select(line.alias("value")))


@query
def scan_gff(x):
    line = F.concat_ws("\t", "contig", F.lit("src"), "type", "start1", "end1", F.lit("."), "strand", F.lit("."), F.lit("ID=x"))
    return text.parse_gff(x.gff_raw().select(line.alias("value")))


@query
def scan_vcf(x):
    line = F.concat_ws("\t", "contig", "pos1", F.lit("."), "ref", "alt", F.lit("50"), "filter_", F.lit("."), F.lit("DP:GT"), F.concat(F.lit("9:"), F.col("gt")))
    return text.parse_vcf(x.vcf_raw().select(line.alias("value")))


def site_output_of(x: Fixtures) -> DataFrame:
    options = analyses.Options(strand_least_mismatches=SITE_EDITING["least"])
    return _site_columns(analyses.site_analysis(x.reads(), x.tiles(), options, gff=x.gff()))


@query
def site_output(x):
    return site_output_of(x)


def _site_columns(df: DataFrame) -> DataFrame:
    return df.select(*sites.COLUMNS)


def roi_output_of(x: Fixtures) -> DataFrame:
    options = analyses.Options(strand_least_mismatches=ROI_EDITING["least"])
    return analyses.roi_analysis(x.reads(), x.tiles(), x.rois(), options, exclude=x.exclude(), gff=x.gff())


@query
def roi_output(x):
    return roi_output_of(x)


@query
def filter_flags(x):
    return x.reads().where(filters.by_flags(include=3)).select("read_id", "flags")


@query
def filter_mapq(x):
    return x.reads().where(filters.by_mapq(10, no_255=True)).select("read_id", "mapq")


@query
def filter_baseq(x):
    return pileup.bases(x.reads(), phred=30).groupBy("read_id").agg(F.count("*").alias("n"))


@query
def trim_bases(x):
    return pileup.bases(x.reads(), trim5=3, trim3=5, phred=0).select("read_id", "contig", "pos", "base")


@query
def normalize_base(x):
    return x.genome().groupBy(normalize(F.lower("refnuc")).alias("base")).agg(F.count("*").alias("n"))


@query
def site_threshold(x):
    return _lower(_sites(x).where(filters.site_threshold()).select("contig", "pos", "refnuc", "n1", *ACGT))


@query
def roi_threshold(x):
    return _table(x).where(filters.roi_threshold()).select("roi_id", "coverage")


@query
def roi_matrix(x):
    return rois.matrix(rois.regions(x.rois()), x.tiles(), _near(x)).drop("trstrand")


@query
def vcf_genotype(x):
    return refpred.genotypes(x.vcf())


@query
def site_region(x):
    return _lower(sites.restrict(_counted(x), include=x.rois()).select("contig", "pos", *ACGT))


@query
def site_exclude(x):
    return _lower(sites.restrict(_counted(x), exclude=x.exclude()).select("contig", "pos", *ACGT))


@query
def roi_exclude(x):
    return rois.regions(x.rois(), x.exclude()).select("roi_id", "post_start", "post_end", "nucmasked", F.size("pieces").cast("bigint").alias("n_pieces"))


@query
def cigar_explode(x):
    return pileup.bases(x.reads(), phred=0).select("read_id", "contig", "pos", "base")


@query
def matched_blocks(x):
    return pileup.matched_blocks(x.reads())


@query
def split_intervals(x):
    return intervals.split(x.rois().select("roi_id", "contig", "start_", "end_"), 50)


@query
def greedy_bins(x):
    return intervals.greedy_bins(x.rois(), 500)


@query
def annotation_segments(x):
    return intervals.segments(x.rois(), x.gff(), "roi_id")


@query
def interval_subtract(x):
    cut = intervals.subtract(x.rois(), x.exclude(), "roi_id")
    return cut.select("roi_id", F.explode("pieces").alias("p")).select("roi_id", "p.start_", "p.end_")


@query
def utr3_extension(x):
    return strand.utr3_extension(x.gff(), UTR3).drop("class")


@query
def roi_read_coverage(x):
    return rois.read_coverage(rois.regions(x.rois(), x.exclude()), _passed(x)).drop("trstrand")


@query
def join_reference(x):
    return _lower(refpred.filled(x.genome(), pileup.pileup(_pieces(x))))


@query
def vcf_reference(x):
    called = refpred.with_variants(x.genome(), refpred.genotypes(x.vcf()))
    return called.select("contig", "pos", "refnuc", symbol(F.col("n1"), F.col("n2")).alias("prednuc"))


@query
def strand_by_annotation_roi(x):
    return strand.by_annotation(x.rois().drop("strand"), strand.features(x.gff(), UTR3), ["roi_id"], "start_", "end_")


@query
def strand_by_annotation_site(x):
    at = x.genome().withColumn("stop", F.col("pos") + 1)
    return strand.by_annotation(at, strand.features(x.gff(), UTR3), ["contig", "pos"], "pos", "stop")


@query
def roi_force(x):
    return rois.keep(_table(x, True), _force_rois(x)).select("roi_id", "coverage")


@query
def site_force(x):
    found = sites.keep(_sites(x), sites.forced(x.tiles(), _pieces(x), x.exclude()))
    return _lower(found.select("contig", "pos", "trstrand", "refnuc", "n1", *ACGT))


@query
def pileup_unstranded(x):
    return _lower(pileup.pileup(_pieces(x)))


@query
def pileup_stranded(x):
    return _lower(pileup.stranded_pileup(_pieces(x, "s/f"), "s/f"))


@query
def mapped_reads(x):
    return pileup.mapped_reads(_bases(x, "f/s"))


@query
def autoref(x):
    return refpred.autoref(_counted(x)).select("contig", "pos", "refnuc", "n1")


@query
def site_coverage_mismatch(x):
    return _counted(x).select("contig", "pos", coverage().alias("cov"), mismatches(F.col("refnuc")).alias("mm"))


@query
def most_frequent_base(x):
    return _counted(x).select("contig", "pos", most_frequent().alias("base"))


@query
def editing_index(x):
    options = analyses.Options(design="s/f")
    return analyses.editing_index(x.reads(), x.tiles(), x.rois(), options, exclude=x.exclude(), experiment="fixture", roi_file="rois")


@query
def bed_bases(x):
    size = F.col("end_") - F.col("start_")
    return x.rois().groupBy("contig").agg(F.sum(size).alias("bases"), F.max(size).alias("longest"))


@query
def prednuc_symbol(x):
    return refpred.genotypes(x.vcf()).select("contig", "pos", symbol(F.col("n1"), F.col("n2")).alias("prednuc"))


@query
def complement(x):
    counted = _counted(x)
    return counted.select("contig", "pos", F.col("T").alias("n_a"), F.col("G").alias("n_c"), F.col("C").alias("n_g"), F.col("A").alias("n_t"))


@query
def read_strand(x):
    flags = F.col("flags")
    return x.reads().select("read_id", of_read(flags).alias("strand"), (flags.bitwiseAND(F.lit(FIRST)) != 0).alias("is_first"))


@query
def strand_deduce(x):
    names = {d: f"by_{d.replace('/', '_')}" for d in DESIGNS}
    return x.reads().select("read_id", *[deduce(F.col("flags"), d).alias(n) for d, n in names.items()])


@query
def autoref_hyperedit(x):
    return refpred.autoref(_counted(x), least_cov=5, least_freq=0.5, hyperedit=True).select("contig", "pos", "refnuc", "n1")


@query
def strand_by_editing_site(x):
    return _sites(x).select("contig", "pos", strand.by_editing_site(**SITE_EDITING).alias("trstrand"))


@query
def strand_by_editing_roi(x):
    return _table(x).select("roi_id", strand.by_editing_roi(**ROI_EDITING).alias("trstrand"))


@query
def strand_engine(x):
    return rois.stranded(_table(x), strand.features(x.gff(), UTR3), **ROI_EDITING).select("roi_id", "trstrand")


@query
def editing_index_unstranded(x):
    """Strands of regions are predicted, by annotation and then by editing; the rest is counted."""
    options = analyses.Options(strand_least_mismatches=ROI_EDITING["least"])
    return analyses.editing_index(x.reads(), x.tiles(), x.rois(), options, exclude=x.exclude(), gff=x.gff(), experiment="fixture", roi_file="rois")


@query
def run_totals(x):
    """What a run reports: reads by strand, and the items written."""
    options = analyses.Options(strand_least_mismatches=SITE_EDITING["least"])
    items = analyses.site_analysis(x.reads(), x.tiles(), options, gff=x.gff()).agg(F.lit("items").alias("kind"), F.count("*").alias("n"))
    reads = analyses.run_totals(x.reads(), analyses.Options(design="f/s"))
    return reads.select(F.col("trstrand").alias("kind"), F.col("reads").alias("n")).unionByName(items)


def _numbered(x: Fixtures, path: str) -> DataFrame:
    """The rows of a written table with their place in it."""
    rows = x.spark.read.option("header", True).csv(path)
    return rows.withColumn("n", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("bigint"))


@query
def site_file(x):
    """The written site table: its rows in the order of the file."""
    path = x.folder("sites")
    text.write_table(site_output_of(x), path)
    return _numbered(x, path).select("n", "contig", F.col("pos").cast("bigint").alias("pos"), "trstrand")


@query
def roi_file(x):
    path = x.folder("regions")
    text.write_table(roi_output_of(x), path)
    return _numbered(x, path).select("n", "contig", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "trstrand", "name")


@query
def index_file(x):
    """A run's index appended to a file twice: one header, two rows."""
    path = x.folder("index")
    options = analyses.Options(design="s/f")
    for name in ("one", "two"):
        row = analyses.editing_index(x.reads(), x.tiles(), x.rois(), options, exclude=x.exclude(), experiment=name, roi_file="rois")
        text.append_index(row.select("experiment", "ROI-file", "#unstranded"), path)
    return x.spark.read.text(path).select(F.col("value").alias("line"))


@query
def bam_file(x):
    """All alignments, written to sorted BAM files and read again."""
    return _from_bam(bam.read_bam(x.spark, *x.bam_files()))


@query
def bam_region(x):
    """Alignments that overlap c1:100-400, found by the files' indexes."""
    return _from_bam(bam.read_bam(x.spark, *x.bam_files(), contig="c1", start=100, end=400))


def _from_bam(reads: DataFrame) -> DataFrame:
    return reads.select(F.substring("name", 2, 30).cast("bigint").alias("read_id"), "contig", "pos", "flags", "mapq", "cigar", "seq", "qual")


@query
def bam_contigs(x):
    return text.contigs(bam.header_contigs(x.spark, *x.bam_files()))


@query
def fasta_file(x):
    """Regions' bases from a FASTA file, read in pieces by its index."""
    return text.fetch(text.read_fasta(x.spark, x.fasta_file(), split=8192), x.rois(), "roi_id")


@query
def fasta_without_index(x):
    return text.fetch(text.read_fasta(x.spark, x.fasta_file(index=False)), x.rois(), "roi_id")


@query
def bed_file(x):
    return text.read_bed(x.spark, x.bed_file(x.rois(), "rois"))


@query
def gff_file(x):
    return text.read_gff(x.spark, x.gff_file())


@query
def vcf_file(x):
    return text.read_vcf(x.spark, x.vcf_file())


@query
def bcf_file(x):
    return bcf.read_bcf(x.spark, *x.bcf_files())


def _run(x: Fixtures, mode: str, *more: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The command line's run over files, with variants, trimming, exclusions, forced rows and annotation together."""
    args = [mode, "-i", *x.bam_files(), "-r", x.fasta_file(), "-s", "u", "-5", "3", "-3", "5", "--vcf", x.vcf_file(), "--exclude", x.bed_file(x.exclude(), "exclude"), "--annotation", x.gff_file(), "--utr3ext", str(UTR3), *more]
    return cli.run(x.spark, cli.parser().parse_args(args))


def _exons(x: Fixtures) -> DataFrame:
    return x.gff().where("type = 'exon'")


@query
def site_run(x):
    more = ["--region", x.bed_file(x.rois(), "rois"), "--force", x.bed_file(_exons(x), "exons"), "--str-min-mismatches", str(SITE_EDITING["least"])]
    return _site_columns(_run(x, "site", *more)[0])


@query
def roi_run(x):
    more = ["--rois", x.bed_file(x.rois(), "rois"), "--force", x.bed_file(_force_rois(x), "force"), "--str-min-mismatches", str(ROI_EDITING["least"])]
    return _run(x, "roi", *more)[0]


@query
def run_reads(x):
    """The reads by strand that a run over regions reports."""
    more = ["--region", x.bed_file(x.rois(), "rois")]
    return _run(x, "site", *more)[2]


@query
def roi_run_index(x):
    rois = x.bed_file(x.rois(), "rois")
    row = _run(x, "roi", "--rois", rois, "--str-min-mismatches", str(ROI_EDITING["least"]), "--ei", "unused", "-n", "fixture")[1]
    return row.drop("ROI-file")


__all__ = ["QUERIES"]
