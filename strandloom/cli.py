"""``python -m strandloom site|roi``: the analyses over files."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark import SparkConf, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.strands import DESIGNS
from .operators import refpred
from .plans import analyses
from .sources import bam, text


def _within(low: float, high: float, kind=int):
    def check(value: str):
        number = kind(value)
        if not low <= number <= high:
            raise argparse.ArgumentTypeError(f"must be from {low} to {high}")
        return number

    return check


def _file(value: str) -> str:
    if "://" not in value and not Path(value).exists():
        raise argparse.ArgumentTypeError(f"there is no {value}")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    modes = top.add_subparsers(dest="mode", required=True)
    for mode, least in (("site", 3), ("roi", 5)):
        p = modes.add_parser(mode)
        p.add_argument("-i", "--input", nargs="+", required=True, type=_file, help="BAM files; replicates are pooled")
        p.add_argument("-r", "--reference", required=True, type=_file, help="FASTA")
        p.add_argument("-s", "--stranding", required=True, choices=DESIGNS)
        p.add_argument("-n", "--name", default="NA")
        p.add_argument("-o", "--saveto", default="-", help="a folder; - prints")
        p.add_argument("-t", "--threads", type=_within(1, 4096), default=1, help="local cores, where Spark has no master yet")
        p.add_argument("--binsize", type=_within(1, 1_000_000), default=64_000, help="kept for compatibility: Spark partitions by itself")
        p.add_argument("--exclude", type=_file)
        p.add_argument("--mapq", type=_within(0, 254), default=1)
        p.add_argument("--no-mapq-255", action="store_true")
        p.add_argument("--in-flags", type=_within(0, 4095), default=0)
        p.add_argument("--ex-flags", type=_within(0, 4095), default=2820)
        p.add_argument("--phread", type=_within(0, 255), default=20)
        p.add_argument("-5", "--trim5", type=_within(0, 65535), default=0)
        p.add_argument("-3", "--trim3", type=_within(0, 65535), default=0)
        p.add_argument("--annotation", type=_file)
        p.add_argument("--utr3ext", type=_within(0, 10**9), default=0)
        p.add_argument("--str-min-mismatches", type=_within(0, 10**9), default=50)
        p.add_argument("--str-min-freq", type=_within(0, 1, float), default=0.05)
        p.add_argument("--vcf", type=_file)
        p.add_argument("--ref-min-cov", type=_within(0, 10**9), default=20)
        p.add_argument("--ref-min-freq", type=_within(0, 1, float), default=0.95)
        p.add_argument("--hyperedit", action="store_true")
        p.add_argument("--out-min-cov", type=_within(0, 10**9), default=10)
        p.add_argument("--out-min-mismatches", type=_within(0, 10**9), default=least)
        p.add_argument("--out-min-freq", type=_within(0, 1, float), default=0.01)
        p.add_argument("--force", type=_file)
        if mode == "roi":
            p.add_argument("--rois", required=True, type=_file)
            p.add_argument("--ei", help="a file to which the editing index is appended; a new one gets a header")
        else:
            p.add_argument("--region", type=_file)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The result table, the editing index where one is asked for, and the run's reads by strand."""
    options = analyses.Options(
        design=args.stranding, include_flags=args.in_flags, exclude_flags=args.ex_flags, mapq=args.mapq, no_mapq_255=args.no_mapq_255, phred=args.phread,
        trim5=args.trim5, trim3=args.trim3, ref_least_cov=args.ref_min_cov, ref_least_freq=args.ref_min_freq, hyperedit=args.hyperedit, utr3=args.utr3ext,
        strand_least_mismatches=args.str_min_mismatches, strand_least_freq=args.str_min_freq,
        thresholds={"least_cov": args.out_min_cov, "least_mism": args.out_min_mismatches, "least_freq": args.out_min_freq},
    )
    text.contigs(bam.header_contigs(spark, *args.input)).collect()  # headers must agree
    bed = {k: text.read_bed(spark, getattr(args, k)) if getattr(args, k, None) else None for k in ("exclude", "force", "region", "rois")}
    # Files are decoded once, and only near the regions: bases, coverage and totals read what is left after the filters.
    regions = bed["rois"] if args.mode == "roi" else bed["region"]
    found = bam.read_bam(spark, *args.input, near=regions)
    reads = options.passing(found.where(F.col("contig").isNotNull())).drop("name").persist(StorageLevel.DISK_ONLY)
    tiles = text.read_fasta(spark, args.reference)
    gff = text.read_gff(spark, args.annotation) if args.annotation else None
    variants = refpred.genotypes(text.read_vcf(spark, args.vcf)) if args.vcf else None
    totals = analyses.run_totals(reads, options, regions)
    if args.mode == "site":
        table = analyses.site_analysis(reads, tiles, options, include=bed["region"], exclude=bed["exclude"], force=bed["force"], gff=gff, variants=variants)
        return table, None, totals
    rois = text.read_regions(spark, args.rois)
    # The output and the index are made of one table, a row for each region and strand.
    rows = analyses.roi_rows(reads, tiles, rois, options, exclude=bed["exclude"], variants=variants).persist(StorageLevel.DISK_ONLY)
    index = analyses.indexed(rows, options, gff, args.name, args.rois) if args.ei else None
    return analyses.finished(rows, options, bed["force"], gff), index, totals


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName(f"strandloom {args.mode}")
        submitted = "spark.master" in dict(SparkConf().getAll())
        spark = (builder if submitted else builder.master(f"local[{args.threads}]")).getOrCreate()
    found, index, totals = run(spark, args)
    if args.saveto == "-":
        items = 0
        print(",".join(found.columns))
        for row in found.toLocalIterator():
            items += 1
            print(",".join("" if v is None else str(v) for v in row))
    else:
        text.write_table(found, args.saveto)
        items = spark.read.option("header", True).csv(args.saveto).count()
    if index is not None:
        text.append_index(index, args.ei)
    by_strand = ", ".join(f"{r['trstrand']} {r['reads']}" for r in totals.orderBy("trstrand").collect())
    print(f"finished with {items} items, processed reads: {by_strand}", file=sys.stderr)
    spark.catalog.clearCache()
