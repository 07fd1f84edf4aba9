"""The three analyses: site table, region table, editing index. Every option is a keyword with its usual default."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, index, pileup, refpred, rois, sites, strand


@dataclass
class Options:
    """What all analyses share."""

    design: str = "u"
    include_flags: int = filters.INCLUDE
    exclude_flags: int = filters.EXCLUDE
    mapq: int = filters.MAPQ
    no_mapq_255: bool = False
    phred: int = filters.PHRED
    trim5: int = 0
    trim3: int = 0
    ref_least_cov: int = 20
    ref_least_freq: float = 0.95
    hyperedit: bool = False
    utr3: int = 0
    strand_least_mismatches: int = strand.LEAST_MISMATCHES
    strand_least_freq: float = strand.LEAST_FREQ
    thresholds: dict = field(default_factory=dict)

    def passing(self, reads: DataFrame) -> DataFrame:
        return reads.where(filters.reads(self.include_flags, self.exclude_flags, self.mapq, self.no_mapq_255))

    def bases(self) -> dict:
        return {"trim5": self.trim5, "trim3": self.trim3, "phred": self.phred}

    def predictor(self, variants: DataFrame | None) -> sites.Predictor:
        """Variants, where given, take the place of the reads."""
        if variants is not None:
            return lambda at: refpred.with_variants(at, variants)
        return lambda at: refpred.autoref(at, self.ref_least_cov, self.ref_least_freq, self.hyperedit)

    def editing(self) -> dict:
        return {"least": self.strand_least_mismatches, "least_freq": self.strand_least_freq}


def site_analysis(
    reads: DataFrame,
    tiles: DataFrame,
    options: Options | None = None,
    *,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    force: DataFrame | None = None,
    gff: DataFrame | None = None,
    variants: DataFrame | None = None,
) -> DataFrame:
    """The site table in its output form. Thresholds come before strand prediction: they drop most rows."""
    o = options or Options()
    near = None if include is None else include.select("contig", F.col("start_").alias("r_start"), F.col("end_").alias("r_end"))
    observed = pileup.pieces(o.passing(reads), o.design, **o.bases(), within=near)
    reach = lambda at: sites.restrict(at, include, exclude)
    found = sites.site_table(tiles, observed, o.design, o.predictor(variants), force, reach)
    kept = sites.keep(found, **o.thresholds)
    return sites.output(sites.stranded(kept, None if gff is None else strand.features(gff, o.utr3), o.design, **o.editing()))


def roi_rows(
    reads: DataFrame,
    tiles: DataFrame,
    regions: DataFrame,
    options: Options | None = None,
    *,
    exclude: DataFrame | None = None,
    variants: DataFrame | None = None,
    covered: bool = True,
) -> DataFrame:
    """Every region and strand, before thresholds and strand prediction."""
    o = options or Options()
    return rois.roi_table(regions, tiles, o.passing(reads), exclude, o.design, o.predictor(variants), covered, **o.bases())


def finished(table: DataFrame, o: Options, force: DataFrame | None = None, gff: DataFrame | None = None) -> DataFrame:
    """The output form of ``roi_rows``."""
    kept = rois.keep(table, force, **o.thresholds)
    return rois.output(rois.stranded(kept, None if gff is None else strand.features(gff, o.utr3), o.design, **o.editing()))


def indexed(table: DataFrame, o: Options, gff: DataFrame | None = None, experiment: str = "NA", roi_file: str = "NA") -> DataFrame:
    """The editing index of ``roi_rows``: all regions count, whether they pass the thresholds or not."""
    known = rois.stranded(table, None if gff is None else strand.features(gff, o.utr3), o.design, **o.editing())
    return index.editing_index(known, experiment, roi_file)


def roi_analysis(
    reads: DataFrame,
    tiles: DataFrame,
    regions: DataFrame,
    options: Options | None = None,
    *,
    exclude: DataFrame | None = None,
    force: DataFrame | None = None,
    gff: DataFrame | None = None,
    variants: DataFrame | None = None,
) -> DataFrame:
    """The region table in its output form."""
    o = options or Options()
    return finished(roi_rows(reads, tiles, regions, o, exclude=exclude, variants=variants), o, force, gff)


def editing_index(
    reads: DataFrame,
    tiles: DataFrame,
    regions: DataFrame,
    options: Options | None = None,
    *,
    exclude: DataFrame | None = None,
    gff: DataFrame | None = None,
    variants: DataFrame | None = None,
    experiment: str = "NA",
    roi_file: str = "NA",
) -> DataFrame:
    o = options or Options()
    return indexed(roi_rows(reads, tiles, regions, o, exclude=exclude, variants=variants, covered=False), o, gff, experiment, roi_file)


def run_totals(reads: DataFrame, options: Options | None = None, regions: DataFrame | None = None) -> DataFrame:
    """(trstrand, reads): reads with at least one accepted base, in ``regions`` where there are some, of every strand of the design; 0 where a strand has none."""
    o = options or Options()
    near = None if regions is None else regions.select("contig", F.col("start_").alias("r_start"), F.col("end_").alias("r_end"))
    observed = pileup.bases(o.passing(reads), o.design, **o.bases(), within=near)
    found = pileup.mapped_reads(sites.restrict(observed, regions))
    strands = reads.sparkSession.createDataFrame([(s,) for s in ("." if o.design == "u" else "+-")], "trstrand string")
    return strands.join(found, "trstrand", "left").select("trstrand", F.coalesce("reads", F.lit(0).cast("bigint")).alias("reads"))
