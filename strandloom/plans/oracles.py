"""The queries in DuckDB SQL: windows and correlated joins where the operators fold arrays and bucket."""

from __future__ import annotations

import re

from ..sources import fixtures
from .queries import ROI_EDITING, SITE_EDITING, UTR3

_TABLES = {n: n for n in ("orders", "events", "part", "supplier", "customer")}


def _plain(sql: str) -> str:
    return sql.format(**_TABLES, r="sequenced")


_CELLS = [(a, b) for a in "ACGT" for b in "ACGT"]
_SUM16 = " + ".join(f"{a}_to_{b}".lower() for a, b in _CELLS)
_OFF = " + ".join(f"{a}_to_{b}".lower() for a, b in _CELLS if a != b)


def _freq(part: str, whole: str, least: float) -> str:
    return f"({whole}) > 0 and cast(cast(({part}) as float) / cast(({whole}) as float) as float) >= cast({least} as float)"


def _edited(m: str, mm: str, least: int, freq: float) -> str:
    return f"({mm} >= {least} and {_freq(mm, f'{m} + {mm}', freq)})"


def _site_editing(least: int, freq: float) -> str:
    return f"case when n1 = 'A' and {_edited('A', 'G', least, freq)} then '+' when n1 = 'T' and {_edited('T', 'C', least, freq)} then '-' else '.' end"


def _roi_editing(least: int, freq: float) -> str:
    a, t = _edited("a_to_a", "a_to_g", least, freq), _edited("t_to_t", "t_to_c", least, freq)
    fa = "cast(cast(a_to_g as float) / cast(a_to_g + a_to_a as float) as float)"
    ft = "cast(cast(t_to_c as float) / cast(t_to_c + t_to_t as float) as float)"
    return f"case when {a} and {t} then (case when {fa} > {ft} then '+' when {ft} > {fa} then '-' else '.' end) when {a} then '+' when {t} then '-' else '.' end"


def _annotated(keys: str, source: str, start: str, end: str) -> str:
    """Counts of overlapping features by class and strand, and the verdict of the first class that has any."""
    counts = ", ".join(f"count(*) filter (f.class = '{c}' and f.strand = '{s}') as {c}_{n}" for c in ("exon", "gene", "utr3") for s, n in (("+", "p"), ("-", "m")))
    verdict = " ".join(f"when {c}_p + {c}_m > 0 then (case when {c}_p = 0 then '-' when {c}_m = 0 then '+' else '.' end)" for c in ("exon", "gene", "utr3"))
    grouped = ", ".join(f"q.{k}" for k in keys.split(", "))
    return (
        f"select {keys}, case {verdict} end as strand from (select {grouped}, {counts} from {source} q join feats f "
        f"on f.contig = q.contig and f.start_ < q.{end} and q.{start} < f.end_ and f.start_ < f.end_ group by {grouped})"
    )


def _matrix(positions: str) -> str:
    cells = ", ".join(f"coalesce(sum({b}) filter (n1 = '{a}' and n2 is null), 0)::bigint as {a.lower()}_to_{b.lower()}" for a, b in _CELLS)
    sums = ", ".join(f"count(*) filter (n1 = '{a}' and n2 is null) as n_{a.lower()}" for a in "ACGT")
    return f"select roi_id, count(*) filter (n2 is not null) as heterozygous, {sums}, {cells} from {positions} group by roi_id"


_TOP = "case when A >= C and A >= G and A >= T then 'A' when C >= G and C >= T then 'C' when G >= T then 'G' else 'T' end"
_COUNTS = ", ".join(f"count(*) filter (base = '{n}') as {n}" for n in "ACGT")


def _autoref(cov: int, freq: float, hyper: str = "false") -> str:
    return f"case when A + C + G + T >= {cov} and {_freq('greatest(A, C, G, T)', 'A + C + G + T', freq)} and not ({hyper}) then {_TOP} else refnuc end"


#: Common tables by name; each may use the others.
CTE = {
    "genome": _plain(fixtures.GENOME),
    "genome_seq": "select contig, string_agg(refnuc, '' order by pos) as seq from genome group by contig",
    "starts": _plain(fixtures.STARTS),
    "sequenced": "select e.*, substr(g.seq, cast(e.pos as int) + 1, 40) as s from starts e join genome_seq g on g.contig = e.contig",
    "reads": _plain(fixtures.SEQUENCED),
    "rois": _plain(fixtures.ROIS),
    "exclude": _plain(fixtures.EXCLUDE),
    "gff": _plain(fixtures.GFF),
    "vcf_raw": _plain(fixtures.VCF),
    "features": "select contig, start1 - 1 as start_, end1 as end_, type as class, strand from gff where type in ('exon', 'gene') and strand in ('+', '-')",
    "utrs": f"select contig, case strand when '+' then end_ else start_ - {UTR3} end as start_, case strand when '+' then end_ + {UTR3} else start_ end as end_, strand from features where class = 'gene'",
    "feats": "select contig, start_, end_, class, strand from features union all select contig, start_, end_, 'utr3', strand from utrs",
    "ops": r"""select *, kinds[i] as kind, cast(sizes[i] as bigint) as n from (
        select *, unnest(range(1, len(kinds) + 1)) as i from (
          select *, regexp_extract_all(cigar, '\d+([MIDNSHP=X])', 1) as kinds, regexp_extract_all(cigar, '(\d+)[MIDNSHP=X]', 1) as sizes from reads))""",
    "offsets": """select *, cast(coalesce(sum(case when kind in ('M', '=', 'X', 'D', 'N') then n else 0 end) over w, 0) as bigint) as roff,
        cast(coalesce(sum(case when kind in ('M', '=', 'X', 'S', 'I') then n else 0 end) over w, 0) as bigint) as qoff
        from ops window w as (partition by read_id order by i rows between unbounded preceding and 1 preceding)""",
    "cells": """select read_id, contig, flags, mapq, i, pos + roff + j as p, qoff + j as qp, length(seq) as total, upper(substr(seq, cast(qoff + j + 1 as int), 1)) as letter, ascii(substr(qual, cast(qoff + j + 1 as int), 1)) - 33 as q
        from (select *, unnest(range(n)) as j from offsets where kind in ('M', '=', 'X'))""",
    "every": "select *, case when letter in ('A', 'C', 'G', 'T') then letter else 'N' end as base from cells",
    "seen": "select * from every where (flags & 2820) = 0 and mapq >= 1 and q >= 20",
    "pile": f"select contig, p as pos, {_COUNTS} from seen where base <> 'N' group by contig, p",
    "counted": "select g.contig, g.pos, g.refnuc, A, C, G, T from genome g join pile p on p.contig = g.contig and p.pos = g.pos",
    "sites": f"select *, {_autoref(20, 0.95)} as n1 from counted",
    "filled": "select g.*, coalesce(A, 0) as A, coalesce(C, 0) as C, coalesce(G, 0) as G, coalesce(T, 0) as T from genome g left join pile p on p.contig = g.contig and p.pos = g.pos",
    "known": f"select *, {_autoref(20, 0.95)} as n1 from filled",
    "masked": """select r.roi_id, r.contig, x as pos, r.start_, r.end_ from (select *, unnest(range(start_, end_)) as x from rois) r
        where not exists (select 1 from exclude e where e.contig = r.contig and e.start_ <= r.x and r.x < e.end_)""",
    "post": "select roi_id, contig, min(pos) as post_start, max(pos) + 1 as post_end, any_value(end_ - start_) - count(*) as nucmasked from masked group by roi_id, contig",
    "roi_pos": "select r.roi_id, k.n1, cast(null as varchar) as n2, k.A, k.C, k.G, k.T from rois r join known k on k.contig = r.contig and k.pos >= r.start_ and k.pos < r.end_",
    "masked_pos": "select m.roi_id, k.n1, cast(null as varchar) as n2, k.A, k.C, k.G, k.T from masked m join known k on k.contig = m.contig and k.pos = m.pos",
    "matrix": _matrix("roi_pos"),
    "masked_matrix": _matrix("masked_pos"),
    "cover": "select r.roi_id, count(distinct s.read_id) as coverage from rois r join seen s on s.contig = r.contig and s.p >= r.start_ and s.p < r.end_ group by r.roi_id",
    "masked_cover": "select r.roi_id, count(distinct s.read_id) as coverage from post r join seen s on s.contig = r.contig and s.p >= r.post_start and s.p < r.post_end group by r.roi_id",
    "table_": "select m.*, coalesce(c.coverage, 0) as coverage, r.contig, r.start_, r.end_, r.name, r.strand from matrix m join rois r using (roi_id) left join cover c using (roi_id)",
    "masked_table": "select m.*, coalesce(c.coverage, 0) as coverage, r.contig, r.start_, r.end_, r.name, r.strand, p.post_start, p.post_end, p.nucmasked from masked_matrix m join rois r using (roi_id) join post p using (roi_id) left join masked_cover c using (roi_id)",
    "calls": r"""select contig, pos1 - 1 as pos, upper(al[k[1] + 1]) as a, upper(al[k[len(k)] + 1]) as b from (
        select *, list_concat([ref], string_split(alt, ',')) as al, list_transform(list_filter(string_split_regex(gt, '[/|]'), lambda x: regexp_matches(x, '^\d+$')), lambda x: cast(x as int)) as k
        from vcf_raw where filter_ in ('PASS', '.')) where len(k) between 1 and 2 and (k[1] <> 0 or k[len(k)] <> 0)""",
    "genotypes": "select contig, pos, least(a, b) as n1, case when a <> b then greatest(a, b) end as n2 from calls where a in ('A', 'C', 'G', 'T') and b in ('A', 'C', 'G', 'T')",
    "roi_strand": _annotated("roi_id", "rois", "start_", "end_"),
    # With trimming and variants, for the runs over files.
    "tseen": "select * from seen where case when (flags & 16) = 0 then qp >= 3 and qp < total - 5 else qp >= 5 and qp < total - 3 end",
    "tpile": f"select contig, p as pos, {_COUNTS} from tseen where base <> 'N' group by contig, p",
    "vknown": """select g.*, coalesce(v.n1, g.refnuc) as n1, v.n2, coalesce(A, 0) as A, coalesce(C, 0) as C, coalesce(G, 0) as G, coalesce(T, 0) as T
        from genome g left join tpile p on p.contig = g.contig and p.pos = g.pos left join genotypes v on v.contig = g.contig and v.pos = g.pos""",
    "vmasked_pos": "select m.roi_id, k.n1, k.n2, k.A, k.C, k.G, k.T from masked m join vknown k on k.contig = m.contig and k.pos = m.pos",
    "vmatrix": _matrix("vmasked_pos"),
    "tcover": "select r.roi_id, count(distinct s.read_id) as coverage from post r join tseen s on s.contig = r.contig and s.p >= r.post_start and s.p < r.post_end group by r.roi_id",
    "vtable": "select m.*, coalesce(c.coverage, 0) as coverage, r.contig, r.start_, r.end_, r.name, r.strand, p.post_start, p.post_end, p.nucmasked from vmatrix m join rois r using (roi_id) join post p using (roi_id) left join tcover c using (roi_id)",
    "vreach": """select *, pos + 1 as stop from vknown k where exists (select 1 from rois r where r.contig = k.contig and r.start_ <= k.pos and k.pos < r.end_)
        and not exists (select 1 from exclude e where e.contig = k.contig and e.start_ <= k.pos and k.pos < e.end_)""",
    "strand_reads": """select *, case when (flags & 64) <> 0 then (case when (flags & 16) <> 0 then '-' else '+' end) else (case when (flags & 16) <> 0 then '+' else '-' end) end as sf from seen""",
    "sf_pile": f"select contig, p as pos, sf as trstrand, {_COUNTS} from strand_reads where base <> 'N' group by contig, p, sf",
    "sf_pos": """select m.roi_id, s.trstrand, k.n1, coalesce(q.A, 0) as A, coalesce(q.C, 0) as C, coalesce(q.G, 0) as G, coalesce(q.T, 0) as T
        from masked m join known k on k.contig = m.contig and k.pos = m.pos cross join (values ('+'), ('-')) s(trstrand)
        left join sf_pile q on q.contig = m.contig and q.pos = m.pos and q.trstrand = s.trstrand""",
}

_LOW = ", ".join(f"{n} as n_{n.lower()}" for n in "ACGT")
_MM = "A + C + G + T - case {0} when 'A' then A when 'C' then C when 'G' then G when 'T' then T else 0 end"


def _site_pass(allele: str = "n1") -> str:
    mm = _MM.format(allele)
    return f"A + C + G + T >= 10 and {mm} >= 3 and {_freq(mm, 'A + C + G + T', 0.01)}"


_ROI_PASS = f"{_SUM16} >= 10 and {_OFF} >= 5 and {_freq(_OFF, _SUM16, 0.01)}"
_DEFAULT_FREQ = 0.05
_INDEX_PAIRS = ["A->A", "T->T", "G->G", "C->C", "A->T", "T->A", "A->G", "T->C", "A->C", "T->G", "G->C", "C->G", "G->A", "C->T", "G->T", "C->A"]
_COMPLEMENT = dict(zip("ACGT", "TGCA"))


_SHARES = ", ".join(f"x_{p[0]}{p[3]}::double / nullif({' + '.join(f'x_{p[0]}{b}' for b in 'ACGT')}, 0)::double as \"{p}\"" for p in _INDEX_PAIRS)


def _index_sql() -> str:
    cells = ", ".join(
        f"sum(case when trstrand = '+' and n1 = '{a}' then {b} when trstrand = '-' and n1 = '{_COMPLEMENT[a]}' then {_COMPLEMENT[b]} else 0 end) as x_{a}{b}" for a, b in _CELLS
    )
    return f"""select 'fixture' as experiment, 'rois' as "ROI-file", (select count(*) from sf_pos where trstrand = '.') as "#unstranded", {_SHARES} from (select {cells} from sf_pos)"""


def _unstranded_index_sql(table: str, annotation: str, head: str) -> str:
    """Of regions whose strand is predicted: by annotation, then by editing."""
    strand = f"coalesce(case when a.strand in ('+', '-') then a.strand end, {_roi_editing(ROI_EDITING['least'], _DEFAULT_FREQ)})"
    cells = ", ".join(
        f"sum(case when trstrand = '+' then {a}_to_{b} when trstrand = '-' then {_COMPLEMENT[a]}_to_{_COMPLEMENT[b]} else 0 end) as x_{a}{b}" for a, b in _CELLS
    )
    return f"""select {head}, u as "#unstranded", {_SHARES} from (select count(*) filter (trstrand = '.') as u, {cells} from (
        select t.*, {strand} as trstrand from {table} t left join ({{{annotation}}}) a using (roi_id)))"""


def _two_alleles(least: int, freq: float) -> str:
    """Strand by editing of a site with up to two alleles; alleles that disagree tell nothing."""
    one = lambda n: f"case when {n} = 'A' and {_edited('A', 'G', least, freq)} then '+' when {n} = 'T' and {_edited('T', 'C', least, freq)} then '-' end"
    a, b = one("n1"), one("n2")
    return f"case when ({a}) <> ({b}) then '.' else coalesce({a}, {b}, '.') end"


_ROI_HEADER = ", ".join(f"n_{a.lower()} as \"#{a}\", " + ", ".join(f"{a}_to_{b}".lower() + f' as "{a}->{b}"' for b in "ACGT") for a in "ACGT")

SQL = {
    "scan_reads": "select read_id, contig, pos, flags, mapq, cigar, seq, qual from reads where contig = 'c1' and pos < 400 and pos + list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: cast(x as bigint))) > 100",
    "pool_replicates": "select contig, pos, 2 * A as n_a, 2 * C as n_c, 2 * G as n_g, 2 * T as n_t from pile",
    "contigs": "select contig, length(seq) as len from genome_seq",
    "scan_fasta": "select roi_id, substr(seq, cast(start_ as int) + 1, cast(end_ - start_ as int)) as seq from rois join genome_seq using (contig)",
    "scan_bed": "select contig, start_, end_, name, strand from rois",
    "scan_gff": "select contig, start_, end_, class as type, strand from features",
    "scan_vcf": "select contig, pos1 - 1 as pos, ref, alt, filter_, gt from vcf_raw",
    "site_output": f"""select contig, pos, coalesce(strand_, {_site_editing(SITE_EDITING['least'], _DEFAULT_FREQ)}) as trstrand, refnuc, n1 as prednuc, A, C, G, T from (
        select s.*, case when a.strand in ('+', '-') then a.strand end as strand_ from (select *, pos + 1 as stop from sites where {_site_pass()}) s left join ({{site_annotation}}) a on a.contig = s.contig and a.pos = s.pos)""",
    "roi_output": f"""select contig, start_ as start, end_ as "end", strand, name, coalesce(known_, {_roi_editing(ROI_EDITING['least'], _DEFAULT_FREQ)}) as trstrand, coverage, nucmasked, heterozygous, {_ROI_HEADER}
        from (select t.*, case when a.strand in ('+', '-') then a.strand end as known_ from masked_table t left join ({{roi_annotation}}) a using (roi_id)) where {_ROI_PASS}""",
    "filter_flags": "select read_id, flags from reads where (flags & 3) = 3 and (flags & 2820) = 0",
    "filter_mapq": "select read_id, mapq from reads where mapq >= 10 and mapq <> 255",
    "filter_baseq": "select read_id, count(*) as n from every where q >= 30 group by read_id",
    "trim_bases": "select read_id, contig, p as pos, base from every where q >= 0 and case when (flags & 16) = 0 then qp >= 3 and qp < total - 5 else qp >= 5 and qp < total - 3 end",
    "normalize_base": "select refnuc as base, count(*) as n from genome group by refnuc",
    "site_threshold": f"select contig, pos, refnuc, n1, {_LOW} from sites where {_site_pass()}",
    "roi_threshold": f"select roi_id, coverage from table_ where {_ROI_PASS}",
    "roi_matrix": "select * from matrix",
    "vcf_genotype": "select * from genotypes",
    "site_region": f"select contig, pos, {_LOW} from counted c where exists (select 1 from rois r where r.contig = c.contig and r.start_ <= c.pos and c.pos < r.end_)",
    "site_exclude": f"select contig, pos, {_LOW} from counted c where not exists (select 1 from exclude r where r.contig = c.contig and r.start_ <= c.pos and c.pos < r.end_)",
    "roi_exclude": """select roi_id, post_start, post_end, nucmasked, n_pieces from post join (
        select roi_id, count(distinct grp) as n_pieces from (select roi_id, pos - row_number() over (partition by roi_id order by pos) as grp from masked) group by roi_id) using (roi_id)""",
    "cigar_explode": "select read_id, contig, p as pos, base from every where q >= 0",
    "matched_blocks": """select read_id, contig, min(p) as start_, max(p) + 1 as end_ from (
        select *, p - row_number() over (partition by read_id, i order by p) as grp from every where q >= 20) group by read_id, contig, i, grp""",
    "split_intervals": "select roi_id, contig, start_ + 50 * k as start_, least(start_ + 50 * (k + 1), end_) as end_ from (select *, unnest(range((end_ - start_ + 49) // 50)) as k from rois)",
    "greedy_bins": """select contig, start_, max(last) as end_, count(*) as items from (
        select contig, start_, last, n from walk) group by contig, start_, n""",
    "annotation_segments": """select roi_id, contig, border as start_, coalesce(lead(border) over (partition by roi_id order by border), end_) as end_ from (
        select roi_id, contig, start_ as first_, end_, start_ as border from rois
        union select r.roi_id, r.contig, r.start_, r.end_, unnest([f.start_, f.end_]) from rois r join features f on f.contig = r.contig and f.start_ < r.end_ and r.start_ < f.end_)
        where border >= first_ and border < end_""",
    "interval_subtract": """select roi_id, min(pos) as start_, max(pos) + 1 as end_ from (
        select roi_id, pos, pos - row_number() over (partition by roi_id order by pos) as grp from masked) group by roi_id, grp""",
    "utr3_extension": "select contig, start_, end_, strand from utrs",
    "roi_read_coverage": "select * from masked_cover",
    "join_reference": f"select contig, pos, refnuc, {_LOW} from filled",
    "vcf_reference": """select g.contig, g.pos, g.refnuc, case when v.contig is null then g.refnuc when n2 is null then n1 else n1 || '/' || n2 end as prednuc
        from genome g left join genotypes v on v.contig = g.contig and v.pos = g.pos""",
    "strand_by_annotation_roi": "select * from roi_strand",
    "strand_by_annotation_site": _annotated("contig, pos", "(select *, pos + 1 as stop from genome)", "pos", "stop"),
    "roi_force": f"select roi_id, coverage from masked_table t where ({_ROI_PASS}) or exists (select 1 from rois f where f.strand = '+' and f.contig = t.contig and f.start_ = t.post_start and f.end_ = t.post_end and f.strand = t.strand and f.name = t.name)",
    "site_force": f"""select contig, pos, '.' as trstrand, refnuc, n1, {_LOW} from known k
        where (A + C + G + T > 0 and {_site_pass()}) or exists (select 1 from exclude e where e.contig = k.contig and e.start_ <= k.pos and k.pos < e.end_)""",
    "pileup_unstranded": f"select contig, pos, {_LOW} from pile",
    "pileup_stranded": f"select contig, pos, trstrand, {_LOW} from sf_pile",
    "mapped_reads": "select translate(sf, '+-', '-+') as trstrand, count(distinct read_id) as reads from strand_reads group by sf",
    "autoref": "select contig, pos, refnuc, n1 from sites",
    "site_coverage_mismatch": f"select contig, pos, A + C + G + T as cov, {_MM.format('refnuc')} as mm from counted",
    "most_frequent_base": f"select contig, pos, {_TOP} as base from counted",
    "editing_index": _index_sql(),
    "bed_bases": "select contig, cast(sum(end_ - start_) as bigint) as bases, max(end_ - start_) as longest from rois group by contig",
    "prednuc_symbol": "select contig, pos, case when n2 is null then n1 else n1 || '/' || n2 end as prednuc from genotypes",
    "complement": "select contig, pos, T as n_a, G as n_c, C as n_g, A as n_t from counted",
    "read_strand": "select read_id, case when (flags & 16) <> 0 then '-' else '+' end as strand, (flags & 64) <> 0 as is_first from reads",
    "strand_deduce": """select read_id, '.' as by_u, o as by_s, translate(o, '+-', '-+') as by_f, case when f then o else translate(o, '+-', '-+') end as by_s_f, case when f then translate(o, '+-', '-+') else o end as by_f_s
        from (select read_id, case when (flags & 16) <> 0 then '-' else '+' end as o, (flags & 64) <> 0 as f from reads)""",
    "autoref_hyperedit": f"select contig, pos, refnuc, {_autoref(5, 0.5, f'(refnuc = {chr(39)}A{chr(39)} and {_TOP} = {chr(39)}G{chr(39)}) or (refnuc = {chr(39)}T{chr(39)} and {_TOP} = {chr(39)}C{chr(39)})')} as n1 from counted",
    "strand_by_editing_site": f"select contig, pos, {_site_editing(SITE_EDITING['least'], SITE_EDITING['least_freq'])} as trstrand from sites",
    "strand_by_editing_roi": f"select roi_id, {_roi_editing(ROI_EDITING['least'], ROI_EDITING['least_freq'])} as trstrand from table_",
    "strand_engine": f"select roi_id, coalesce(case when a.strand in ('+', '-') then a.strand end, {_roi_editing(ROI_EDITING['least'], ROI_EDITING['least_freq'])}) as trstrand from table_ t left join (select roi_id, strand from roi_strand) a using (roi_id)",
    "editing_index_unstranded": _unstranded_index_sql("masked_table", "roi_annotation", "'fixture' as experiment, 'rois' as \"ROI-file\""),
    "run_totals": f"""select translate(sf, '+-', '-+') as kind, count(distinct read_id) as n from strand_reads group by sf
        union all select 'items', count(*) from sites where {_site_pass()}""",
    "site_file": """select row_number() over (order by contig, pos) as n, contig, pos, trstrand from (SITE_OUTPUT)""",
    "roi_file": """select row_number() over (order by contig, start, "end", trstrand, name) as n, contig, start, "end", trstrand, name from (ROI_OUTPUT)""",
    "index_file": """select unnest(['experiment,ROI-file,#unstranded', 'one,rois,0', 'two,rois,0']) as line""",
    "bam_file": "select read_id, contig, pos, flags, mapq, cigar, seq, qual from reads",
    "bam_contigs": "select contig, length(seq) as len from genome_seq",
    "vcf_file": "select contig, pos1 - 1 as pos, ref, alt, filter_, gt from vcf_raw",
    "run_reads": "select '.' as trstrand, count(distinct read_id) as reads from tseen s where exists (select 1 from rois r where r.contig = s.contig and r.start_ <= s.p and s.p < r.end_)",
    "site_run": f"""select contig, pos, coalesce(strand_, {_two_alleles(SITE_EDITING['least'], _DEFAULT_FREQ)}) as trstrand, refnuc, case when n2 is null then n1 when n1 = 'N' or n2 = 'N' then 'N' else n1 || '/' || n2 end as prednuc, A, C, G, T from (
        select s.*, case when a.strand in ('+', '-') then a.strand end as strand_ from ({{run_sites}}) s left join ({{run_annotation}}) a on a.contig = s.contig and a.pos = s.pos)""",
    "roi_run": f"""select contig, start_ as start, end_ as "end", strand, name, coalesce(known_, {_roi_editing(ROI_EDITING['least'], _DEFAULT_FREQ)}) as trstrand, coverage, nucmasked, heterozygous, {_ROI_HEADER}
        from (select t.*, case when a.strand in ('+', '-') then a.strand end as known_ from vtable t left join ({{utr_annotation}}) a using (roi_id)) v
        where ({_ROI_PASS}) or exists (select 1 from rois f where f.strand = '+' and f.contig = v.contig and f.start_ = v.post_start and f.end_ = v.post_end and f.strand = v.strand and f.name = v.name)""",
    "roi_run_index": _unstranded_index_sql("vtable", "utr_annotation", "'fixture' as experiment"),
}
for _name, _like in (("bcf_file", "vcf_file"), ("fasta_file", "scan_fasta"), ("fasta_without_index", "scan_fasta"), ("bed_file", "scan_bed"), ("gff_file", "scan_gff"), ("bam_region", "scan_reads")):
    SQL[_name] = SQL[_like]
SQL["site_file"] = SQL["site_file"].replace("SITE_OUTPUT", SQL["site_output"])
SQL["roi_file"] = SQL["roi_file"].replace("ROI_OUTPUT", SQL["roi_output"])
# Features without the 3'UTR extension, for the two outputs.
_BARE = {
    "site_annotation": _annotated("contig, pos", f"(select *, pos + 1 as stop from sites where {_site_pass()})", "pos", "stop").replace("join feats f", "join features f"),
    "roi_annotation": _annotated("roi_id", "post", "post_start", "post_end").replace("join feats f", "join features f"),
}
_RUN_SITES = f"""select * from vreach k where (A + C + G + T > 0 and (({_site_pass()}) or (n2 is not null and {_site_pass('n2')})))
        or exists (select 1 from features e where e.class = 'exon' and e.contig = k.contig and e.start_ <= k.pos and k.pos < e.end_)"""
_BARE["run_sites"] = _RUN_SITES
_BARE["run_annotation"] = _annotated("contig, pos", f"({_RUN_SITES})", "pos", "stop")
_BARE["utr_annotation"] = _annotated("roi_id", "post", "post_start", "post_end")
for _name in ("site_output", "roi_output", "site_file", "roi_file", "editing_index_unstranded", "site_run", "roi_run", "roi_run_index"):
    SQL[_name] = SQL[_name].format(**_BARE)
# The greedy fold is sequential: a recursive walk over the ordered intervals of each contig.
_WALK = """recursive ordered as (select contig, start_ as s, end_ as e, row_number() over (partition by contig order by start_, end_ desc) as k from rois),
walk(contig, k, start_, lim, last, n) as (
  select contig, k, s, greatest(e, s + 500), e, 1 from ordered where k = 1
  union all
  select o.contig, o.k, case when o.e <= w.lim then w.start_ else o.s end, case when o.e <= w.lim then w.lim else greatest(o.e, o.s + 500) end, o.e, case when o.e <= w.lim then w.n else w.n + 1 end
  from walk w join ordered o on o.contig = w.contig and o.k = w.k + 1)"""


def _complete(sql: str) -> str:
    """``sql`` with the common tables that it needs in front."""
    need: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"\b(from|join|,)\s+\(*{name}\b", text):
                visit(CTE[name])
                need[name] = None

    visit(sql)
    return f"with {', '.join(f'{n} as ({CTE[n]})' for n in need)} {sql}" if need else sql


def _with_walk(sql: str) -> str:
    base = f"rois as ({CTE['rois']})"
    return f"with recursive {base}, {_WALK.removeprefix('recursive ')} {sql}"


ORACLES = {k: _with_walk(v) if k == "greedy_bins" else _complete(v) for k, v in SQL.items()}
