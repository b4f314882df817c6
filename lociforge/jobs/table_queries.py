"""Queries of sex calls, quality tables, lists and reports, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociforge.functions import genotypes as g
from lociforge.jobs import views as v
from lociforge.jobs.queries import _AB, _COUNTS, _SEQS, _SEX, _SITES, _TARGET, _VAR, _balanced, _sex_loci, _sexes, _with_indels
from lociforge.jobs.registry import query, rounded, sample_count
from lociforge.operators import cohort, counts, hits, intervals, qc_tables, sequences, sex, sites
from lociforge.sources import readers


def _classes(x: str) -> str:
    """SQL of the locus classes by the sexes of a pass."""
    return f"""sizes{x} as (select sex, count(*) as size from sexes{x} group by sex),
ss{x} as (select x.sex, c.locus, c.pos, count(*) filter (where code = 'het') as n_het, count(*) filter (where code <> 'miss') as called from calls c join sexes{x} x on c.sample = x.sample where c.locus >= 36 group by all),
agg{x} as (select s.sex, locus, count(*) filter (where called > 0 and called >= 0.25 * size) as n_sites, count(*) filter (where called > 0 and called >= 0.25 * size and n_het / called > 0.6) as n_excess, sum(n_het) / any_value(size) as het from ss{x} s join sizes{x} z on s.sex = z.sex group by all),
two{x} as (select l.locus, coalesce(a.n_excess, 0) as ae, coalesce(b.n_excess, 0) as be, coalesce(a.n_excess / nullif(a.n_sites, 0), 0) as af, coalesce(b.n_excess / nullif(b.n_sites, 0), 0) as bf, coalesce(a.het, 0) as ah, coalesce(b.het, 0) as bh
    from loci l left join agg{x} a on a.locus = l.locus and a.sex = 'hetero' left join agg{x} b on b.locus = l.locus and b.sex = 'homo' where l.locus >= 36),
classes{x} as (select locus, case when af > 0.05 and ae >= 3 and bf > 0.05 and be >= 3 then 'paralog' when af > 0.05 and ae >= 3 then 'gametolog' when case when bh > 0 then ah / bh when ah > 0 then 999 else 1 end <= 0.6 then 'hemizygous' else 'PAR-like' end as class from two{x})"""


_PASSES = f"""{_SEX.replace("sexes as (", "sexes1 as (")}, {_classes("1")},
used as (select locus from classes1 where class = 'hemizygous' union all select locus from loci where locus >= 36 and not exists (select 1 from classes1 where class = 'hemizygous')),
dep2 as (select sample, sum(mean_dp * n_dp) filter (where locus < 36) / sum(n_dp) filter (where locus < 36 and n_dp > 0) as auto_depth,
    sum(mean_dp * n_dp) filter (where locus in (select locus from used)) / sum(n_dp) filter (where locus in (select locus from used) and n_dp > 0) as sex_depth from counts group by sample),
ratios2 as (select *, case when auto_depth > 0 and sex_depth > 0 then sex_depth / auto_depth end as depth_ratio from dep2),
ord2 as (select *, row_number() over (order by depth_ratio, sample) as i, count(*) over () as n, lead(depth_ratio) over (order by depth_ratio, sample) - depth_ratio as gap from ratios2 where depth_ratio is not null),
cut2 as (select i as cut from ord2 where i between greatest(floor(0.2 * n), 1) and least(floor(0.8 * n), n - 1) order by gap desc, i limit 1),
sexes2 as (select ord2.*, case when i <= cut then 'hetero' else 'homo' end as sex from ord2, cut2), {_classes("2")}"""


def _passes(spark, d):
    own = counts.counts_per_locus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))
    return own, *sex.two_passes(own, v.calls(spark, d), _sex_loci(spark, d))


@query(f"{_PASSES} select locus, class from classes2")
def sex_classes_second_pass(spark, d):
    """Locus classes after the second pass, from hemizygous loci (3.3)."""
    return _passes(spark, d)[2].select("locus", "class")


_Z = lambda c: f"coalesce(abs({c} - m_{c}) / nullif(s_{c}, 0), 0)"
_CALLED = f"""{_PASSES}, own as (select c.sample, sum(n_het) filter (where class = 'hemizygous') / sum(len) filter (where class = 'hemizygous') as hd, sum(n_het) filter (where class = 'gametolog') as gh from counts c join classes2 k on c.locus = k.locus join loci l on c.locus = l.locus group by c.sample),
st as (select x.sample, sex, auto_depth, depth_ratio, coalesce(hd, 0) as het_density, coalesce(gh, 0)::bigint as n_gametolog_het from sexes2 x left join own o on x.sample = o.sample),
mid as (select sex, median(depth_ratio) as m_depth_ratio, median(het_density) as m_het_density, median(n_gametolog_het) as m_n_gametolog_het from st group by sex),
dev as (select st.*, m_depth_ratio, m_het_density, m_n_gametolog_het from st join mid on st.sex = mid.sex),
spread as (select sex, 1.4826 * median(abs(depth_ratio - m_depth_ratio)) as s_depth_ratio, 1.4826 * median(abs(het_density - m_het_density)) as s_het_density, 1.4826 * median(abs(n_gametolog_het - m_n_gametolog_het)) as s_n_gametolog_het from dev group by sex),
zs as (select dev.*, {_Z("depth_ratio")} as z1, {_Z("het_density")} as z2, {_Z("n_gametolog_het")} as z3 from dev join spread on dev.sex = spread.sex),
sexed as (select *, concat_ws(',', case when auto_depth < 26.5 then printf('low_depth(%.1f)', auto_depth) end, case when z1 > 2 then printf('depth_ratio(z=%.1f)', z1) end, case when z2 > 2 then printf('het_density(z=%.1f)', z2) end, case when z3 > 2 then printf('gametolog_hets(z=%.1f)', z3) end) as f from zs)"""


def _sexed(spark, d):
    own, sexes, classes = _passes(spark, d)
    return sex.sex_calls(sex.sex_statistics(own, v.loci(spark, d), sexes, classes), min_depth=26.5, max_z=2)


@query(f"{_CALLED} select sample, sex, round(depth_ratio, 6) as depth_ratio, round(het_density, 6) as het_density, n_gametolog_het, case when f = '' then '-' else f end as flags, f = '' as confident from sexed")
def sex_calls(spark, d):
    """Sex calls with their flags (A25, A26), after two passes."""
    return rounded(_sexed(spark, d).select("sample", "sex", "depth_ratio", "het_density", "n_gametolog_het", "flags", "confident"))


@query(f"""{_CALLED}, hemi as (select c.sample, sum(mean_dp * n_dp) / sum(n_dp) filter (where mean_dp is not null) as depth from counts c join classes2 k on c.locus = k.locus where class = 'hemizygous' group by c.sample)
select x.sample, round(auto_depth, 6) as auto_depth, round(coalesce(h.depth, 0), 6) as hemi_depth, round(depth_ratio, 6) as depth_ratio, round(het_density, 6) as het_density, n_gametolog_het, sex, f = '' as confident, case when f = '' then '-' else f end as flags from sexed x left join hemi h on x.sample = h.sample""")
def sex_table(spark, d):
    """The table of sexes with the depth of hemizygous loci, 0 where there are none."""
    rows = _sexed(spark, d).select("sample", "auto_depth", "hemi_depth", "depth_ratio", "het_density", "n_gametolog_het", "sex", "confident", "flags")
    return rounded(rows)


@query(f"""{_PASSES}, more as (select t.*, l.len, coalesce(a.n_sites, 0) as an, coalesce(b.n_sites, 0) as bn from two2 t join loci l on t.locus = l.locus left join agg2 a on a.locus = t.locus and a.sex = 'hetero' left join agg2 b on b.locus = t.locus and b.sex = 'homo')
select m.locus, len as length, an as hetero_n_sites, ae as hetero_n_excess, bn as homo_n_sites, be as homo_n_excess, round(af, 6) as hetero_site_frac, round(bf, 6) as homo_site_frac, round(ah / len, 6) as hetero_het_density, round(bh / len, 6) as homo_het_density,
    round(case when bh > 0 then ah / bh when ah > 0 then 999 else 1 end, 6) as het_ratio, class from more m join classes2 c on m.locus = c.locus""")
def sex_class_table(spark, d):
    """The table of locus classes after the second pass, with its counts and densities."""
    return rounded(_passes(spark, d)[2])


@query(f"{_PASSES} select count(*) filter (where a.sex <> b.sex) as n_switched from sexes1 a join sexes2 b on a.sample = b.sample")
def switched_sexes(spark, d):
    """Samples whose sex the second pass changes."""
    return sex.n_switched(_sexes(spark, d), _passes(spark, d)[1])


@query(f"{_PASSES} select p.policy, k.locus from classes2 k, (values ('all'), ('paralogs'), ('gametologs'), ('none')) p(policy) where policy = 'all' or policy = 'paralogs' and class in ('paralog', 'gametolog') or policy = 'gametologs' and class = 'gametolog'")
def excluded_sex_loci(spark, d):
    """Sex loci that each policy leaves out."""
    classes = _passes(spark, d)[2]
    out = None
    for policy in ("all", "paralogs", "gametologs", "none"):
        own = sex.exclusion_list(classes, policy).select(F.lit(policy).alias("policy"), "locus")
        out = own if out is None else out.union(own)
    return out


_SUSPECT = f"{_AB}, listed as (select sample from bal where status <> 'exempt' group by sample having median(ab) < 0.43)"


def _listed(spark, d):
    """Samples that quality tables would list: a low median balance."""
    return qc_tables.ab_per_sample(_balanced(spark, d)).filter("median_ab < 0.43").select("sample")


_CONTAM = "cont as (select m.* exclude (contam), contam or l.sample is not null as contam, case when contam then 'metadata' when l.sample is not null then 'QC' end as contam_source from meta m left join listed l on m.sample = l.sample)"


@query(f"{_SUSPECT}, {_CONTAM} select sample, contam, contam_source from cont")
def contam_sources(spark, d):
    """Flagged samples and who flagged them."""
    return qc_tables.with_contam(v.meta(spark, d), _listed(spark, d)).select("sample", "contam", "contam_source")


@query(f"{_SUSPECT} select sample from meta where contam union select sample from listed")
def removed_samples(spark, d):
    """The union of the removal lists."""
    return cohort.removal_list(v.meta(spark, d).filter("contam"), _listed(spark, d))


@query(f"{_SUSPECT} select sample, count(*) as n from calls where sample not in (select sample from listed union select sample from meta where contam) group by sample")
def calls_without_removed(spark, d):
    """Calls of the samples that are left."""
    gone = cohort.removal_list(v.meta(spark, d).filter("contam"), _listed(spark, d))
    return qc_tables.count_by(cohort.drop_ids(v.calls(spark, d), gone, "sample"), "sample")


@query("select c.locus, count(*) as n from calls c where c.locus in (select locus from loci where len > 20) group by c.locus")
def calls_in_long_loci(spark, d):
    """Calls within some intervals, told by their place."""
    bed = v.loci(spark, d).filter("end - start > 20")
    rows = intervals.restrict_to(v.calls(spark, d).drop("locus"), bed)
    return rows.select((F.floor(F.col("pos") / 1000)).cast("int").alias("locus")).groupBy("locus").agg(F.count("*").alias("n"))


@query(f"{_COUNTS} select l.chrom, l.start, l.\"end\", l.locus, n_het, n_alt, n_ref, n_miss, round(mean_dp, 6) as mean_dp, n_dp from loci l join counts c on c.locus = l.locus where c.sample = 7")
def counts_of_a_sample(spark, d):
    """One sample's counts in the layout of the intervals."""
    own = counts.counts_per_locus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))
    return rounded(counts.counts_bed_layout(v.loci(spark, d), own, 7))


@query(f"{_AB}, {_SITES} select locus from locus_stats where site_frac > 0.05 and n_excess >= 3 intersect select locus from skew where n_ab_samples >= 5 and n_skewed / n_ab_samples > 0.1")
def loci_flagged_twice(spark, d):
    """Loci that both tests flag."""
    stats = cohort.excess_het_loci(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d))
    rows = cohort.attach_ab(stats, cohort.ab_skew(_balanced(spark, d), min_hets=2))
    return cohort.flagged_by_both(cohort.flag_excess_het(rows), cohort.flag_ab_skew(rows, max_frac=0.1, min_samples=5))


_LOCUS_MISS = f"{_SEQS}, lm as (select locus, avg(100 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq)) as mean_pct_n, max(length(seq)) as length from seqs group by locus), sm as (select sample, avg(100 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq)) as mean_pct_n from seqs group by sample)"


def _seqs(spark, d):
    return sequences.consensus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))


_TRIM = f"{_SEQS}, trims as (select locus, count(*) as n, min(col) filter (where n_gap / n <= 0.3) as a, max(col) filter (where n_gap / n <= 0.3) as b from cols group by locus)"


@query(f"{_TRIM} select chrom, start + coalesce(a, 1) - 1 as start, start + coalesce(b, n) as \"end\", l.locus from loci l join trims t on l.locus = t.locus")
def trimmed_intervals(spark, d):
    """Intervals of what trimming leaves."""
    return sequences.trimmed_bed(v.loci(spark, d), sequences.trim_ranges(sequences.column_stats(_seqs(spark, d)), max_gap=0.3))


@query(f"{_TRIM} select sample, s.locus, substr(seq, coalesce(a, 1), coalesce(b, n) - coalesce(a, 1) + 1) as seq from seqs s join trims t on s.locus = t.locus")
def trimmed_sequences(spark, d):
    """Alignments without their ends."""
    seqs = _seqs(spark, d)
    return sequences.trim_ends(seqs, sequences.trim_ranges(sequences.column_stats(seqs), max_gap=0.3)).select("sample", "locus", "seq")


@query(f"{_SEQS} select min(length(seq))::int as min, round(avg(length(seq)), 6) as mean, median(length(seq)) as median, max(length(seq))::int as max from seqs")
def sequence_lengths(spark, d):
    """Least, mean, median, greatest length."""
    return rounded(sequences.length_summary(_seqs(spark, d)))


@query(f"{_SEQS} select distinct locus, length(seq)::int as length from seqs")
def probe_lengths(spark, d):
    """Length of each sequence."""
    return sequences.seq_lengths(_seqs(spark, d)).distinct()


@query(f"{_LOCUS_MISS} select sample, round(mean_pct_n, 6) as mean_pct_n, (row_number() over (order by mean_pct_n desc, sample))::int as place from sm")
def samples_by_missingness(spark, d):
    """Samples, the most incomplete first (K5)."""
    rows = sequences.samples_by_missingness(sequences.missingness_per_sample(_seqs(spark, d)), place="place")
    return rounded(rows.select("sample", "mean_pct_n", F.col("place").cast("int").alias("place")))


@query("select sample, count(*) as n from calls where sample in (select sample from samples order by sample limit 5) group by sample")
def quick_run(spark, d):
    """Calls of the first five samples, the feature being the limit (K6)."""
    few = cohort.first_samples(v.samples(spark, d), 5)
    return qc_tables.count_by(v.calls(spark, d).join(few, "sample", "left_semi"), "sample")


@query("select count(*) as n_hits, count(distinct query) as n_queries, count(distinct subject) as n_subjects from hits")
def hit_counts(spark, d):
    """Hits, queries, subjects."""
    return hits.hit_counts(v.hits(spark, d))


@query("h as (select query || '-' || subject as query, o as subject, pident, qcov from hits), a as (select *, max(pident) over (partition by query) as mi, max(qcov) over (partition by query) as mc, count(*) over (partition by query) as n from h) select query, subject, pident, qcov from a where mi >= 85 and mc >= 80 and n = 1")
def single_hits(spark, d):
    """Hits of part and supplier pairs that have one, after the filter by any hit."""
    own = v.hits(spark, d).select(F.concat_ws("-", F.col("query").cast("string"), F.col("subject").cast("string")).alias("query"), F.col("o").alias("subject"), "pident", "qcov")
    return hits.drop_multi_hits(hits.filter_any_hit(own, 85, 80), own).select("query", "subject", "pident", "qcov")


@query("""pr as (select chrom, start + 5 as s, "end" - 5 as e, locus from loci), near as (select c.*, least(c.pos - p.s, p.e - c.pos + 1) as dist, p.e - p.s as len from calls c join pr p on c.chrom = p.chrom and c.pos > p.s - 300 and c.pos <= p.e + 300)
select case when len < 12 then 'short' else 'long' end as class, case when dist > 0 then 'probe' else 'flank' end as region, count(*) as n_pos, count(*) filter (where code <> 'miss') as n_called, round(avg(dp) filter (where code <> 'miss'), 6) as mean_dp, round(count(*) filter (where code <> 'miss') / count(*), 6) as call_frac from near group by all""")
def depth_by_region(spark, d):
    """Depth inside and beside probes."""
    return rounded(sites.depth_profile(v.calls(spark, d), _probes(spark, d), by_region=True, long_from=12))


@query("""pr as (select chrom, start + 5 as s, "end" - 5 as e, locus from loci), near as (select c.*, least(c.pos - p.s, p.e - c.pos + 1) as dist, p.e - p.s as len from calls c join pr p on c.chrom = p.chrom and c.pos > p.s - 300 and c.pos <= p.e + 300),
k as (select *, case when len < 12 then 'short' else 'long' end as class, case when dist > 0 then 'probe' else 'flank' end as region, (case when dist > 0 then floor((dist - 1) / 5) * 5 else -floor(-dist / 5) * 5 - 5 end)::int as bin from near)
select class, region, bin, count(*) as n_pos, count(*) filter (where code <> 'miss') as n_called, round(avg(dp) filter (where code <> 'miss'), 6) as mean_dp, round(count(*) filter (where code <> 'miss') / count(*), 6) as call_frac from k group by grouping sets ((class, bin), (class, region))""")
def depth_levels(spark, d):
    """Depth by distance and by region from one join."""
    return rounded(sites.depth_profiles(v.calls(spark, d), _probes(spark, d), bin=5, long_from=12))


def _probes(spark, d):
    return v.loci(spark, d).withColumns({"start": F.col("start") + 5, "end": F.col("end") - 5})


@query("""pr as (select chrom, start + 5 as s, "end" - 5 as e, locus from loci), near as (select c.*, least(c.pos - p.s, p.e - c.pos + 1) as dist, p.e - p.s as len from calls c join pr p on c.chrom = p.chrom and c.pos > p.s - 300 and c.pos <= p.e + 300),
bins as (select case when len < 12 then 'short' else 'long' end as class, (case when dist > 0 then floor((dist - 1) / 2) * 2 else -floor(-dist / 2) * 2 - 2 end)::int as bin, count(*) as n_pos from near group by all),
m as (select class, median(n_pos) as mid from bins group by class)
select b.class, bin, n_pos from bins b join m on b.class = m.class where n_pos >= 0.5 * mid""")
def thick_bins(spark, d):
    """The depth profile without thin bins."""
    profile = sites.depth_profile(v.calls(spark, d), _probes(spark, d), bin=2, long_from=12)
    return sites.thin_bins(profile, 0.5).select("class", "bin", "n_pos")


@query(f"{_TARGET} select s.sample, on_target_bp, round(100 * on_target_bp / total_bp, 6) as pct_on_target, round(on_target_bp / span, 6) as target_mean_dp, round((on_target_bp / span) / 29.5, 6) as enrichment from samples s cross join span left join (select w.sample, total_bp, coalesce(on_target_bp, 0) as on_target_bp from whole w left join onb o on w.sample = o.sample) x on s.sample = x.sample")
def enrichment(spark, d):
    """Enrichment over a genome depth of 29.5; null for a sample without windows."""
    rows = sites.on_target_stats(v.windows(spark, d), v.targets(spark, d), F.lit(29.5))
    return rounded(v.samples(spark, d).join(rows, "sample", "left").select("sample", "on_target_bp", "pct_on_target", "target_mean_dp", "enrichment"))


_RATES = "rates as (select sample, n_reads, n_duplicate, 100 * n_mapped / n_reads as pct_mapped, 100 * n_paired / n_reads as pct_paired, 100 * n_mq0 / n_reads as pct_mq0, 100 * n_duplicate / n_reads as pct_duplication from mapping)"


@query(f"{_RATES} select sample, round(pct_mapped, 6) as pct_mapped, round(pct_paired, 6) as pct_paired, round(pct_mq0, 6) as pct_mq0 from rates")
def mapping_rates(spark, d):
    """Percent mapped, paired, of quality 0."""
    return rounded(readers.with_rates(v.mapping(spark, d)).select("sample", "pct_mapped", "pct_paired", "pct_mq0"))


def _rates(spark, d):
    rows = readers.with_rates(v.mapping(spark, d))
    return rows.select("sample", "n_reads", "pct_mapped", F.try_divide(100 * F.col("n_duplicate"), F.col("n_reads")).alias("pct_duplication"))


_SAMPLE = f"""{_CALLED}, {_SUSPECT}, {_CONTAM}, {_LOCUS_MISS}, {_VAR}, {_RATES}, {_TARGET},
kept as (select sample from sm where mean_pct_n <= 40 and sample not in (select sample from cont where contam)),
dp as (select sample, avg(dp) filter (where code <> 'miss') as mean_dp from calls group by sample),
abs_ as (select sample, 100 * count(*) filter (where status = 'blanked') / count(*) as pct_blanked, median(ab) as median_ab from bal where status <> 'exempt' group by sample),
tgt as (select w.sample, coalesce(on_target_bp, 0) / span as target_mean_dp from whole w cross join span left join onb o on w.sample = o.sample),
per_sample as (select c.sample, c.contam, c.seq_batch, k.sample is not null as retained, sm.mean_pct_n, dp.mean_dp, x.sex, x.f = '' as confident, ts_tv, n_singletons, n_reads, pct_mapped, pct_duplication, pct_blanked, median_ab, target_mean_dp
    from cont c left join kept k on c.sample = k.sample left join sm on c.sample = sm.sample left join dp on c.sample = dp.sample left join sexed x on c.sample = x.sample left join stats9 v on c.sample = v.sample left join rates r on c.sample = r.sample left join abs_ a on c.sample = a.sample left join tgt t on c.sample = t.sample)"""


def _per_sample(spark, d):
    meta = qc_tables.with_contam(v.meta(spark, d), _listed(spark, d)).select("sample", "contam", "seq_batch")
    miss = sequences.missingness_per_sample(_seqs(spark, d)).select("sample", "mean_pct_n")
    kept = cohort.drop_ids(sequences.keep_samples(miss, 40), meta.filter("contam"), "sample")
    parts = [
        miss, counts.depth_per_sample(v.calls(spark, d)).select("sample", "mean_dp"), _sexed(spark, d).select("sample", "sex", "confident"),
        sites.sample_variant_stats(_with_indels(v.calls(spark, d)), v.samples(spark, d)).select("sample", "ts_tv", "n_singletons"), _rates(spark, d),
        qc_tables.ab_per_sample(_balanced(spark, d)).select("sample", "pct_blanked", "median_ab"),
        sites.on_target_stats(v.windows(spark, d), v.targets(spark, d)).select("sample", "target_mean_dp"), None,
    ]
    return qc_tables.per_sample_table(meta, kept, parts, [""] * 7 + ["insert_size double"])


@query(f"{_SAMPLE} select sample, case when retained then 'retained' when contam then 'flagged contaminant' when mean_pct_n is not null then 'missingness' else 'no data' end as stage, round(mean_pct_n, 6) as mean_pct_n, sex, round(mean_dp, 6) as mean_dp, round(target_mean_dp, 6) as target_mean_dp, round(mean_dp / target_mean_dp, 6) as dp_called_vs_target, null::double as insert_size from per_sample")
def sample_table(spark, d):
    """The wide table of samples: stages, sexes, depths; one input is absent."""
    rows = qc_tables.depth_called_vs_target(qc_tables.stage_sample(_per_sample(spark, d)))
    return rounded(rows.select("sample", "stage", "mean_pct_n", "sex", "mean_dp", "target_mean_dp", "dp_called_vs_target", "insert_size"))


_Q = ", ".join(f"quantile_cont({c}, {0.05 if side == 'low' else 0.95}) as q_{c}" for c, side in qc_tables.WATCHED.items())
_FLAGS = ", ".join(f"coalesce({c} {'<' if side == 'low' else '>'} q_{c}, false) as flag_{c}" for c, side in qc_tables.WATCHED.items())
_CHECKS = [*qc_tables.WATCHED, "confident"]
_WATCH = f"""{_SAMPLE}, q as (select seq_batch, {_Q} from per_sample group by seq_batch),
fl as (select p.*, {_FLAGS}, coalesce(not confident, false) as flag_confident from per_sample p join q on p.seq_batch = q.seq_batch),
watched as (select *, {" + ".join(f"flag_{c}::int" for c in _CHECKS)} as n_flags, concat_ws(', ', {", ".join(f"case when flag_{c} then '{c}' end" for c in _CHECKS)}) as failed from fl)"""


def _watched(spark, d):
    return qc_tables.watch_flags(_per_sample(spark, d), "seq_batch", unsure=True)


@query(f"{_WATCH} select sample, seq_batch, {', '.join(f'flag_{c}' for c in _CHECKS)}, n_flags from watched")
def all_watch_flags(spark, d):
    """All nine checks of a sample within its batch."""
    return _watched(spark, d).select("sample", "seq_batch", *[f"flag_{c}" for c in _CHECKS], "n_flags")


@query(f"{_WATCH} select sample, n_flags, failed from watched where n_flags >= 2")
def watch_list(spark, d):
    """Samples with two flags or more, and which."""
    return qc_tables.watch_list(_watched(spark, d), _CHECKS).select("sample", "n_flags", "failed")


@query(f"{_SAMPLE} select sample, round(median_ab, 6) as median_ab, confident from per_sample where contam and (median_ab < 0.45 or coalesce(not confident, true))")
def flagged_suspects(spark, d):
    """Flagged samples that look suspect."""
    rows = qc_tables.flagged_suspects(_per_sample(spark, d).withColumn("flagged", F.col("contam")), 0.45)
    return rounded(rows.select("sample", "median_ab", "confident"))


@query(f"{_SAMPLE} select case when retained then 'retained' else 'flagged' end as \"group\", count(*) as n, round(median(mean_pct_n), 6) as median_mean_pct_n, round(median(ts_tv), 6) as median_ts_tv, round(median(1000000 * mean_dp / n_reads), 6) as median_dp_per_million from per_sample where retained or contam group by retained")
def flagged_and_retained(spark, d):
    """Medians of flagged and of retained samples, depth per million reads."""
    rows = qc_tables.depth_per_million(_per_sample(spark, d))
    return rounded(qc_tables.flagged_vs_retained(rows, ["mean_pct_n", "ts_tv", "dp_per_million"]))


@query(f"{_SAMPLE} select sample, round(mean_dp, 6) as mean_dp from per_sample order by per_sample.mean_dp desc, sample limit 5")
def deepest_samples(spark, d):
    """The five deepest samples (K4)."""
    return rounded(qc_tables.lowest(_per_sample(spark, d).select("sample", "mean_dp"), "mean_dp", "sample", 5, descending=True))


_LOCUS = f"""{_CALLED}, {_AB}, {_SITES}, {_LOCUS_MISS},
kept as (select locus from lm where mean_pct_n <= 42 and length >= 20),
fc as (select locus, avg(mean_dp) as mean_dp from counts group by locus),
per_locus as (select lm.locus, lm.length, lm.mean_pct_n, k.locus is not null as kept_missing, fc.mean_dp, case when z.class in ('paralog', 'gametolog') then z.class end as z_class, site_frac,
    site_frac > 0.05 and n_excess >= 3 as excess_het, coalesce(n_ab_samples >= 5 and n_skewed / n_ab_samples > 0.5, false) as ab_skew
    from lm left join kept k on lm.locus = k.locus left join fc on lm.locus = fc.locus left join classes2 z on lm.locus = z.locus left join locus_stats s on lm.locus = s.locus left join skew w on lm.locus = w.locus),
staged as (select *, kept_missing and not excess_het and not ab_skew and z_class is null as retained from per_locus)"""


def _per_locus(spark, d):
    own, _, classes = _passes(spark, d)
    miss = sequences.missingness_per_locus(_seqs(spark, d))
    stats = cohort.excess_het_loci(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d))
    stats = cohort.attach_ab(stats, cohort.ab_skew(_balanced(spark, d), min_hets=2))
    stats = stats.select(
        "locus", "site_frac", ((F.col("site_frac") > 0.05) & (F.col("n_excess") >= 3)).alias("excess_het"), ((F.col("n_ab_samples") >= 5) & (F.col("skew_frac") > 0.5)).alias("ab_skew")
    )
    z = sex.exclusion_list(classes, "paralogs").join(classes.select("locus", F.col("class").alias("z_class")), "locus")
    parts = [qc_tables.locus_from_counts(own).select("locus", "mean_dp"), z, stats, None]
    rows = qc_tables.per_locus_table(miss.select("locus", "mean_pct_n"), miss.select("locus", "length"), sequences.keep_loci(miss, 42, 20), parts, ["", "", "", "n_trimmed long"])
    retained = F.col("kept_missing") & ~F.col("excess_het") & ~F.col("ab_skew") & F.col("z_class").isNull()
    return qc_tables.stage_locus(rows.withColumn("retained", retained), min_length=20)


_STAGE = "case when retained then 'retained' when excess_het then 'excess het' when ab_skew then 'allele balance' when z_class is not null then 'Z (' || z_class || ')' when length < 20 then 'too short' when not kept_missing then 'missingness' else 'other' end"


@query(f"{_LOCUS} select locus, length::int as length, round(mean_pct_n, 6) as mean_pct_n, kept_missing, round(mean_dp, 6) as mean_dp, z_class, round(site_frac, 6) as site_frac, null::bigint as n_trimmed, {_STAGE} as stage from staged")
def locus_table(spark, d):
    """The wide table of loci with the stage at which each went."""
    return rounded(_per_locus(spark, d).select("locus", "length", "mean_pct_n", "kept_missing", "mean_dp", "z_class", "site_frac", "n_trimmed", "stage"))


@query(f"{_LOCUS} select {_STAGE} as stage, count(*) as n from staged group by all")
def all_locus_stages(spark, d):
    """Loci by stage."""
    return qc_tables.count_by(_per_locus(spark, d), "stage")


@query(f"""{_LOCUS}, {_SUSPECT.split("listed as")[1].join(["listed as", ""])}, {_CONTAM}, sk as (select sample from sm where mean_pct_n <= 40 and sample not in (select sample from cont where contam)),
n as (select (select count(*) from staged) as l, (select count(*) from staged where kept_missing) as lk, (select count(*) from staged where kept_missing and z_class is null) as lz, (select count(*) from staged where retained) as lr, (select count(*) from cont) as s, (select count(*) from cont where not contam) as sc, (select count(*) from sk) as sk)
select * from (select 0 as step, 'input' as name, l as n_loci, s as n_samples from n union all select 1, 'contaminants', l, sc from n union all select 2, 'samples', l, sk from n union all select 3, 'loci', lk, sk from n union all select 4, 'sex loci', lz, sk from n union all select 5, 'paralogs', lr, sk from n)""")
def filtering_summary(spark, d):
    """Loci and samples left after each of six steps."""
    loci, meta = _per_locus(spark, d), qc_tables.with_contam(v.meta(spark, d), _listed(spark, d))
    clean = meta.filter("not contam")
    miss = sequences.missingness_per_sample(_seqs(spark, d))
    kept = cohort.drop_ids(sequences.keep_samples(miss, 40), meta.filter("contam"), "sample")
    own = loci.filter("kept_missing")
    return qc_tables.filtering_summary([
        ("input", loci, meta), ("contaminants", loci, clean), ("samples", loci, kept), ("loci", own, kept),
        ("sex loci", own.filter("z_class is null"), kept), ("paralogs", loci.filter("retained"), kept),
    ])


@query(f"""{_COUNTS}, long as (select sample, locus, n_het + n_alt + n_ref as called, n_het + n_alt + n_ref + n_miss as len, unnest(['n_het', 'n_alt', 'n_diff', 'n_miss']) as metric, unnest([n_het::double, n_alt, n_alt + n_het / 2, n_miss]) as value from counts)
select sample, metric, round(avg(case when metric = 'n_miss' then 100 * value / len when called > 0 then 100 * value / called end), 6) as mean_pct from long group by all""")
def genotype_percentages(spark, d):
    """Mean percentage of each genotype over loci."""
    long = qc_tables.counts_long(counts.counts_per_locus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d)))
    return rounded(qc_tables.geno_per_sample(long))


@query(f"{_TRIM}, own as (select locus, coalesce(b, n) - coalesce(a, 1) + 1 as len from trims) select l.locus, l.len as length, o.len as other_length from loci l join own o on l.locus = o.locus where l.len <> o.len")
def length_mismatches(spark, d):
    """Loci whose length two tables give differently: before and after trimming."""
    loci = counts.with_length(v.loci(spark, d))
    trimmed = counts.with_length(sequences.trimmed_bed(v.loci(spark, d), sequences.trim_ranges(sequences.column_stats(_seqs(spark, d)), max_gap=0.3)))
    return qc_tables.check_lengths(loci, trimmed)


@query(f"{_SUSPECT}, {_CONTAM} select sample, count(*) as n_het, null::bigint as n_flagged from calls where code = 'het' and sample not in (select sample from cont where contam) group by sample union all select sample, null, count(*) from calls where sample in (select sample from cont where contam) group by sample")
def side_cohort(spark, d):
    """Flagged samples scored beside the retained ones; of both, retained rows win."""
    meta = qc_tables.with_contam(v.meta(spark, d), _listed(spark, d))
    calls = v.calls(spark, d)
    base = cohort.drop_ids(calls.filter("code = 'het'"), meta.filter("contam"), "sample").groupBy("sample").agg(F.count("*").alias("n_het"))
    extra = calls.groupBy("sample").agg(F.count("*").alias("n_flagged"))
    return qc_tables.append_missing(base, extra, "sample", meta.filter("contam"))


@query("select o_custkey as sample, count(*) as n from orders group by all having count(*) > 1")
def repeated_ids(spark, d):
    """IDs that occur twice or more (U4)."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("sample"))
    return qc_tables.duplicate_ids(rows, "sample")


@query("select sample from windows except select sample from samples")
def unknown_samples(spark, d):
    """Samples with windows but no entry in the list of samples (U4)."""
    return qc_tables.unknown_ids(v.windows(spark, d).select(F.col("sample").cast("long").alias("sample")), v.samples(spark, d), "sample")


@query("select locus, chrom || ':' || (start + 1) || '-' || \"end\" as region, start, \"end\", '_x_' || chrom || '_' as infix, case when len < 20 then 'short' else 'long' end as class from loci")
def region_names(spark, d):
    """Names of intervals and the intervals of names, both ways; length classes."""
    loci = v.loci(spark, d)
    region = g.region_name(F.col("chrom"), F.col("start"), F.col("end"))
    name = F.concat(F.lit("L1_x_"), "chrom", F.lit("_"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(".fa"))
    rows = loci.select("locus", region.alias("region"), name.alias("name"), g.length_class(F.col("end") - F.col("start"), 20).alias("class"))
    rows = rows.select("locus", "region", "class", g.interval_of_region(F.col("region")).alias("a"), g.interval_of_locus(F.col("name")).alias("b"))
    return rows.filter("a = b").select("locus", "region", F.col("a.start").alias("start"), F.col("b.end").alias("end"), F.concat(F.lit("_x_"), "b.chrom", F.lit("_")).alias("infix"), "class")


@query("""w as (select p_partkey, p_name, replace(p_name, ' ', '/') || case when p_partkey % 3 = 0 then '' else '_x_' || p_partkey end as name from part), safe as (select distinct name as locus, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') as safe from w),
n as (select *, row_number() over (partition by safe order by locus) as k from safe)
select locus, safe || case when k = 1 then '' else '__' || k end as file_name, string_split(locus, '_')[-1] as last, case when starts_with(locus, 'lemon') then substr(locus, 6) else locus end as rest from n""")
def file_names(spark, d):
    """Safe unique names, the text after the last underscore, names without a prefix."""
    p = spark.read.parquet(f"{d}/part.parquet")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("_x_"), F.col("p_partkey").cast("string"))))
    rows = sequences.locus_file_names(p.select(name.alias("locus")))
    return rows.select("locus", "file_name", g.short_sample(F.col("locus")).alias("last"), g.without_prefix(F.col("locus"), "lemon").alias("rest"))


_DIST = """near as (select a.sample, a.pos, a.code, min(abs(a.pos - b.pos)) as dist from calls a left join calls b on a.sample = b.sample and a.chrom = b.chrom and b.is_indel where not a.is_indel and a.code <> 'miss' group by all),
cls as (select *, case when dist <= 3 then '1-3' when dist <= 5 then '4-5' when dist <= 10 then '6-10' when dist <= 20 then '11-20' when dist <= 50 then '21-50' when dist <= 100 then '51-100' when dist <= 200 then '101-200' else 'background' end as distance from near),
cr as (select distance, count(*) as n_callable, count(*) filter (where code in ('het', 'alt')) as n_snps, 1000 * count(*) filter (where code in ('het', 'alt')) / count(*) as rate, 100 * count(*) filter (where code = 'het') / nullif(count(*) filter (where code in ('het', 'alt')), 0) as het from cls group by distance)"""


@query(f"{_DIST} select c.distance, n_callable, n_snps, round(rate, 6) as snps_per_kb, round(het, 6) as pct_het, round(rate / b0, 6) as rel_rate, round(het / h0, 6) as rel_het from cr c left join (select rate as b0, het as h0 from cr where distance = 'background') on true")
def rates_by_indel_distance(spark, d):
    """SNP rate and share of heterozygotes by distance to the nearest indel."""
    return rounded(sites.rates_by_indel_distance(v.calls(spark, d)))


@query("""t as (select unnest([0, 1, 2, 3])::int as tolerance), h as (select * from calls, t where code = 'het'), j as (select *, ao + ro > 0 and abs(ao + ro - raw_dp) <= tolerance as ok from h)
select tolerance, count(*) as n_het, round(100 * count(*) filter (where not ok) / count(*), 6) as pct_unjudged, round(100 * count(*) filter (where ok and (ao / (ao + ro) < 0.25 or ao / (ao + ro) > 0.75)) / nullif(count(*) filter (where ok), 0), 6) as pct_blanked from j group by tolerance""")
def balance_by_tolerance(spark, d):
    """Heterozygotes that are not judged, and those blanked, by tolerance."""
    return rounded(sites.balance_by_tolerance(v.het_ab(spark, d)))


@query("""drawn as (select sample, row_number() over (order by md5('0:' || sample), sample) as r from samples), sizes as (select unnest([2, 4, 8])::int as n),
seen as (select n, locus, pos, count(*) filter (where code in ('het', 'alt')) as a, count(*) filter (where code <> 'miss') as called from calls c join drawn d on c.sample = d.sample join sizes on r <= n group by all),
scored as (select *, called - a as r from seen where called > 0 and called >= 0.25 * n),
totals as (select n, count(*) as n_scored, count(*) filter (where a > 0 and r > 0) as n_variable, count(*) filter (where a >= 2 and r >= 2) as n_pi from scored group by n)
select s.n, coalesce(n_scored, 0) as n_scored, coalesce(n_variable, 0) as n_variable, coalesce(n_pi, 0) as n_pi, round(100 * n_variable / n_scored, 6) as pct_variable, round(100 * n_pi / n_scored, 6) as pct_pi from sizes s left join totals t on s.n = t.n""")
def rarefaction(spark, d):
    """Informative sites of growing random sets of samples, from one pass (D3)."""
    return rounded(sites.rarefaction(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d), (2, 4, 8)))
