"""Queries over the views: each runs operators on whole tables; ORACLE_SQL has plain SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociforge.functions.genotypes import ab_status, balance
from lociforge.jobs import views as v
from lociforge.jobs.registry import query, rounded, sample_count
from lociforge.operators import calls as oc
from lociforge.operators import cohort, counts, hits, intervals, qc_tables, sequences, sex, sites

_SITES = """sites as (select locus, chrom, pos, count(*) filter (where code = 'het') as n_het, count(*) filter (where code <> 'miss') as called from calls group by all),
scored as (select *, called > 0 and called >= 0.25 * n as ok, case when called > 0 then n_het / called else 0 end as f from sites, size),
stats as (select l.locus, any_value(l.len) as length, count(*) filter (where ok) as n_sites, count(*) filter (where ok and f > 0.6) as n_excess,
    coalesce(max(f) filter (where ok), 0) as max_site_het_frac, coalesce(sum(n_het), 0)::bigint as total_het, any_value(size.n) as n
    from loci l cross join size left join scored s on l.locus = s.locus group by l.locus),
locus_stats as (select locus, length, n_sites, n_excess, case when n_sites > 0 then n_excess / n_sites else 0 end as site_frac, max_site_het_frac, total_het,
    total_het / (n * length) as het_density from stats)"""


@query(f"{_SITES} select locus, length::bigint as length, n_sites, n_excess, round(site_frac, 6) as site_frac, round(max_site_het_frac, 6) as max_site_het_frac, total_het, round(het_density, 6) as het_density from locus_stats where site_frac > 0.05 and n_excess >= 3")
def paralog_loci(spark, d):
    """Which loci look like collapsed paralogs: F13, A3, A4, F16, K1."""
    stats = cohort.excess_het_loci(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d))
    return rounded(cohort.flag_excess_het(stats)).orderBy(F.desc("site_frac"), F.desc("n_excess"), "locus")


@query(f"{_SITES} select locus, length::bigint as length, n_sites, n_excess, round(site_frac, 6) as site_frac, round(max_site_het_frac, 6) as max_site_het_frac, total_het, round(het_density, 6) as het_density from locus_stats")
def excess_het_stats(spark, d):
    return rounded(cohort.excess_het_loci(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d)))


@query(f"{_SITES} select locus, chrom, pos, n_het, n - called as n_miss, called, round(f, 6) as f from scored")
def site_het(spark, d):
    return rounded(cohort.per_site_het(v.calls(spark, d), sample_count(spark, d)))


@query(f"{_SITES}, r as (select site_frac as x, row_number() over (order by site_frac) - 1 as k, count(*) over () as n from locus_stats) select p.share, round(x, 6) as value from r, (values (0.5::double), (0.9), (0.95), (0.99)) p(share) where k = least(cast(floor(n * p.share) as bigint), n - 1)")
def site_frac_percentiles(spark, d):
    stats = cohort.excess_het_loci(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d))
    return rounded(cohort.percentiles_floor(stats, "site_frac"))


_COUNTS = """counts as (select s.sample, l.locus, count(*) filter (where code = 'het') as n_het, count(*) filter (where code = 'alt') as n_alt, count(*) filter (where code = 'ref') as n_ref,
    any_value(l.len) - count(*) filter (where code in ('het', 'alt', 'ref')) as n_miss, avg(dp) filter (where code <> 'miss') as mean_dp, count(dp) filter (where code <> 'miss') as n_dp
    from samples s cross join loci l left join calls c on s.sample = c.sample and l.locus = c.locus group by s.sample, l.locus)"""


@query(f"{_COUNTS} select sample, locus, n_het, n_alt, n_ref, n_miss, round(mean_dp, 6) as mean_dp, n_dp from counts")
def counts_per_locus(spark, d):
    return rounded(counts.counts_per_locus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d)))


@query("select sample, round(avg(dp) filter (where code <> 'miss'), 6) as mean_dp, count(dp) filter (where code <> 'miss') as n_dp from calls group by sample")
def depth_per_sample(spark, d):
    return rounded(counts.depth_per_sample(v.calls(spark, d)))


@query("""places as (select l.chrom, l.locus, l.start + o as pos from loci l, range(1, 201) r(o) where o <= l.len),
wide as (select s.sample, p.chrom, p.pos, p.locus, coalesce(c.code, 'miss') as code from samples s cross join places p left join calls c on c.sample = s.sample and c.chrom = p.chrom and c.pos = p.pos)
select sample, locus, code, count(*) as n from wide where code <> 'ref' group by all""")
def sparse_sites(spark, d):
    """The sparse table with explicit missing positions (J7), counted by code."""
    rows = counts.fill_missing_positions(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))
    return qc_tables.count_by(rows, "sample", "locus", "code")


_AB = """ab as (select *, case when ao + ro > 0 and abs(ao + ro - raw_dp) <= 2 then case when ao / (ao + ro) < 0.25 or ao / (ao + ro) > 0.75 then 'blanked' else 'kept' end else 'exempt' end as status
    from calls where code = 'het'),
bal as (select *, case when status <> 'exempt' then ao / (ao + ro) end as ab from ab),
med as (select locus, sample, count(*) as n, median(ab) as m from bal where status <> 'exempt' group by all),
skew as (select locus, count(*) as n_ab_samples, count(*) filter (where m < 0.4) as n_skewed from med where n >= 2 group by locus)"""


def _balanced(spark, d):
    rows = v.het_ab(spark, d).withColumn("status", ab_status(F.col("ao"), F.col("ro"), F.col("dp")))
    return rows.withColumn("ab", F.when(F.col("status") != "exempt", balance(F.col("ao"), F.col("ro"))))


@query(f"{_AB} select sample, count(*) as n_het, count(*) filter (where status = 'kept') as n_kept, count(*) filter (where status = 'blanked') as n_blanked, count(*) filter (where status = 'exempt') as n_exempt from bal group by sample")
def ab_summary(spark, d):
    return qc_tables.ab_summary(_balanced(spark, d))


@query(f"{_AB} select sample, count(*) as n_judged, round(100 * count(*) filter (where status = 'blanked') / count(*), 6) as pct_blanked, round(median(ab), 6) as median_ab, round(100 * count(*) filter (where ab < 0.35) / count(*), 6) as pct_low_ab from bal where status <> 'exempt' group by sample")
def ab_per_sample(spark, d):
    return rounded(qc_tables.ab_per_sample(_balanced(spark, d)))


@query(f"{_AB}, {_SITES} select s.locus, n_excess, round(site_frac, 6) as site_frac, coalesce(n_ab_samples, 0) as n_ab_samples, coalesce(n_skewed, 0) as n_skewed, round(coalesce(n_skewed / n_ab_samples, 0), 6) as skew_frac, coalesce(site_frac > 0.05 and n_excess >= 3, false) as excess_het, coalesce(n_ab_samples >= 5 and n_skewed / n_ab_samples > 0.5, false) as ab_skew from locus_stats s left join skew k on s.locus = k.locus")
def locus_flags(spark, d):
    """Both paralog tests on every locus."""
    stats = cohort.excess_het_loci(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d))
    rows = cohort.attach_ab(stats, cohort.ab_skew(_balanced(spark, d), min_hets=2))
    excess = (F.col("site_frac") > 0.05) & (F.col("n_excess") >= 3)
    skewed = (F.col("n_ab_samples") >= 5) & (F.col("skew_frac") > 0.5)
    return rounded(rows.select("locus", "n_excess", "site_frac", "n_ab_samples", "n_skewed", "skew_frac", excess.alias("excess_het"), skewed.alias("ab_skew")))


@query(f"{_AB}, {_SITES} select locus from locus_stats where site_frac > 0.05 and n_excess >= 3 union select locus from skew where n_ab_samples >= 5 and n_skewed / n_ab_samples > 0.5")
def locus_blacklist(spark, d):
    stats = cohort.excess_het_loci(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d))
    rows = cohort.attach_ab(stats, cohort.ab_skew(_balanced(spark, d), min_hets=2))
    return cohort.blacklist(cohort.flag_excess_het(rows), cohort.flag_ab_skew(rows, min_samples=5))


#: The raw records, then the chain step by step: a genotype is h1, h2 (null: missing, '': REF), atoms are records of one ALT and one base.
_RAW = """raw as (select c.*, raw_dp + coalesce(a, 0) as dp1, kind in ('indel', 'mnv', 'two', 'complex') or (kind in ('plain', 'twice') and code in ('het', 'alt')) as has_alt, case kind when 'indel' then 1 when 'complex' then 3 else 0 end as more
    from calls c left join (values ('twice', 0), ('twice', 1)) w(again, a) on c.kind = w.again),
hits5 as (select distinct a.sample, a.chrom, a.pos from raw a join raw b on a.sample = b.sample and a.chrom = b.chrom and b.more > 0 and a.pos between b.pos - 5 and b.pos + b.more + 5 where a.has_alt and a.more = 0),
tagged as (select r.*, r.has_alt and r.more = 0 and h.pos is not null as near from raw r left join hits5 h on r.sample = h.sample and r.chrom = h.chrom and r.pos = h.pos),
masked as (select *, near or dp1 < 5 or gq < 20 or (has_alt and qual < 30) or code = 'miss' as gone from tagged),
atoms as (select sample, chrom, pos, locus, ref, case when has_alt then alt end as alt, dp1, gq, qual, ro, ao, near, case when gone then null when code = 'alt' then alt else '' end as h1, case when gone then null when code in ('het', 'alt') then alt else '' end as h2 from masked where kind in ('plain', 'twice')
    union all select sample, chrom, pos + o, locus, case o when 0 then ref when 1 then 'C' else 'G' end, null, dp1, gq, qual, ro, ao, near, case when not gone then '' end, case when not gone then '' end from masked, range(0, 3) r(o) where kind = 'block'
    union all select sample, chrom, pos, locus, ref, alt, dp1, gq, qual, ro, ao, near, case when not gone then alt end, case when not gone then '' end from masked where kind = 'two'
    union all select sample, chrom, pos, locus, ref, alt2, dp1, gq, qual, ro, ro, near, case when not gone then '' end, case when not gone then alt2 end from masked where kind = 'two'
    union all select sample, chrom, pos, locus, ref, alt, dp1, gq, qual, ro, ao, near, case when gone then null when code = 'alt' then alt else '' end, case when gone then null when code in ('het', 'alt') then alt else '' end from masked where kind = 'mnv'
    union all select sample, chrom, pos, locus, ref, alt, dp1, gq, qual, ro, ao, near, case when gone then null when code = 'alt' then alt else '' end, case when gone then null when code in ('het', 'alt') then alt else '' end from masked where kind = 'complex'
    union all select sample, chrom, pos + 1, locus, 'C', 'G', dp1, gq, qual, ro, ao, near, case when gone then null when code = 'alt' then 'G' else '' end, case when gone then null when code in ('het', 'alt') then 'G' else '' end from masked where kind = 'complex'
    union all select sample, chrom, pos + 2, locus, 'T', 'A', dp1, gq, qual, ro, ao, near, case when gone then null when code = 'alt' then 'A' else '' end, case when gone then null when code in ('het', 'alt') then 'A' else '' end from masked where kind = 'mnv'),
judged as (select *, h1 <> h2 and ao + ro > 0 and abs(ao + ro - dp1) <= 2 and (ao / (ao + ro) < 0.25 or ao / (ao + ro) > 0.75) as out_ from atoms),
balanced as (select * exclude (h1, h2, out_), case when not coalesce(out_, false) then h1 end as h1, case when not coalesce(out_, false) then h2 end as h2, count(*) over (partition by sample, chrom, pos) as k from judged),
final as (select *, case when h1 is null then 'miss' when h1 <> h2 then 'het' when h1 <> '' then 'alt' else 'ref' end as code2 from balanced where k = 1)"""


@query(f"{_RAW} select sample, count(*) as n_records, count(*) filter (where code2 = 'alt') as n_alt, count(*) filter (where code2 = 'het') as n_het, count(*) filter (where code2 = 'ref') as n_ref, count(*) filter (where code2 = 'miss') as n_miss, round(100 * count(*) filter (where code2 = 'alt') / count(*), 6) as pct_alt, round(100 * count(*) filter (where code2 = 'het') / count(*), 6) as pct_het, round(100 * count(*) filter (where code2 = 'ref') / count(*), 6) as pct_ref, round(100 * count(*) filter (where code2 = 'miss') / count(*), 6) as pct_miss from final group by sample")
def filter_chain(spark, d):
    """The whole genotype filter chain (F6-F12, J3, W5), summed per sample."""
    return rounded(oc.genotype_summary(oc.with_code(oc.filter_chain(v.raw_calls(spark, d)))))


@query(f"{_RAW} select sample, chrom, pos, ref, coalesce(alt, '.') as alt, code2 as code, dp1::int as dp, case when near then 'SnpGap' else '' end as filter from final")
def chain_records(spark, d):
    """The records that the chain leaves, with their codes and tags."""
    rows = oc.with_code(oc.filter_chain(v.raw_calls(spark, d)))
    return rows.select("sample", "chrom", "pos", "ref", F.coalesce(F.get("alt", F.lit(0)), F.lit(".")).alias("alt"), "code", "dp", F.array_join("filter", ",").alias("filter"))


@query(f"{_RAW} select sample, count(*) as n_before, count(*) filter (where k = 1) as n_after from balanced group by sample")
def single_records(spark, d):
    """Records before and after positions with several are dropped."""
    calls = oc.atomize(oc.split_multiallelic(oc.split_blocks(v.raw_calls(spark, d))))
    calls = oc.drop_indels(calls).select("sample", "chrom", "pos")
    after = oc.drop_multi_record(calls).groupBy("sample").agg(F.count("*").alias("n_after"))
    return calls.groupBy("sample").agg(F.count("*").alias("n_before")).join(after, "sample", "left").fillna(0, ["n_after"])


@query(f"""{_RAW}, blocks as (select sample, pos, locus, case when kind in ('plain', 'two', 'twice') then ref end as ref, 1 as len from raw where kind <> 'block' union all select sample, pos + o, locus, case o when 0 then ref when 1 then 'C' else 'G' end, 3 from raw, range(0, 3) r(o) where kind = 'block')
select sample, locus, count(*) as n, sum(pos)::bigint as pos, count(*) filter (where ref = 'G') as n_g, count(*) filter (where len = 3) as n_of_blocks from blocks group by all""")
def block_bases(spark, d):
    """Blocks spread over their bases."""
    rows = v.raw_calls(spark, d).withColumn("len", F.when((F.size("alt") == 0), F.length("ref")).otherwise(1))
    rows = oc.split_blocks(rows)
    return rows.groupBy("sample", "locus").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.count_if(F.col("ref") == "G").alias("n_g"), F.count_if(F.col("len") == 3).alias("n_of_blocks"))


@query("""select sample, pos, ref, alt, gt, ao, count(*) as n from (
    select sample, pos, ref, alt, case code when 'miss' then '.' when 'het' then '0/1' when 'alt' then '1/1' else '0/0' end as gt, ao from calls where kind = 'mnv'
    union all select sample, pos + 2, 'T', 'A', case code when 'miss' then '.' when 'het' then '0/1' when 'alt' then '1/1' else '0/0' end, ao from calls where kind = 'mnv'
    union all select sample, pos + least(o, 1), case o when 0 then ref when 1 then 'C' else 'CT' end, case o when 0 then alt when 1 then 'G' else 'C' end, case code when 'miss' then '.' when 'het' then '0/1' when 'alt' then '1/1' else '0/0' end, ao from calls, range(0, 3) r(o) where kind = 'complex'
    union all select sample, pos, ref, alt, case code when 'miss' then '.' else '1/0' end, ao from calls where kind = 'two'
    union all select sample, pos, ref, alt2, case code when 'miss' then '.' else '0/1' end, ro from calls where kind = 'two') group by all""")
def split_alleles(spark, d):
    """Records of two ALTs or of several bases become one of each, those of unequal length SNPs and an indel."""
    raw = v.raw_calls(spark, d).filter((F.size("alt") > 1) | ((F.size("alt") == 1) & (F.length("ref") >= 3)))
    rows = oc.atomize(oc.split_multiallelic(raw))
    gt = F.coalesce(F.array_join("gt", "/"), F.lit("."))
    return rows.groupBy("sample", "pos", "ref", F.get("alt", F.lit(0)).alias("alt"), gt.alias("gt"), F.get("ao", F.lit(0)).alias("ao")).agg(F.count("*").alias("n"))


@query(f"""{_RAW}, recs as (select *, row_number() over (partition by sample, chrom, pos order by ref, coalesce(alt, ''), dp1, gq, qual, ro) as rn from balanced),
alts as (select sample, chrom, pos, alt, min(rn) as first from recs where alt is not null group by all),
lists as (select sample, chrom, pos, list(alt order by first) as alts from alts group by all),
merged as (select r.sample, r.chrom, r.pos, arg_min(ref, rn) as ref, arg_min(dp1, rn)::int as dp, any_value(alts) as alts,
    arg_min(h1, rn) filter (where h1 <> '') as a1, bool_or(h1 = '') as r1, arg_min(h2, rn) filter (where h2 <> '') as a2, bool_or(h2 = '') as r2, bool_or(h1 is not null) as called, count(*) as n
    from recs r left join lists l on r.sample = l.sample and r.chrom = l.chrom and r.pos = l.pos group by all)
select sample, chrom, pos, ref, coalesce(array_to_string(alts, ','), '') as alt, dp, case when not called then '.' else coalesce(list_position(alts, a1), 0) || '/' || coalesce(list_position(alts, a2), 0) end as gt from merged""")
def merged_records(spark, d):
    """The chain with the records of a position merged instead of dropped."""
    rows = oc.filter_chain(v.raw_calls(spark, d), drop_multi=False)
    return rows.select("sample", "chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "dp", F.coalesce(F.array_join("gt", "/"), F.lit(".")).alias("gt"))


@query(f"""{_RAW}, b as (select sample, count(*) as n_raw, count(*) filter (where kind = 'block') as n_blocks from raw group by sample),
a as (select sample, count(*) as n_filtered, count(*) filter (where near) as n_snp_gap from final group by sample)
select b.sample, n_raw, n_blocks, coalesce(n_filtered, 0) as n_filtered, coalesce(n_snp_gap, 0) as n_snp_gap, n_raw - coalesce(n_filtered, 0) as n_removed from b left join a on b.sample = a.sample""")
def run_counters(spark, d):
    """What the chain found and removed."""
    raw = v.raw_calls(spark, d)
    return oc.run_counters(raw, oc.filter_chain(raw))


@query("""select sample, count(*) filter (where code = 'het') as n_het, count(*) filter (where code = 'alt') as n_alt, count(*) filter (where code = 'miss') as n_miss, k - count(distinct locus) filter (where code in ('het', 'alt')) as n_loci_without,
    round(count(*) filter (where code = 'het') / k, 6) as mean_het, round(count(*) filter (where code = 'alt') / k, 6) as mean_alt, round(count(*) filter (where code = 'miss') / k, 6) as mean_miss from calls, (select count(*) as k from loci) group by sample, k""")
def variable_counters(spark, d):
    """Rows of each code, their mean per locus, loci without a variable site."""
    return rounded(counts.variable_counters(v.calls(spark, d), v.loci(spark, d)))


@query(f"{_RAW} select sample, chrom, count(*) as n_records, count(*) filter (where more > 0) as n_indels, count(*) filter (where near) as n_near from masked group by all")
def near_indels(spark, d):
    rows = oc.tag_near_indel(v.raw_calls(spark, d))
    indel = oc.is_indel(F.col("ref"), F.col("alt"))
    return rows.groupBy("sample", "chrom").agg(F.count("*").alias("n_records"), F.count_if(indel).alias("n_indels"), F.count_if("near_indel").alias("n_near"))


@query("""gap as (select unnest([0, 3, 5, 10])::int as gap), sites as (select *, code in ('het', 'alt') as is_variant from calls),
dist as (select a.sample, a.pos, min(abs(a.pos - b.pos)) as indel_dist from sites a left join sites b on a.sample = b.sample and a.chrom = b.chrom and b.is_indel where a.is_variant and not a.is_indel group by all)
select gap, count(*) as n_sites, count(*) filter (where indel_dist <= gap and gap > 0) as n_blanked from dist, gap group by gap""")
def blanked_by_gap(spark, d):
    """Share of variant sites that each gap would blank."""
    rows = v.calls(spark, d).withColumn("is_variant", F.col("code").isin("het", "alt"))
    return sites.blanked_by_gap(rows)


@query("select c.sample, c.pos, l.locus from calls c join loci l on c.chrom = l.chrom and c.pos > l.start and c.pos <= l.\"end\"")
def position_loci(spark, d):
    """Locus of every call by place."""
    return intervals.assign_locus(v.calls(spark, d).select("sample", "chrom", "pos"), v.loci(spark, d)).select("sample", "pos", "locus")


@query("select c.sample, c.pos, l.locus from calls c join loci l on c.chrom = l.chrom and c.pos > l.start and c.pos <= l.\"end\"")
def position_loci_binned(spark, d):
    """The same through bins, as for more intervals than can be broadcast."""
    rows = intervals.assign_locus(v.calls(spark, d).select("sample", "chrom", "pos"), v.loci(spark, d), bin=16, limit=0, hot=50)
    return rows.select("sample", "pos", "locus")


_TARGET = """pairs as (select w.sample, depth, least(w."end", t."end") - greatest(w.start, t.start) as overlap from windows w join targets t on w.start < t."end" and t.start < w."end"),
onb as (select sample, sum(depth * overlap)::bigint as on_target_bp, count(*) as n_overlaps from pairs group by sample),
whole as (select sample, sum(depth * 50)::bigint as total_bp from windows group by sample),
span as (select sum("end" - start)::bigint as span from targets)"""


@query(f"{_TARGET} select w.sample, total_bp, coalesce(on_target_bp, 0) as on_target_bp, coalesce(n_overlaps, 0) as n_overlaps, round(coalesce(100 * on_target_bp / total_bp, 0), 6) as pct_on_target, round(coalesce(on_target_bp / span, 0), 6) as target_mean_dp from whole w cross join span left join onb o on w.sample = o.sample")
def on_target(spark, d):
    return rounded(sites.on_target_stats(v.windows(spark, d), v.targets(spark, d)))


@query(f"{_TARGET} select sample, count(*) as n, sum(overlap)::bigint as bp from pairs group by sample")
def overlaps_binned(spark, d):
    """Window and target overlaps through bins (J2); targets cross bin edges."""
    rows = intervals.overlaps(v.windows(spark, d), v.targets(spark, d), bin=64, limit=0, hot=20)
    return rows.groupBy("sample").agg(F.count("*").alias("n"), F.sum("overlap").alias("bp"))


@query("select sum(case when start < e then 1 else 0 end)::bigint as n_overlapping from (select start, max(\"end\") over (partition by chrom order by start, \"end\" rows between unbounded preceding and 1 preceding) as e from targets)")
def disjoint_targets(spark, d):
    return intervals.n_overlapping(v.targets(spark, d))


@query("select l.locus, count(c.pos) as n_points from loci l left join calls c on c.chrom = l.chrom and c.pos > l.start and c.pos <= l.\"end\" and c.code = 'het' group by l.locus")
def het_overlaps(spark, d):
    points = v.calls(spark, d).filter("code = 'het'").select("chrom", "pos")
    return intervals.count_overlaps(v.loci(spark, d), points)


_RANKED = "ranked as (select *, row_number() over (partition by query order by evalue, bitscore desc, pident desc, subject, o, line, sstart) as k, row_number() over (partition by query, subject order by evalue, bitscore desc, pident desc, o, line, sstart) as k2, count(*) over (partition by query) as n from hits)"


@query("r as (select *, row_number() over (partition by query order by evalue, bitscore desc, pident desc, subject, o, line, sstart) as hit_rank from hits where pident >= 90) select query, subject, pident, evalue, bitscore, hit_rank::int as hit_rank from r where hit_rank <= 5")
def top_hits(spark, d):
    rows = hits.top_n_hits(hits.filter_hits(v.hits(spark, d), pct_id=90), 5, ties=v.HIT_TIES)
    return rows.select("query", "subject", "pident", "evalue", "bitscore", "hit_rank")


@query(f"{_RANKED} select query, subject, pident, evalue, bitscore, k2::int as hit_rank from ranked where k2 <= 2")
def top_hits_per_subject(spark, d):
    rows = hits.top_n_hits(v.hits(spark, d), 2, by=("query", "subject"), ties=v.HIT_TIES[1:])
    return rows.select("query", "subject", "pident", "evalue", "bitscore", "hit_rank")


@query(f"{_RANKED}, dropped as (select *, pident - lead(pident) over (partition by query order by k) as id_drop, qcov - lead(qcov) over (partition by query order by k) as qcov_drop from ranked) select query, subject, n as n_hits, id_drop, qcov_drop from dropped where k = 1")
def hit_drops(spark, d):
    rows = hits.hit_drops(v.hits(spark, d), v.HIT_TIES)
    return hits.best_hit(rows, v.HIT_TIES).select("query", "subject", "n_hits", "id_drop", "qcov_drop")


@query(f"{_RANKED} select count(*) as n_queries, count(*) filter (where pident < 95) as n_low_id, count(*) filter (where qcov < 90) as n_low_qcov, count(*) filter (where n > 1) as n_multi from ranked where k = 1")
def best_hit_counts(spark, d):
    return hits.best_hit_counts(v.hits(spark, d), ties=v.HIT_TIES)


@query("""a as (select *, max(pident) over (partition by query) as mi, max(qcov) over (partition by query) as mc from hits),
r as (select *, row_number() over (partition by query order by evalue, bitscore desc, pident desc, subject, o, line, sstart) as k from a where mi >= 95 and mc >= 90)
select subject as chrom, greatest(least(sstart, send) - 1 - 300, 0) as start, greatest(sstart, send) + 300 as "end", query as locus from r where k = 1""")
def loci_from_hits(spark, d):
    """Loci from alignment hits."""
    best = hits.best_hit(hits.filter_any_hit(v.hits(spark, d)), v.HIT_TIES)
    return intervals.buffered(intervals.hits_to_bed(best), 300)


@query(f"{_RANKED}, best as (select query, subject as s0, sstart as a0, bitscore as b0 from ranked where k = 1) select h.query, round(coalesce(max(case when subject <> s0 or abs(sstart - a0) > 10000 then bitscore end) / any_value(b0), 0), 6) as off_target from hits h join best b on h.query = b.query group by h.query")
def off_target(spark, d):
    return rounded(hits.off_target(v.hits(spark, d), ties=v.HIT_TIES))


_SEQS = """iupac as (select * from (values ('AC', 'M'), ('AG', 'R'), ('AT', 'W'), ('CG', 'S'), ('CT', 'Y'), ('GT', 'K')) t(pair, letter)),
cells as (select s.sample, l.locus, o, case c.code when 'ref' then c.ref when 'alt' then c.alt when 'het' then coalesce(i.letter, 'N') else 'N' end as base
    from samples s cross join loci l join range(1, 201) r(o) on o <= l.len left join calls c on c.sample = s.sample and c.locus = l.locus and c.pos = l.start + o
    left join iupac i on i.pair = least(c.ref, c.alt) || greatest(c.ref, c.alt)),
seqs as (select sample, locus, string_agg(base, '' order by o) as seq from cells group by all),
bases as (select locus, o, base, count(*) as k from cells group by all),
cols as (select locus, o as col, sum(k)::bigint as n, coalesce(sum(k) filter (where base = 'N'), 0)::bigint as n_gap, count(*) filter (where base <> 'N') as n_bases, count(*) filter (where base <> 'N' and k >= 2) as tw from bases group by all)"""


@query(f"{_SEQS} select sample, locus, seq from seqs")
def consensus(spark, d):
    return sequences.consensus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))


@query(f"{_SEQS} select locus, col::int as col, n, n_gap, round(n_gap / n, 6) as gap, n_bases, case when tw >= 2 then 'informative' when n_bases = 1 and tw = 1 then 'constant' when n_bases > 1 then 'singleton' else 'other' end as site_class from cols")
def alignment_columns(spark, d):
    return rounded(sequences.column_stats(sequences.consensus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))))


@query(f"{_SEQS}, trims as (select locus, count(*) as n, min(col) filter (where n_gap / n <= 0.6) as a, max(col) filter (where n_gap / n <= 0.6) as b from cols group by locus), own as (select locus, n, coalesce(a, 1) as a, coalesce(b, n) as b, a is null as trim_failed from trims) select locus, n, a::int as first_kept, b::int as last_kept, trim_failed, b - a + 1 as n_kept, n - (b - a + 1) as n_trimmed, round(100 * (n - (b - a + 1)) / n, 6) as pct_trimmed from own")
def end_trims(spark, d):
    """First and last column kept of each alignment (A17), at a gap share that fits these sparse views."""
    seqs = sequences.consensus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))
    rows = sequences.trim_ranges(sequences.column_stats(seqs), max_gap=0.6)
    return rounded(rows.withColumns({"n_kept": F.col("n_kept").cast("long"), "n_trimmed": F.col("n_trimmed").cast("long")}))


@query(f"{_SEQS} select sample, round(avg(100 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq)), 6) as mean_pct_n, count(*) as n_loci from seqs group by sample")
def sample_missingness(spark, d):
    return rounded(sequences.missingness_per_sample(sequences.consensus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))))


@query(f"""{_SEQS}, p as (select *, 100 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq) as pct from seqs), ks as (select sample from p group by sample having avg(pct) <= 65),
k as (select p.* from p semi join ks on p.sample = ks.sample), kl as (select locus from k group by locus having avg(pct) <= 65 and max(length(seq)) >= 20)
select k.locus, count(*) as n_samples, round(avg(pct), 6) as mean_pct_n from k semi join kl on k.locus = kl.locus group by k.locus""")
def kept_alignments(spark, d):
    """Sample filter, then locus filter on the samples kept."""
    seqs = sequences.consensus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))
    kept = sequences.filter_alignments(seqs, 65, 65, 20)
    return rounded(kept.groupBy("locus").agg(F.count("*").alias("n_samples"), F.avg(sequences.pct_n(F.col("seq"))).alias("mean_pct_n")))


@query(f"{_SEQS} select sample, count(*) as n_loci, sum(length(seq))::bigint as n_bp, round(avg(100 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq)), 6) as mean_pct_n, count(*) filter (where replace(seq, 'N', '') = '') as n_all_n, 0::bigint as n_mismatch from seqs group by sample")
def consensus_summary(spark, d):
    loci = v.loci(spark, d)
    return rounded(sequences.consensus_summary(sequences.consensus(v.calls(spark, d), loci, v.samples(spark, d)), loci))


_SEX = f"""{_COUNTS}, dep as (select sample, sum(mean_dp * n_dp) filter (where locus < 36) / sum(n_dp) filter (where locus < 36 and n_dp > 0) as auto_depth,
    sum(mean_dp * n_dp) filter (where locus >= 36) / sum(n_dp) filter (where locus >= 36 and n_dp > 0) as sex_depth from counts group by sample),
ratios as (select *, case when auto_depth > 0 and sex_depth > 0 then sex_depth / auto_depth end as depth_ratio from dep),
ord as (select *, row_number() over (order by depth_ratio, sample) as i, count(*) over () as n, lead(depth_ratio) over (order by depth_ratio, sample) - depth_ratio as gap from ratios where depth_ratio is not null),
cut as (select i as cut from ord where i between greatest(floor(0.2 * n), 1) and least(floor(0.8 * n), n - 1) order by gap desc, i limit 1),
sexes as (select ord.*, case when i <= cut then 'hetero' else 'homo' end as sex from ord, cut)"""


def _sex_loci(spark, d):
    return sex.sex_loci(v.loci(spark, d), "chrZ")


def _sexes(spark, d):
    own = counts.counts_per_locus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))
    return sex.split_at_gap(sex.depth_ratio(own, _sex_loci(spark, d)))


@query(f"{_SEX} select sample, round(auto_depth, 6) as auto_depth, round(sex_depth, 6) as sex_depth, round(depth_ratio, 6) as depth_ratio, sex from sexes")
def sample_sexes(spark, d):
    """Depth ratio and largest-gap split."""
    return rounded(_sexes(spark, d))


@query(f"""{_SEX}, sizes as (select sex, count(*) as size from sexes group by sex),
ss as (select x.sex, c.locus, c.pos, count(*) filter (where code = 'het') as n_het, count(*) filter (where code <> 'miss') as called from calls c join sexes x on c.sample = x.sample where c.locus >= 36 group by all),
agg as (select ss.sex, locus, count(*) filter (where called > 0 and called >= 0.25 * size) as n_sites, count(*) filter (where called > 0 and called >= 0.25 * size and n_het / called > 0.6) as n_excess, sum(n_het)::bigint as total, any_value(size) as size from ss join sizes on ss.sex = sizes.sex group by all),
w as (select l.locus, coalesce(a.n_sites, 0) as hetero_n_sites, coalesce(a.n_excess, 0) as hetero_n_excess, coalesce(b.n_sites, 0) as homo_n_sites, coalesce(b.n_excess, 0) as homo_n_excess,
    coalesce(a.total / (a.size * l.len), 0) as hetero_het_density, coalesce(b.total / (b.size * l.len), 0) as homo_het_density, l.len as length from loci l left join agg a on a.locus = l.locus and a.sex = 'hetero' left join agg b on b.locus = l.locus and b.sex = 'homo' where l.locus >= 36),
f as (select *, case when homo_het_density > 0 then hetero_het_density / homo_het_density when hetero_het_density > 0 then 999 else 1 end as het_ratio,
    case when hetero_n_sites > 0 then hetero_n_excess / hetero_n_sites else 0 end as hetero_site_frac, case when homo_n_sites > 0 then homo_n_excess / homo_n_sites else 0 end as homo_site_frac from w)
select locus, length, hetero_n_sites, hetero_n_excess, homo_n_sites, homo_n_excess, round(hetero_site_frac, 6) as hetero_site_frac, round(homo_site_frac, 6) as homo_site_frac, round(hetero_het_density, 6) as hetero_het_density, round(homo_het_density, 6) as homo_het_density, round(het_ratio, 6) as het_ratio,
    case when hetero_site_frac > 0.05 and hetero_n_excess >= 3 and homo_site_frac > 0.05 and homo_n_excess >= 3 then 'paralog' when hetero_site_frac > 0.05 and hetero_n_excess >= 3 then 'gametolog' when het_ratio <= 0.6 then 'hemizygous' else 'PAR-like' end as class from f""")
def sex_locus_classes(spark, d):
    """Classes of sex loci."""
    own = v.calls(spark, d).join(_sex_loci(spark, d).select("locus"), "locus", "left_semi")
    return rounded(sex.classify_sex_loci(own, _sex_loci(spark, d), _sexes(spark, d)))


@query(f"""{_SEX}, m as (select sex, median(depth_ratio) as mr, median(auto_depth) as ma from sexes group by sex),
dv as (select s.*, abs(depth_ratio - mr) as dr, abs(auto_depth - ma) as da from sexes s join m on s.sex = m.sex), sp as (select sex, 1.4826 * median(dr) as sr, 1.4826 * median(da) as sa from dv group by sex)
select sample, dv.sex, round(coalesce(case when sr > 0 then dr / sr end, 0), 6) as depth_ratio_z, round(coalesce(case when sa > 0 then da / sa end, 0), 6) as auto_depth_z from dv join sp on dv.sex = sp.sex""")
def robust_z(spark, d):
    rows = sex.robust_z(_sexes(spark, d), ["depth_ratio", "auto_depth"], "sex")
    return rounded(rows.select("sample", "sex", "depth_ratio_z", "auto_depth_z"))


_INFO = """si as (select locus, pos, count(*) filter (where code in ('het', 'alt')) as a, count(*) filter (where code <> 'miss') as called from calls group by all),
sc as (select *, called - a as r from si, size where called > 0 and called >= 0.25 * n),
info as (select l.locus, any_value(l.len) as length, count(sc.pos) as n_scored, count(*) filter (where a > 0 and r > 0) as n_variable, count(*) filter (where a >= 2 and r >= 2) as n_pi, count(*) filter (where a > 0 and r > 0 and least(a, r) = 1) as n_singleton from loci l left join sc on l.locus = sc.locus group by l.locus)"""


@query(f"{_INFO} select locus, length, n_scored, n_variable, n_pi, n_singleton, round(case when n_scored > 0 then n_variable / n_scored end, 6) as prop_variable, round(case when n_scored > 0 then n_pi / n_scored end, 6) as prop_pi, round(case when n_scored > 0 then n_singleton / n_scored end, 6) as prop_singleton from info")
def informativeness(spark, d):
    return rounded(sites.locus_informativeness(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d)))


@query(f"{_INFO} select count(*) as n_loci, sum(n_scored)::bigint as n_scored, sum(n_variable)::bigint as n_variable, sum(n_pi)::bigint as n_pi, sum(n_singleton)::bigint as n_singleton, count(*) filter (where n_variable = 0) as n_without, round(100 * sum(n_variable) / sum(n_scored), 6) as pct_variable, round(100 * sum(n_pi) / sum(n_scored), 6) as pct_pi, round(100 * sum(n_singleton) / sum(n_scored), 6) as pct_singleton from info")
def informativeness_totals(spark, d):
    return rounded(sites.informativeness_totals(sites.locus_informativeness(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d))))


@query(f"{_INFO} select locus, (row_number() over (order by n_pi desc, locus))::int as rank, round(sum(n_pi) over (order by n_pi desc, locus rows unbounded preceding) / sum(n_pi) over (), 6) as share from info")
def cumulative_informativeness(spark, d):
    return rounded(sites.cumulative_share(sites.locus_informativeness(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d))))


_VAR = """vc as (select *, is_indel as indel, case when is_indel then ref || 'A' else ref end as ref2 from calls),
ac as (select chrom, pos, ref2 as ref, alt, sum(case code when 'het' then 1 when 'alt' then 2 else 0 end)::bigint as ac, 2 * count(*) as an from vc where code <> 'miss' group by all),
car as (select c.sample, count(*) as k from vc c semi join (select * from ac where ac = 1) s on c.chrom = s.chrom and c.pos = s.pos and c.ref2 = s.ref and c.alt = s.alt where c.code = 'het' group by c.sample),
vs as (select s.sample, count(*) filter (where code = 'ref') as n_ref, count(*) filter (where code = 'het') as n_het, count(*) filter (where code = 'alt') as n_alt, count(*) filter (where code = 'miss') as n_miss,
    count(*) filter (where code in ('het', 'alt') and not indel and least(ref, alt) || greatest(ref, alt) in ('AG', 'CT')) as n_ts, count(*) filter (where code in ('het', 'alt') and not indel and least(ref, alt) || greatest(ref, alt) not in ('AG', 'CT')) as n_tv,
    count(*) filter (where code in ('het', 'alt') and indel) as n_indels, avg(dp) filter (where code <> 'miss') as mean_dp from samples s left join vc c on s.sample = c.sample group by s.sample),
stats9 as (select vs.*, coalesce(k, 0) as n_singletons, case when n_tv > 0 then n_ts / n_tv end as ts_tv from vs left join car on vs.sample = car.sample)"""


@query(f"{_VAR} select sample, n_ref, n_het, n_alt, n_miss, n_ts, n_tv, n_indels, round(mean_dp, 6) as mean_dp, n_singletons, round(ts_tv, 6) as ts_tv from stats9")
def variant_stats(spark, d):
    return rounded(sites.sample_variant_stats(_with_indels(v.calls(spark, d)), v.samples(spark, d)))


def _with_indels(calls):
    """Deletions with their base in ref."""
    return calls.withColumn("ref", F.when(F.col("is_indel"), F.concat("ref", F.lit("A"))).otherwise(F.col("ref")))


@query("calls0 as (select c.* from calls c semi join (select * from loci where len > 20 and locus < 30) l on c.locus = l.locus), " + _VAR.replace("from calls)", "from calls0)") + " select sample, n_het, n_ts, n_tv, n_indels, n_singletons from stats9")
def variant_stats_in_bed(spark, d):
    """The same within some intervals only."""
    bed = v.loci(spark, d).filter("end - start > 20 and locus < 30")
    rows = sites.sample_variant_stats(_with_indels(v.calls(spark, d)), v.samples(spark, d), bed)
    return rows.select("sample", "n_het", "n_ts", "n_tv", "n_indels", "n_singletons")


@query(f"{_VAR} select chrom, pos, ref, alt, ac, an from ac")
def allele_counts(spark, d):
    return sites.allele_counts(_with_indels(v.calls(spark, d)))


@query("""pr as (select chrom, start + 5 as s, "end" - 5 as e, locus from loci), near as (select c.*, least(c.pos - p.s, p.e - c.pos + 1) as dist, p.e - p.s as len from calls c join pr p on c.chrom = p.chrom and c.pos > p.s - 300 and c.pos <= p.e + 300)
select case when len < 600 then 'short' else 'long' end as class, (case when dist > 0 then floor((dist - 1) / 5) * 5 else -floor(-dist / 5) * 5 - 5 end)::int as bin, count(*) as n_pos, count(*) filter (where code <> 'miss') as n_called, round(avg(dp) filter (where code <> 'miss'), 6) as mean_dp, round(count(*) filter (where code <> 'miss') / count(*), 6) as call_frac from near group by all""")
def depth_profile(spark, d):
    """Depth by distance to the probe edge (A11); probes are the inner 20 bases of a locus."""
    probes = v.loci(spark, d).withColumns({"start": F.col("start") + 5, "end": F.col("end") - 5})
    return rounded(sites.depth_profile(v.calls(spark, d), probes, bin=5))


@query(f"{_COUNTS} select sample, count(*) filter (where n_het + n_alt + n_ref > 0) as n_loci_called, round(avg(100 * (1 - (n_het + n_alt + n_ref) / (n_het + n_alt + n_ref + n_miss))), 6) as mean_pct_n, round(100 * sum(n_het) / nullif(sum(n_het + n_alt + n_ref), 0), 6) as pct_het, round(sum(mean_dp * n_dp) / nullif(sum(n_dp), 0), 6) as mean_dp from counts group by sample")
def sample_qc(spark, d):
    return rounded(qc_tables.sample_from_counts(counts.counts_per_locus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))))


@query(f"{_COUNTS} select locus, count(*) as n_samples, count(*) filter (where n_het + n_alt + n_ref > 0) as n_samples_called, round(avg(mean_dp), 6) as mean_dp, round(min(mean_dp), 6) as min_dp, round(avg((n_het + n_alt + n_ref) / (n_het + n_alt + n_ref + n_miss)), 6) as mean_call_frac, round(stddev_samp((n_het + n_alt + n_ref) / (n_het + n_alt + n_ref + n_miss)), 6) as sd_call_frac, round(min((n_het + n_alt + n_ref) / (n_het + n_alt + n_ref + n_miss)), 6) as min_call_frac, round(avg(n_het), 6) as mean_n_het from counts group by locus")
def locus_qc(spark, d):
    return rounded(qc_tables.locus_from_counts(counts.counts_per_locus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))))


@query(f"""{_COUNTS}, long as (select sample, locus, n_het + n_alt + n_ref as called, n_het + n_alt + n_ref + n_miss as len, unnest(['n_het', 'n_alt', 'n_diff', 'n_miss']) as metric, unnest([n_het::double, n_alt, n_alt + n_het / 2, n_miss]) as value from counts)
select sample, locus, metric, value, round(case when metric = 'n_miss' then 100 * value / len when called > 0 then 100 * value / called end, 6) as pct from long""")
def qc_long(spark, d):
    return rounded(qc_tables.counts_long(counts.counts_per_locus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))))


def _sample_metrics(spark, d):
    return sites.sample_variant_stats(_with_indels(v.calls(spark, d)), v.samples(spark, d)).join(v.meta(spark, d), "sample")


_METRICS = f"{_VAR}, me as (select s.*, m.seq_batch, m.species, m.contam, m.land_type from stats9 s join meta m on s.sample = m.sample)"


@query(f"""{_METRICS}, q as (select seq_batch, quantile_cont(mean_dp, 0.05) as a, quantile_cont(ts_tv, 0.05) as b, quantile_cont(n_singletons, 0.95) as c from me group by seq_batch),
fl as (select me.*, coalesce(mean_dp < a, false) as f1, coalesce(ts_tv < b, false) as f2, coalesce(n_singletons > c, false) as f3 from me join q on me.seq_batch = q.seq_batch)
select sample, seq_batch, f1 as flag_mean_dp, f2 as flag_ts_tv, f3 as flag_n_singletons, f1::int + f2::int + f3::int as n_flags, concat_ws(', ', case when f1 then 'mean_dp' end, case when f2 then 'ts_tv' end, case when f3 then 'n_singletons' end) as failed from fl""")
def watch_flags(spark, d):
    """Within-batch quantile flags and the names of failed checks."""
    checks = {"mean_dp": "low", "ts_tv": "low", "n_singletons": "high"}
    rows = qc_tables.failed_checks(qc_tables.watch_flags(_sample_metrics(spark, d), "seq_batch", checks), list(checks))
    return rows.select("sample", "seq_batch", *[f"flag_{c}" for c in checks], "n_flags", "failed")


@query(f"{_METRICS} select sample, seq_batch, (rank() over (partition by seq_batch order by n_het)) + (count(*) over (partition by seq_batch, n_het) - 1) / 2 as het_rank from me")
def batch_ranks(spark, d):
    rows = qc_tables.average_rank(_sample_metrics(spark, d), "n_het", "seq_batch", "het_rank")
    return rows.select("sample", "seq_batch", "het_rank")


@query(f"{_METRICS} select seq_batch, count(*) as n, round(avg(mean_dp), 6) as mean_mean_dp, round(avg(ts_tv), 6) as mean_ts_tv, round(median(n_het), 6) as median_n_het from me group by seq_batch")
def batch_summary(spark, d):
    return rounded(qc_tables.group_summary(_sample_metrics(spark, d), "seq_batch", ["mean_dp", "ts_tv"], ["n_het"]))


@query(f"{_METRICS} select 'mean_dp' as metric, round(min(mean_dp), 6) as min, round(median(mean_dp), 6) as median, round(max(mean_dp), 6) as max from me union all select 'n_het', min(n_het), median(n_het), max(n_het) from me union all select 'ts_tv', round(min(ts_tv), 6), round(median(ts_tv), 6), round(max(ts_tv), 6) from me")
def metric_ranges(spark, d):
    return rounded(qc_tables.metric_ranges(_sample_metrics(spark, d), ["mean_dp", "n_het", "ts_tv"]))


@query(f"{_METRICS} select round(corr(n_het, n_miss), 6) as r_n_het_n_miss, round(corr(mean_dp, n_miss), 6) as r_mean_dp_n_miss from me")
def metric_correlations(spark, d):
    return rounded(qc_tables.corr_pairs(_sample_metrics(spark, d), [("n_het", "n_miss"), ("mean_dp", "n_miss")]))


@query("select species, count(*) filter (where seq_batch = 0) as \"0\", count(*) filter (where seq_batch = 1) as \"1\" from meta group by species")
def species_by_batch(spark, d):
    return qc_tables.crosstab(v.meta(spark, d), "species", "seq_batch", [0, 1])


@query("g as (select species, count(distinct sample) as k from meta group by species) select m.sample, g.k as n_items, m.species || ' (' || g.k || ')' as label from meta m join g on m.species = g.species")
def group_labels(spark, d):
    return qc_tables.group_sizes(v.meta(spark, d), ["species"], "sample").select("sample", "n_items", "label")


@query("select contam, seq_batch = 1 as second_batch, count(*) as n from meta group by all")
def contam_by_batch(spark, d):
    return qc_tables.contingency(v.meta(spark, d).withColumn("second_batch", F.col("seq_batch") == 1), "contam", "second_batch")


@query(f"{_METRICS} select count(*) as n, round(avg(ts_tv), 6) as mean, round(min(ts_tv), 6) as least, round(max(ts_tv), 6) as greatest, arg_min(sample, (ts_tv, sample)) as least_key, arg_min(sample, (-ts_tv, sample)) as greatest_key, count(*) filter (where ts_tv = 0) as n_zero from me")
def ts_tv_line(spark, d):
    return rounded(qc_tables.summary_line(_sample_metrics(spark, d), "ts_tv", "sample"))


@query(f"{_METRICS} select sample, round(ts_tv, 6) as ts_tv from me order by me.ts_tv nulls first, sample limit 10")
def lowest_ts_tv(spark, d):
    """The ten samples with the lowest ratio (K3)."""
    return rounded(qc_tables.lowest(_sample_metrics(spark, d).select("sample", "ts_tv"), "ts_tv", "sample"))


@query(f"""{_AB}, {_SITES}, {_SEX.split("ord as")[0].rstrip().rstrip(",")}, fl as (select s.locus, site_frac > 0.05 and n_excess >= 3 as ex, coalesce(n_ab_samples >= 5 and n_skewed / n_ab_samples > 0.5, false) as sk from locus_stats s left join skew k on s.locus = k.locus)
select case when not ex and not sk then 'retained' when ex then 'excess het' else 'allele balance' end as stage, count(*) as n from fl group by all""")
def locus_stages(spark, d):
    """Loci by the stage at which they go."""
    stats = cohort.excess_het_loci(v.calls(spark, d), v.loci(spark, d), sample_count(spark, d))
    rows = cohort.attach_ab(stats, cohort.ab_skew(_balanced(spark, d), min_hets=2))
    excess = (F.col("site_frac") > 0.05) & (F.col("n_excess") >= 3)
    skewed = (F.col("n_ab_samples") >= 5) & (F.col("skew_frac") > 0.5)
    rows = rows.select("locus", "length", (~excess & ~skewed).alias("retained"), excess.alias("excess_het"), skewed.alias("ab_skew"), F.lit(None).cast("string").alias("z_class"), F.lit(True).alias("kept_missing"))
    return qc_tables.count_by(qc_tables.stage_locus(rows), "stage")


_NUMBERS = "num as (select sample, (row_number() over (order by sample) - 1)::int as k from samples)"


def _listed(merged):
    """Merged sites as text: number:code of each called sample."""
    text = F.zip_with("carriers", "codes", lambda k, c: F.concat(k.cast("string"), F.lit(":"), F.get(F.array(*map(F.lit, sites.CODES)), c.cast("int"))))
    return merged.select("chrom", "pos", "ref", F.size("carriers").cast("long").alias("n_samples"), F.array_join(text, ",").alias("genotypes"))


@query(f"{_NUMBERS} select chrom, pos, ref, count(*) filter (where code <> 'miss') as n_samples, coalesce(string_agg(k || ':' || code, ',' order by k) filter (where code <> 'miss'), '') as genotypes from calls join num on calls.sample = num.sample group by all")
def merged_sites(spark, d):
    """Sites of all samples with the numbers and codes of those called there."""
    return _listed(sites.merge_samples(v.calls(spark, d), sites.numbered(v.samples(spark, d))))


_ONE_EACH = """one as (select sample, chrom, pos, ref, max(case when h1 is null then -1 when h1 <> h2 then 1 when h1 <> '' then 2 else 0 end) as c from balanced group by all),
listed as (select chrom, pos, ref, count(*) filter (where c >= 0) as n_samples, coalesce(string_agg(k || ':' || (['ref', 'het', 'alt'])[c + 1], ',' order by k) filter (where c >= 0), '') as genotypes from one join num on one.sample = num.sample group by all)"""


@query(f"{_RAW}, {_NUMBERS}, {_ONE_EACH} select * from listed")
def merged_repeats(spark, d):
    """Sites of records that repeat, as the chain leaves them before repeats are dropped, merged in two lots of samples."""
    raw = v.raw_calls(spark, d)
    steps = oc.mask_low_qual(oc.mask_low_gt(oc.split_blocks(raw)))
    steps = oc.mask_allele_balance(oc.drop_indels(oc.atomize(oc.split_multiallelic(oc.mask_snp_gap(steps)))))
    calls, numbers = oc.with_code(steps), sites.numbered(v.samples(spark, d))
    lots = [sites.merge_samples(calls.filter(F.col("sample") % 2 == k), numbers) for k in (0, 1)]
    return _listed(sites.join_sites(*lots))
