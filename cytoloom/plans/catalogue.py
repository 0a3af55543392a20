"""Every query of the engine's own operators, and the SQL that should give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem, mapq, numeric
from ..operators import alignment, combine, evaluate, evidence, intervals, methylation
from . import virtual as v

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


MIN4 = methylation.MethylationOptions(min_depth=4)

# --- methylation calling -------------------------------------------------------------------------

COUNTS_SQL = (
    v.OBS_SQL
    + """, ranked as (
  select *, row_number() over (partition by fragment_id, contig, position order by
      (mapping_quality <> 255 and mapping_quality >= 20 and (query_base is null or coalesce(base_quality >= 20, false))) desc,
      coalesce(query_base in ('A', 'C', 'G', 'T'), false) desc, (query_base is not null) desc, (base_quality is not null) desc,
      case when mapping_quality = 255 then null when base_quality is null then least(0.75, power(10.0::double, -least(mapping_quality, 60) / 10.0::double))
        else least(0.75, 1.0::double - (1.0::double - power(10.0::double, -least(base_quality, 60) / 10.0::double)) * (1.0::double - power(10.0::double, -least(mapping_quality, 60) / 10.0::double))) end asc nulls last,
      segment asc, coalesce(query_base, ''), coalesce(base_quality, -1), mapping_quality) as n
  from obs
), one as (
  select * from ranked where n = 1
), counted as (
  select contig, position, strand, context, second,
    cast(sum(case when query_base = reference_base then 1 else 0 end) as bigint) as methylated,
    cast(sum(case when (strand = 'T' and query_base = 'T') or (strand = 'B' and query_base = 'A') then 1 else 0 end) as bigint) as unmethylated,
    cast(sum(case when query_base is null then 1 else 0 end) as bigint) as deleted,
    cast(sum(case when query_base is not null and query_base <> reference_base and not ((strand = 'T' and query_base = 'T') or (strand = 'B' and query_base = 'A')) then 1 else 0 end) as bigint) as different
  from one
  where ((reference_base = 'C' and strand = 'T') or (reference_base = 'G' and strand = 'B'))
    and mapping_quality <> 255 and mapping_quality >= 20 and (query_base is null or base_quality >= 20)
  group by contig, position, strand, context, second
)"""
)


def _collapsed(spark, d) -> DataFrame:
    """Overlaps collapsed; the virtual fragments may repeat a segment at a position, so equal rows of the
    preference are told apart by their values, as in the SQL."""
    obs = v.observations(spark, d)
    base, bq = F.coalesce("query_base", F.lit("")), F.coalesce("base_quality", F.lit(-1))
    return evidence.collapse_overlaps(obs, extra_order=(base, bq, F.col("mapping_quality")))


@query(f"with {COUNTS_SQL} select fragment_id, segment, contig, position, query_base, base_quality, mapping_quality from one")
def overlap_collapse(spark, d):
    return _collapsed(spark, d).select("fragment_id", "segment", "contig", "position", "query_base", "base_quality", "mapping_quality")


@query(f"""with {v.OBS_SQL} select contig, position, cast(round(avg(least(0.75, 1.0::double - (1.0::double - power(10.0::double, -least(base_quality, 60) / 10.0::double)) * (1.0::double - power(10.0::double, -least(mapping_quality, 60) / 10.0::double)))) * 1000000) as bigint) as error_ppm
from obs where base_quality is not null and mapping_quality <> 255 group by contig, position""")
def observation_errors(spark, d):
    rows = v.observations(spark, d).where("base_quality is not null and mapping_quality != 255")
    return rows.groupBy("contig", "position").agg(F.round(F.avg(numeric.observation_error(F.col("base_quality"), F.col("mapping_quality"))) * 1_000_000).cast("bigint").alias("error_ppm"))


CALLED = "methylated + unmethylated >= 4 and context is not null"
LEVEL = "case when methylated + unmethylated = 0 then 'na' else cast(((methylated * 1000000 + (methylated + unmethylated) // 2) // (methylated + unmethylated)) // 1000000 as varchar) || '.' || lpad(cast(((methylated * 1000000 + (methylated + unmethylated) // 2) // (methylated + unmethylated)) % 1000000 as varchar), 6, '0') end"
CGMAP_SELECT = f"""select contig, case when strand = 'T' then 'C' else 'G' end as nucleotide, position + 1 as pos1, context, 'C' || second as dinucleotide, {LEVEL} as level, methylated as meth, methylated + unmethylated as total from counted where {CALLED}"""


@query(f"with {COUNTS_SQL} {CGMAP_SELECT}")
def call_meth_cgmap(spark, d):
    sites = methylation.site_counts(_collapsed(spark, d), MIN4)
    return methylation.cgmap_columns(methylation.called_sites(sites, MIN4))


@query(f"with {COUNTS_SQL} {CGMAP_SELECT} and context = 'CG'")
def call_meth_cg_only(spark, d):
    options = methylation.MethylationOptions(min_depth=4, cg_only=True)
    return methylation.cgmap_columns(methylation.called_sites(methylation.site_counts(_collapsed(spark, d), options), options))


@query(f"""with {COUNTS_SQL}, t as (select *, methylated + unmethylated as n from counted where {CALLED})
select contig, position as start, position + 1 as "end", 'm,' || context || ',0' as modification, n as score, case when strand = 'T' then '+' else '-' end as strand, position as thick_start, position + 1 as thick_end, '255,0,0' as color, n as coverage,
 cast(((methylated * 10000 + n // 2) // n) // 100 as varchar) || '.' || lpad(cast(((methylated * 10000 + n // 2) // n) % 100 as varchar), 2, '0') as percent,
 methylated as meth, unmethylated as unmeth, cast(0 as bigint) as other_mod, deleted, cast(0 as bigint) as failed, different, cast(0 as bigint) as no_call from t""")
def call_meth_bed(spark, d):
    return methylation.bedmethyl_columns(methylation.called_sites(methylation.site_counts(_collapsed(spark, d), MIN4), MIN4))


@query(f"with {COUNTS_SQL} select cast(count(*) as bigint) as sites, cast(coalesce(sum(methylated + unmethylated), 0) as bigint) as observations from counted where context is null and methylated + unmethylated >= 1")
def meth_unresolved_summary(spark, d):
    one = methylation.MethylationOptions(min_depth=1)
    return methylation.unresolved(methylation.site_counts(_collapsed(spark, d), one), one)


@query(f"with {v.CTX_SQL} select contig, position, base, context, second from ctx where context is not null")
def cytosine_context(spark, d):
    return methylation.with_context(v.reference(spark, d)).where("context is not null").select("contig", "position", "base", "context", "second")


@query(f"with {v.OBS_SQL} select contig, count(*) as n, cast(sum(case when (reference_base = 'C' and query_base = 'T' and strand = 'T') or (reference_base = 'G' and query_base = 'A' and strand = 'B') then 1 else 0 end) as bigint) as confounded from obs group by contig")
def confounded_observations(spark, d):
    f = chem.confounded(F.col("reference_base"), F.col("query_base"), F.col("strand"))
    return v.observations(spark, d).groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.when(f, 1).otherwise(0)).cast("bigint").alias("confounded"))


@query(f"""with {v.OBS_SQL}, r as (select case when reference_base not in ('A','C','G','T') or query_base not in ('A','C','G','T') then 'unknown' when reference_base = query_base then 'literal'
 when (strand = 'T' and reference_base = 'C' and query_base = 'T') or (strand = 'B' and reference_base = 'G' and query_base = 'A') then 'compatible' else 'mismatch' end as relation, strand from obs where query_base is not null)
select strand, relation, count(*) as n, cast(sum(case when relation in ('literal', 'compatible') then 0 else 1 end) as bigint) as cost from r group by strand, relation""")
def base_relation_cost(spark, d):
    obs = v.observations(spark, d).where("query_base is not null")
    args = (F.col("reference_base"), F.col("query_base"), F.col("strand"))
    rows = obs.select("strand", chem.base_relation(*args).alias("relation"), chem.base_cost(*args).alias("cost"))
    return rows.groupBy("strand", "relation").agg(F.count("*").alias("n"), F.sum("cost").cast("bigint").alias("cost"))


@query("select * from (values ('OT','forward','T','C>T','CT','CT'), ('OB','reverse','B','G>A','GA','CT'), ('CTOT','reverse','T','C>T','CT','GA'), ('CTOB','forward','B','G>A','GA','GA')) t(strand, orientation, cytosine_strand, conversion, xg, xr)")
def strand_table(spark, d):
    return chem.strand_table(spark)


# --- sequences -----------------------------------------------------------------------------------


@query(f"with {v.READS_SQL} select read_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) as rc from reads")
def reverse_complement(spark, d):
    return v.reads(spark, d).select("read_id", chem.reverse_complement(F.col("seq")).alias("rc"))


@query(f"with {v.READS_SQL} select read_id, replace(seq, 'C', 'T') as ct, replace(seq, 'G', 'A') as ga from reads")
def three_letter(spark, d):
    return v.reads(spark, d).select("read_id", chem.converted(F.col("seq"), "C>T").alias("ct"), chem.converted(F.col("seq"), "G>A").alias("ga"))


@query("""with p as (select p_partkey, upper(p_name) as s from part)
select p_partkey, case when regexp_full_match(s, '[ACGTN]*') then 0 else length(regexp_extract(s, '^([ACGTN]*)', 1)) + 1 end as first_bad from p""")
def normalize_check(spark, d):
    return v.table(spark, d, "part").select("p_partkey", chem.first_bad_base(F.col("p_name")).cast("bigint").alias("first_bad"))


@query(f"with {v.READS_SQL} select read_id, md5(seq) as m5, cast(length(seq) as bigint) as n from reads")
def sequence_digests(spark, d):
    return v.reads(spark, d).select("read_id", F.md5(F.col("seq").cast("binary")).alias("m5"), F.length("seq").cast("bigint").alias("n"))


# --- variants: counts and candidates ---------------------------------------------------------------

SNP_SQL = (
    v.OBS_SQL
    + """, ranked as (
  select *, row_number() over (partition by fragment_id, contig, position order by
      (mapping_quality <> 255 and mapping_quality >= 20 and query_base is not null and coalesce(base_quality >= 20, false)) desc,
      coalesce(query_base in ('A', 'C', 'G', 'T'), false) desc, (query_base is not null) desc, (base_quality is not null) desc,
      case when mapping_quality = 255 then null when base_quality is null then least(0.75, power(10.0::double, -least(mapping_quality, 60) / 10.0::double))
        else least(0.75, 1.0::double - (1.0::double - power(10.0::double, -least(base_quality, 60) / 10.0::double)) * (1.0::double - power(10.0::double, -least(mapping_quality, 60) / 10.0::double))) end asc nulls last,
      segment asc, coalesce(query_base, ''), coalesce(base_quality, -1), mapping_quality) as n
  from obs
), snv as (
  select * from ranked where n = 1 and query_base in ('A', 'C', 'G', 'T') and base_quality >= 20 and mapping_quality <> 255 and mapping_quality >= 20
), cand as (
  select contig, position, reference_base,
    cast(count(*) filter (query_base = reference_base) as bigint) as ref_count,
    cast(count(*) filter (query_base = 'A' and reference_base <> 'A') as bigint) as alt_a, cast(count(*) filter (query_base = 'C' and reference_base <> 'C') as bigint) as alt_c,
    cast(count(*) filter (query_base = 'G' and reference_base <> 'G') as bigint) as alt_g, cast(count(*) filter (query_base = 'T' and reference_base <> 'T') as bigint) as alt_t
  from snv where not ((reference_base = 'C' and query_base = 'T' and strand = 'T') or (reference_base = 'G' and query_base = 'A' and strand = 'B'))
  group by contig, position, reference_base
), chosen as (
  select * from (select *, ref_count + alt_a + alt_c + alt_g + alt_t as depth, greatest(alt_a, alt_c, alt_g, alt_t) as max_alt from cand)
  where depth >= 6 and max_alt >= 2 and max_alt * 1000000000 >= depth * 100000000
)"""
)


def _snp_options():
    from ..operators import snp

    return snp.SnpOptions(min_depth=6)


def _snp_observations(spark, d) -> DataFrame:
    from ..operators import snp

    base, bq = F.coalesce("query_base", F.lit("")), F.coalesce("base_quality", F.lit(-1))
    one = evidence.collapse_overlaps(v.observations(spark, d), deletions=False, extra_order=(base, bq, F.col("mapping_quality")))
    return snp.usable(one, _snp_options())


@query(f"with {SNP_SQL} select * from chosen")
def snp_candidates(spark, d):
    from ..operators import snp

    return snp.candidates(_snp_observations(spark, d), _snp_options())


_BS8 = ", ".join(f"cast(count(*) filter (s.strand = '{s}' and s.query_base = '{b}') as bigint) as {n}_{b.lower()}" for s, n in (("T", "top"), ("B", "bottom")) for b in "ACGT")


@query(f"with {SNP_SQL} select s.contig, s.position, s.reference_base, cast(count(*) as bigint) as depth, {_BS8} from snv s join chosen c on s.contig = c.contig and s.position = c.position group by s.contig, s.position, s.reference_base")
def snp_strand_counts_bs8(spark, d):
    from ..operators import snp

    obs, options = _snp_observations(spark, d), _snp_options()
    return snp.strand_counts(obs, snp.candidates(obs, options))


@query(f"""with {SNP_SQL}, g as (select s.contig, s.position, s.reference_base, {_BS8} from snv s join chosen c on s.contig = c.contig and s.position = c.position group by s.contig, s.position, s.reference_base),
a as (select g.*, b.allele from g, (values ('A'), ('C'), ('G'), ('T')) b(allele))
select contig, position, allele, cast(case allele when 'A' then top_a + bottom_a when 'C' then top_c + bottom_c when 'G' then top_g + bottom_g else top_t + bottom_t end as bigint) as ad,
  cast(case allele when 'A' then top_a + case when top_g + bottom_g > 0 then 0 else bottom_a end when 'C' then top_c + bottom_c when 'G' then top_g + bottom_g
    else bottom_t + case when top_c + bottom_c > 0 then 0 else top_t end end as bigint) as iad from a""")
def snp_ad_iad(spark, d):
    from ..operators import snp

    obs, options = _snp_observations(spark, d), _snp_options()
    return snp.allele_depths(snp.strand_counts(obs, snp.candidates(obs, options)))


_E = "least(0.75, 1.0::double - (1.0::double - power(10.0::double, -least(base_quality, 60) / 10.0::double)) * (1.0::double - power(10.0::double, -least(mapping_quality, 60) / 10.0::double)))"


@query(f"""with {SNP_SQL}, l as (select s.contig, s.position, t.g, sum(case when (contains(t.g, 'C') and s.strand = 'T') or (contains(t.g, 'G') and s.strand = 'B') then 0 else ln((case when s.query_base = substr(t.g, 1, 1) then 1 - {_E} else {_E} / 3 end + case when s.query_base = substr(t.g, 2, 1) then 1 - {_E} else {_E} / 3 end) / 2) end) as ll
 from snv s join chosen c on s.contig = c.contig and s.position = c.position, (values ('AA'), ('AC'), ('AG'), ('AT'), ('CC'), ('CG'), ('CT'), ('GG'), ('GT'), ('TT')) t(g) group by s.contig, s.position, t.g)
select contig, position, g as genotype, cast(round(ll * 1000) as bigint) as milli_nats from l""")
def snp_const_loglik(spark, d):
    from ..operators import snp

    obs = _snp_observations(spark, d)
    out = snp.constant_log_likelihoods(obs, snp.candidates(obs, _snp_options()))
    return out.select("contig", "position", "genotype", F.round(F.col("log_likelihood") * 1000).cast("bigint").alias("milli_nats"))


@query("""with b(r) as (values ('A'), ('C'), ('G'), ('T')), g(x) as (values ('AA'), ('AC'), ('AG'), ('AT'), ('CC'), ('CG'), ('CT'), ('GG'), ('GT'), ('TT')), f as (select sqrt(1 - 0.001::double) as k)
select r as reference_base, x as genotype, cast(round(ln((case when substr(x, 1, 1) = r then k else (1 - k) / 3 end) * (case when substr(x, 2, 1) = r then k else (1 - k) / 3 end) * case when substr(x, 1, 1) = substr(x, 2, 1) then 1 else 2 end) * 1000000) as bigint) as micro_nats from b, g, f""")
def snp_priors(spark, d):
    from ..operators import snp

    return snp.priors(spark, 0.001).select("reference_base", "genotype", F.round(F.col("log_prior") * 1_000_000).cast("bigint").alias("micro_nats"))


@query()
def snp_calls_full(spark, d):
    from ..operators import snp

    return snp.vcf_rows(snp.call(_snp_observations(spark, d), _snp_options()))


@query()
def joint_calls(spark, d):
    """Both callers over one collapsed table of observations."""
    from ..operators import joint

    base, bq = F.coalesce("query_base", F.lit("")), F.coalesce("base_quality", F.lit(-1))
    both = joint.call(v.observations(spark, d), MIN4, _snp_options(), extra_order=(base, bq, F.col("mapping_quality")))
    meth = methylation.cgmap_columns(both.sites).select(F.lit("meth").alias("kind"), "contig", "pos1", F.to_json(F.struct("nucleotide", "context", "level", "meth", "total")).alias("row"))
    from ..operators import snp

    return meth.unionByName(snp.vcf_rows(both.variants).select(F.lit("snp").alias("kind"), "contig", F.col("pos").alias("pos1"), F.to_json(F.struct("ref", "alt", "qual", "filter", "info", "sample")).alias("row")))


# --- intervals -------------------------------------------------------------------------------------

MERGE_SQL = """, reach as (
  select *, max("end") over (partition by contig order by start, "end" rows between unbounded preceding and 1 preceding) as m from (select distinct * from intervals)
), isl as (
  select *, sum(case when m is null or start > m + {gap} then 1 else 0 end) over (partition by contig order by start, "end" rows between unbounded preceding and current row) as k from reach
), merged as (select contig, min(start) as start, max("end") as "end" from isl group by contig, k)"""


@query(f'with {v.INTERVALS_SQL}{MERGE_SQL.format(gap=0)} select contig, start, "end" from merged')
def interval_merge(spark, d):
    return intervals.merged(v.intervals(spark, d))


@query(f'with {v.INTERVALS_SQL}{MERGE_SQL.format(gap=1)} select contig, start, "end" from merged')
def interval_merge_adjacent(spark, d):
    return intervals.merged(v.intervals(spark, d), gap=1)


@query(f"""with {v.INTERVALS_SQL}{MERGE_SQL.format(gap=0)}, u as (select contig, start, "end", unnest(range(start, "end", 64)) as s from merged)
select contig, s as start, least(s + 64, "end") as "end" from u""")
def region_chunks(spark, d):
    return intervals.chunked(intervals.merged(v.intervals(spark, d)), 64).select("contig", "start", "end")


@query(f"""with {v.INTERVALS_SQL}{MERGE_SQL.format(gap=0)}, {v.REF_SQL} select r.contig, r.position, r.base from ref r where exists (select 1 from merged m where m.contig = r.contig and m.start <= r.position and r.position < m."end")""")
def region_clip(spark, d):
    return intervals.clip(v.reference(spark, d).select("contig", "position", "base"), intervals.merged(v.intervals(spark, d)), bin_size=256)


@query(f"""with {v.INTERVALS_SQL} select contig, start, "end" from intervals where start >= "end" or "end" > 4000""")
def region_validate(spark, d):
    names = v.intervals(spark, d).select("contig").distinct().withColumn("length", F.lit(4000))
    return intervals.invalid(v.intervals(spark, d), names).select("contig", "start", "end")


@query("""with recursive r as (select o_custkey % 97 as read, o_orderkey % 500 as v from orders group by 1, 2), o as (select *, row_number() over (partition by read order by v) as n from r),
w as (select read, v, n, v as anchor, 0 as cluster from o where n = 1 union all select o.read, o.v, o.n, case when o.v - w.anchor > 12 then o.v else w.anchor end, case when o.v - w.anchor > 12 then w.cluster + 1 else w.cluster end from w join o on o.read = w.read and o.n = w.n + 1)
select read, v, cluster from w""")
def locus_clusters(spark, d):
    rows = v.table(spark, d, "orders").selectExpr("o_custkey % 97 as read", "o_orderkey % 500 as v")
    return intervals.anchored_clusters(rows, ["read"], "v", 12)


# --- cohort matrices ---------------------------------------------------------------------------------

_LEVEL6 = "case when {t} is null then null else cast(((({m}) * 1000000 + ({t}) // 2) // ({t})) // 1000000 as varchar) || '.' || lpad(cast(((({m}) * 1000000 + ({t}) // 2) // ({t})) % 1000000 as varchar), 6, '0') end"


def _matrix_sql(kind: str, least: int, required: int, cg: bool) -> str:
    cols = []
    for s in v.SAMPLES:
        m, t = (f"max(case when sample = '{s}' and total >= {least} then {c} end)" for c in ("meth", "total"))
        cols += [f'{_LEVEL6.format(m=m, t=t)} as "{s}"'] if kind == "level" else [f'{m} as "{s}_meth"', f'{t} as "{s}_total"']
    return f"""with {v.SITES_SQL} select contig, start, "end", modification, 0 as score, strand, {', '.join(cols)} from sites {"where modification = 'm,CG,0'" if cg else ''}
group by contig, start, "end", modification, strand having sum(case when total >= {least} then 1 else 0 end) >= {required}"""


@query(_matrix_sql("level", 2, 4, False))
def combine_level(spark, d):
    return combine.matrix(v.sites(spark, d), list(v.SAMPLES), "level", combine.CombineOptions(2, numeric.ppb("0.666666666")))


@query(_matrix_sql("count", 1, 1, False))
def combine_count(spark, d):
    return combine.matrix(v.sites(spark, d), list(v.SAMPLES), "count")


@query(_matrix_sql("level", 1, 6, False))
def combine_min_prop(spark, d):
    return combine.matrix(v.sites(spark, d), list(v.SAMPLES), "level", combine.CombineOptions(1, numeric.ppb("1")))


@query(_matrix_sql("count", 3, 1, True))
def combine_cg_only(spark, d):
    return combine.matrix(v.sites(spark, d), list(v.SAMPLES), "count", combine.CombineOptions(3, 0, True))


@query(f"""with {v.SITES_SQL}, g as (select sum(case when total >= 2 then 1 else 0 end) as v from sites group by contig, start, "end", strand)
select count(*) as sites_seen, cast(sum(case when v >= 3 then 1 else 0 end) as bigint) as sites_written from g""")
def combine_report(spark, d):
    return combine.report(v.sites(spark, d), len(v.SAMPLES), combine.CombineOptions(2, numeric.ppb("0.5")))


@query("""with o as (select o_orderstatus as sample, 'c' || (o_custkey % 3) as contig, o_orderkey as line, o_custkey % 211 as start from orders),
l as (select *, lag(start) over (partition by sample, contig order by line) as b from o) select sample, contig, line, start from l where b >= start""")
def sample_ordering_check(spark, d):
    rows = v.table(spark, d, "orders").selectExpr("o_orderstatus as sample", "concat('c', o_custkey % 3) as contig", "o_orderkey as line", "o_custkey % 211 as start", "o_custkey % 211 + 1 as end", "'+' as strand")
    return combine.unordered(rows).select("sample", "contig", "line", "start")


# --- search, verification, pairing, selection -------------------------------------------------------

KMER_SQL = (
    v.READS_SQL
    + """, texts as (
  select contig, 'OT' as strand, replace(seq, 'C', 'T') as t, seq as bases from contigs union all
  select contig, 'OB', replace(reverse(translate(seq, 'ACGTN', 'TGCAN')), 'C', 'T'), reverse(translate(seq, 'ACGTN', 'TGCAN')) from contigs
), gk as (
  select contig, strand, i - 1 as start, substr(t, i, 16) as kmer from (select contig, strand, t, cast(unnest(range(1, length(t) - 14)) as int) as i from texts) where not contains(substr(t, i, 16), 'N')
), idx as (
  select gk.*, count(*) over (partition by kmer) as hits from gk
), rk as (
  select read_id, length(seq) as n, i as offset_, substr(replace(seq, 'C', 'T'), i + 1, 16) as kmer from (select read_id, seq, cast(unnest(range(0, length(seq) - 15, 4)) as int) as i from reads where length(seq) >= 16)
), hit as (
  select read_id, n, offset_, contig, strand, start - offset_ as start from rk join idx using (kmer) where hits <= 1000 and not contains(kmer, 'N')
), vote as (
  select read_id, h.contig, strand, start, count(distinct offset_) as support from hit h join contigs c on h.contig = c.contig where start >= 0 and start + n <= length(c.seq) group by read_id, h.contig, strand, start
)"""
)


def _index(spark, d):
    return alignment.seed_index(v.contigs(spark, d))


#: Bases of a read.
READ = 36


def _votes(spark, d, size: int = READ):
    c = v.contigs(spark, d)
    hits = alignment.seed_hits(alignment.read_seeds(v.reads(spark, d, size)), alignment.seed_index(c))
    return alignment.votes(hits, c.select("contig", F.length("seq").alias("length")))


@query(f"with {KMER_SQL} select read_id, offset_ as \"offset\", contig, strand, start from hit")
def seed_hits(spark, d):
    return alignment.seed_hits(alignment.read_seeds(v.reads(spark, d)), _index(spark, d)).select("read_id", "offset", "contig", "strand", "start")


@query(f"with {KMER_SQL} select read_id, contig, strand, start, support from vote")
def candidate_votes(spark, d):
    return _votes(spark, d)


_PATTERN = "substr({text}, 1, cast(least(length({text}), 8 + read_id % 17) as int))"


@query(f"""with {KMER_SQL}, p as (select read_id, {_PATTERN.format(text="replace(seq, 'C', 'T')")} as p from reads where not contains({_PATTERN.format(text="seq")}, 'N')),
n as (select distinct length(p) as k from p), g as (select contig, strand, i - 1 as start, k, substr(t, i, cast(k as int)) as g from (select contig, strand, t, cast(unnest(range(1, length(t) + 1)) as int) as i from texts), n where i + k - 1 <= length(t))
select read_id as pattern_id, contig, strand, cast(start as bigint) as start from p join g on length(p.p) = g.k and p.p = g.g""")
def exact_search(spark, d):
    """The beginnings of reads, 8 to 24 letters long."""
    rows = v.reads(spark, d).select(F.col("read_id").alias("pattern_id"), F.expr(_PATTERN.format(text="seq")).alias("seq"))
    return alignment.exact_search(rows, v.contigs(spark, d))


@query(f"with {KMER_SQL} select kmer, cast(max(hits) as bigint) as hits from idx group by kmer having max(hits) > 1")
def seed_frequency(spark, d):
    return _index(spark, d).groupBy("kmer").agg(F.max("hits").alias("hits")).where("hits > 1")


@query(f"""with {v.READS_SQL}, b as (select read_id, seq, cast(unnest(range(0, 6)) as int) as block from reads where length(seq) > 5 and length(seq) - length(replace(seq, 'N', '')) <= 5),
e as (select read_id, block, cast(block * length(seq) // 6 as int) as s, cast((block + 1) * length(seq) // 6 as int) as t, seq from b)
select read_id, block, s as start, substr(seq, s + 1, t - s) as bases from e where not contains(substr(seq, s + 1, t - s), 'N')""")
def proof_seed_blocks(spark, d):
    return v.reads(spark, d).select("read_id", F.explode(alignment.proof_blocks(F.col("seq"), 5)).alias("b")).select("read_id", "b.*")


@query(f"with {KMER_SQL} select read_id, length(seq) >= 16 and length(seq) - length(replace(seq, 'N', '')) <= 5 as searchable from reads")
def searchable_reads(spark, d):
    return v.reads(spark, d).select("read_id", alignment.searchable(F.col("seq")).alias("searchable"))


@query(f"""with {KMER_SQL}, p as (select v.read_id, v.contig, v.strand, v.start, r.seq, substr(t.bases, cast(v.start + 1 as int), length(r.seq)) as w from vote v join reads r using (read_id) join texts t on t.contig = v.contig and t.strand = v.strand),
x as (select *, unnest(range(1, length(seq) + 1)) as i from p)
select read_id, contig, strand, start, cast(sum(case when substr(seq, cast(i as int), 1) = 'N' or substr(w, cast(i as int), 1) = 'N' then 1 when substr(seq, cast(i as int), 1) = substr(w, cast(i as int), 1) then 0 when substr(w, cast(i as int), 1) = 'C' and substr(seq, cast(i as int), 1) = 'T' then 0 else 1 end) as int) as distance from x group by read_id, contig, strand, start""")
def ungapped_verify(spark, d):
    return alignment.verified(_votes(spark, d).drop("support"), v.reads(spark, d), v.contigs(spark, d), limit=192).select("read_id", "contig", "strand", "start", "distance")


_PLACEMENTS = "select l_orderkey as pair_id, 'c' || (l_partkey % 2) as contig, case when l_suppkey % 2 = 0 then 'OT' else 'OB' end as strand, l_partkey % 900 as start, l_partkey % 900 + 100 as \"end\", cast(l_linenumber % 6 as int) as distance, 100 as length, l_linenumber % 2 as mate from lineitem"


def _placements(spark, d, mate: int | None = None) -> DataFrame:
    rows = v.table(spark, d, "lineitem").selectExpr("l_orderkey as pair_id", "concat('c', l_partkey % 2) as contig", "case when l_suppkey % 2 = 0 then 'OT' else 'OB' end as strand", "l_partkey % 900 as start", "l_partkey % 900 + 100 as end", "cast(l_linenumber % 6 as int) as distance", "100 as length", "l_linenumber % 2 as mate")
    return rows if mate is None else rows.where(F.col("mate") == mate).drop("mate")


PAIRS_SQL = f"""p as ({_PLACEMENTS}), pr as (
  select a.pair_id, a.contig, a.strand, a.start, a."end", b.start as start2, b."end" as end2, greatest(a."end", b."end") - least(a.start, b.start) as span, a.distance + b.distance as total
  from p a join p b on a.pair_id = b.pair_id and a.contig = b.contig and a.strand <> b.strand and a.mate = 0 and b.mate = 1
  where b.start between a."end" - 400 and a.start + 400 and greatest(a."end", b."end") - least(a.start, b.start) between 0 and 400
    and case when a.strand = 'OT' then a.start <= b.start and a."end" <= b."end" else b.start <= a.start and b."end" <= a."end" end)"""


@query(f'with {PAIRS_SQL} select pair_id, contig, strand, start, "end", start2, end2, span, total from pr')
def pair_band_join(spark, d):
    return alignment.band_pairs(_placements(spark, d, 0), _placements(spark, d, 1), 0, 400).select("pair_id", "contig", "strand", "start", "end", "start2", "end2", "span", "total")


@query(f"""with p as ({_PLACEMENTS}) select pair_id, contig, strand, start from p a where mate = 0 and exists (select 1 from p b where b.mate = 1 and a.pair_id = b.pair_id and a.contig = b.contig and a.strand <> b.strand and abs(a.start - b.start) <= 400
 and case when a.strand = 'OT' then a.start < b.start + b.length + 5 else b.start < a.start + a.length + 5 end)""")
def geometry_semi_join(spark, d):
    return alignment.with_partner(_placements(spark, d, 0), _placements(spark, d, 1), 400).select("pair_id", "contig", "strand", "start")


@query(f"""with p as ({_PLACEMENTS}), intervals as (select pair_id, contig, case when strand = 'OT' then 'OB' else 'OT' end as strand, greatest(case when strand = 'OT' then start else "end" - 400 end - 5, 0) as start, least(case when strand = 'OT' then start + 400 else "end" end + 5, 1000) as "end" from p where mate = 0),
reach as (select *, max("end") over (partition by pair_id, contig, strand order by start, "end" rows between unbounded preceding and 1 preceding) as m from (select distinct * from intervals where "end" - start >= 100)),
isl as (select *, sum(case when m is null or start > m + 1 then 1 else 0 end) over (partition by pair_id, contig, strand order by start, "end" rows between unbounded preceding and current row) as k from reach)
select pair_id, contig, strand, min(start) as start, max("end") as "end" from isl group by pair_id, contig, strand, k""")
def mate_rescue_windows(spark, d):
    return alignment.rescue_windows(_placements(spark, d, 0).withColumn("contig_length", F.lit(1000)), 100, 400)


@query(f"with {PAIRS_SQL}, s as (select pair_id, -4 * total as score from pr), b as (select *, max(score) over (partition by pair_id) as best from s) select pair_id, best, max(case when score < best then score end) as second_best, cast(sum(case when best - score <= 7 then 1 else 0 end) - 1 as bigint) as near_best from b group by pair_id, best")
def pair_score_confidence(spark, d):
    pairs = alignment.band_pairs(_placements(spark, d, 0), _placements(spark, d, 1), 0, 400)
    return alignment.score_confidence(pairs.select("pair_id", mapq.edit_score(F.col("total")).alias("score")), "pair_id")


_ORIGINS = """pl as (select l_orderkey as read_id, 'c' || (l_partkey % 3) as contig, case when l_suppkey % 2 = 0 then 'OT' else 'OB' end as strand, l_partkey % 50 as five_prime, l_partkey % 50 as start, l_partkey % 50 + 100 + l_linenumber % 2 as "end", cast(l_quantity as int) % 6 as distance, cast(l_linenumber % 2 as int) as net_gap from lineitem),
og as (select read_id, contig, strand, five_prime, min(distance) as distance from pl group by all), bd as (select read_id, min(distance) as best from og group by read_id),
sel as (select og.read_id, best, cast(count(*) as bigint) as origins, cast(count(*) filter (distance = best) as bigint) as best_origins, case when count(*) filter (distance = best) > 1 then best else min(case when distance > best then distance end) end as second from og join bd on og.read_id = bd.read_id group by og.read_id, best)"""


def _origins(spark, d) -> DataFrame:
    return v.table(spark, d, "lineitem").selectExpr("l_orderkey as read_id", "concat('c', l_partkey % 3) as contig", "case when l_suppkey % 2 = 0 then 'OT' else 'OB' end as strand", "l_partkey % 50 as five_prime", "l_partkey % 50 as start", "l_partkey % 50 + 100 + l_linenumber % 2 as end", "cast(l_quantity as int) % 6 as distance", "cast(l_linenumber % 2 as int) as net_gap")


@query(f"with {_ORIGINS} select read_id, best, second, origins, best_origins, case when best_origins = 1 then 'unique' else 'ambiguous' end as status from sel")
def origin_status(spark, d):
    return alignment.selected(_origins(spark, d))


@query(f"""with {_ORIGINS}, r as (select *, row_number() over (partition by read_id order by distance, net_gap, md5('7' || chr(9) || read_id || chr(9) || contig || chr(9) || strand || chr(9) || five_prime), contig, strand, five_prime, start, "end") as n from pl)
select read_id, contig, strand, five_prime, start, "end", distance, net_gap from r where n = 1""")
def tie_break_md5(spark, d):
    return alignment.representative(_origins(spark, d), seed=7)


@query(f"""with {_ORIGINS} select read_id, contig, strand, start, bit_or(1 << net_gap * 3 + distance) as proof_mask from pl group by read_id, contig, strand, start""")
def candidate_dedup_masks(spark, d):
    rows = _origins(spark, d).withColumn("proof_mask", F.expr("shiftleft(1, net_gap * 3 + distance)"))
    return alignment.deduplicated(rows)


@query(f"""with {_ORIGINS}, cd as (select read_id, contig, strand, start, bit_or(1 << net_gap * 3 + distance) as m from pl group by read_id, contig, strand, start), ps as (select distinct read_id, contig, strand, start + 3 as start from pl where distance = 0)
select p.read_id, p.contig, p.strand, p.start, cast(bit_or(case when abs(c.start - p.start) <= 5 then c.m else 0 end) as bigint) as proof_mask from ps p left join cd c on p.read_id = c.read_id and p.contig = c.contig and p.strand = c.strand group by p.read_id, p.contig, p.strand, p.start""")
def placement_proof_masks(spark, d):
    rows = _origins(spark, d).withColumn("proof_mask", F.expr("shiftleft(1, net_gap * 3 + distance)"))
    placed = rows.where("distance = 0").select("read_id", "contig", "strand", (F.col("start") + 3).alias("start")).distinct()
    return alignment.placement_masks(placed, alignment.deduplicated(rows))


@query(f"""with {KMER_SQL}, w as (select v.read_id, v.contig, v.strand, v.start, replace(r.seq, 'C', 'T') as s, replace(substr(t.bases, cast(v.start + 1 as int), length(r.seq)), 'C', 'T') as w, length(r.seq) // 8 as k from vote v join reads r using (read_id) join texts t on t.contig = v.contig and t.strand = v.strand),
b as (select *, cast(unnest(range(0, 8)) as int) as b from w), x as (select *, cast(unnest(range(-3, 4)) as int) as x from b), h as (select read_id, contig, strand, start, b, max(case when b * k + x >= 0 and substr(w, cast(b * k + x + 1 as int), cast(k as int)) = substr(s, cast(b * k + 1 as int), cast(k as int)) then 1 else 0 end) as hit from x group by all)
select read_id, contig, strand, start, sum(hit) >= 5 as kept from h group by read_id, contig, strand, start""")
def local_block_filter(spark, d):
    rows = alignment.windows(_votes(spark, d).join(v.reads(spark, d), "read_id"), v.contigs(spark, d), 0, READ)
    window = F.left("window", F.length("seq"))
    return rows.select("read_id", "contig", "strand", "start", alignment.block_filter(window, F.col("seq")).alias("kept"))


@query("""with b as (select l_orderkey as read_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as int) as block, cast(l_quantity as bigint) % 23 as hits from lineitem),
r as (select *, sum(hits) over (partition by read_id order by case when hits = 0 then 1 else 0 end, hits, block rows between unbounded preceding and current row) as s from b)
select read_id, block, hits, cast(s as bigint) as running, s <= 30 as kept from r""")
def ranked_block_budget(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.row_number().over(w).alias("block"), (F.col("l_quantity").cast("bigint") % 23).alias("hits"))
    return alignment.affordable_blocks(rows, 30)


@query(f"""with {v.READS_SQL}, a as (select read_id, seq || substr('AGATCGGAAGAGC', 1, cast(8 + read_id % 6 as int)) as s from reads), i as (select read_id, s, unnest(range(greatest(length(s) - 30, 0), length(s) - 7)) as i from a),
f as (select read_id, min(i) as start from i where substr(s, cast(i + 1 as int), cast(least(length(s) - i, 13) as int)) = substr('AGATCGGAAGAGC', 1, cast(least(length(s) - i, 13) as int)) group by read_id)
select a.read_id, cast(f.start as int) as start from a left join f on a.read_id = f.read_id""")
def adapter_scan(spark, d):
    rows = v.reads(spark, d).withColumn("s", F.concat("seq", F.expr("substr('AGATCGGAAGAGC', 1, cast(8 + read_id % 6 as int))")))
    return rows.select("read_id", alignment.adapter_start(F.col("s")).alias("start"))


@query("""with f as (select o_orderkey, o_orderkey % 2 = 0 as paired, o_custkey % 5 <> 0 as mapped, o_custkey % 2 = 0 as rev, o_custkey % 3 = 0 as first, o_custkey % 7 < 3 as mrev from orders)
select o_orderkey, case when paired then 1 else 0 end + case when paired and mapped then 2 else 0 end + case when not mapped then 4 else 0 end + case when paired and not mapped then 8 else 0 end + case when mapped and rev then 16 else 0 end
 + case when paired and mapped and mrev then 32 else 0 end + case when paired and first then 64 else 0 end + case when paired and not first then 128 else 0 end as flag from f""")
def sam_flags(spark, d):
    e = F.expr
    return v.table(spark, d, "orders").select("o_orderkey", alignment.sam_flag(e("o_orderkey % 2 = 0"), e("o_custkey % 5 <> 0"), e("o_custkey % 2 = 0"), e("o_custkey % 3 = 0"), e("o_custkey % 7 < 3")).alias("flag"))


@query("""with x as (select l_orderkey, l_linenumber, l_partkey % 500 as s, l_partkey % 500 + 90 as e, l_suppkey % 500 as ms, l_suppkey % 500 + 90 as me, l_linenumber % 2 = 0 as f from lineitem)
select l_orderkey, l_linenumber, case when s < ms or (s = ms and f) then greatest(e, me) - least(s, ms) else least(s, ms) - greatest(e, me) end as tlen from x""")
def tlen(spark, d):
    rows = v.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 500 as s", "l_partkey % 500 + 90 as e", "l_suppkey % 500 as ms", "l_suppkey % 500 + 90 as me", "l_linenumber % 2 = 0 as f")
    return rows.select("l_orderkey", "l_linenumber", alignment.template_length(F.col("s"), F.col("e"), F.col("ms"), F.col("me"), F.col("f")).alias("tlen"))


# --- mapping quality ----------------------------------------------------------------------------------

_EVIDENCE = {
    "read_length": "cast(50 + l_partkey % 120 as int)",
    "best": "cast(l_linenumber % 6 as int)",
    "second": "case when l_suppkey % 3 = 0 then null else cast(l_linenumber % 6 + l_partkey % 4 as int) end",
    "distance_limit": "case when l_linenumber % 6 > 3 then 5 else 3 end",
    "located_rows": "l_partkey % 400",
    "candidate_starts": "l_partkey % 90",
    "placements": "l_suppkey % 70",
    "first_hits": "l_partkey % 80",
    "first_bases": "l_suppkey % 60",
    "direct_singleton": "l_partkey % 2 = 0",
    "complete": "cast(l_quantity as int) % 2 = 0",
    "audited": "cast(l_quantity as int) % 3 <> 0",
    "rounds": "cast(l_quantity as int) % 5",
}
EVIDENCE_SQL = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{e} as {n}" for n, e in _EVIDENCE.items()) + " from lineitem"


def _evidence(spark, d):
    return v.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f"{e} as {n}" for n, e in _EVIDENCE.items()])


SINGLE_SQL = f"""ev as ({EVIDENCE_SQL}), r as (select *, least(60, 10 * greatest(0, coalesce(second, distance_limit + 1) - best)) as raw from ev), hc as (
  select *, audited and best <= 3 and ((direct_singleton and first_hits = 1 and first_bases between 16 and 46) or rounds >= 3 or (rounds >= 2 and (raw >= 50 or (raw >= 40 and best <= 1)))) as high,
    complete and (rounds >= 3 or (read_length >= 128 and rounds >= 2 and ((direct_singleton and best <= 2) or (best = distance_limit and second is null)))) as cert from r
), cp as (
  select *, least(case when raw >= 40 and not high then least(raw, 30) else raw end, case when best >= 5 then 10 when best = 4 and complete and rounds >= 2 then 20 when best = 4 then 15 else 60 end,
    case when not complete and (first_hits > 64 or located_rows > 256 or candidate_starts > 64 or placements > 64) then 10 else 60 end, case when not complete and rounds < 1 then 20 else 60 end) as capped from hc
), fin as (
  select *, greatest(case when capped = raw and raw in (10, 30) and complete and best <= 3 and rounds >= 3 then capped + 10 else capped end, case when cert then 20 else 0 end) as q from cp
)"""


@query(f"with {SINGLE_SQL} select l_orderkey, l_linenumber, l_partkey, cast(q as int) as mapq, cast(case when l_suppkey % 4 = 0 then least(q, case when cert or (complete and best <= 1 and rounds >= 2) then 20 else 10 end) else q end as int) as locus_mapq from fin")
def mapq_se(spark, d):
    return _evidence(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", mapq.single().alias("mapq"), mapq.local_locus(F.expr("l_suppkey % 4 = 0")).alias("locus_mapq"))


@query(f"""with ev as ({EVIDENCE_SQL}) select l_orderkey, l_linenumber, l_partkey, cast(least(least(60, 10 * greatest(0, coalesce(second, best) - best)), case when best >= 5 then 10 when best = 4 then 15 else 60 end) as int) as cap,
 cast(case when not complete and first_bases < 40 and (located_rows > 256 or candidate_starts > 64 or placements > 64) then least(first_bases, 10) else first_bases end as int) as merged,
 cast(case when direct_singleton then least(first_bases, coalesce(second, 0), 20) else 0 end as int) as adapter, first_bases >= 20 and best <= 1 as cross_check, cast(case when complete and second is not null and first_bases - second >= 2 then 10 end as int) as affine from ev""")
def mapq_se_cross_pass(spark, d):
    c = F.col
    return _evidence(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", mapq.cross_pass_cap(c("best"), F.coalesce("second", "best")).alias("cap"), mapq.merged_repeat(c("first_bases"), c("complete"), c("located_rows"), c("candidate_starts"), c("placements")).alias("merged"), mapq.adapter_consensus(c("direct_singleton"), c("first_bases"), c("second")).alias("adapter"), mapq.needs_cross_check(c("first_bases"), c("best")).alias("cross_check"), mapq.affine_unique(c("complete"), c("first_bases"), c("second")).alias("affine"))


PAIR_SQL = f"""ev as ({EVIDENCE_SQL}), pe as (select *, -4 * best as s1, case when l_suppkey % 3 = 0 then null else -4 * best - l_partkey % 9 end as s2, l_partkey % 13 as near, l_suppkey % 5 <> 0 as uniq from ev),
pq as (select *, case when not uniq or not complete then 0 else least(least(60, greatest(0, case when s2 is null then 60 else cast(trunc((1000 * (s1 - s2) + 50) / 100) as int) end - case when near <= 1 then 0 else cast(trunc(4.343::double * ln(near) + 0.499) as int) end)), case when near = 0 then 60 else 39 end) end as q from pe)"""


def _pair_evidence(spark, d):
    rows = _evidence(spark, d).selectExpr("*", "-4 * best as s1", "case when l_suppkey % 3 = 0 then null else -4 * best - l_partkey % 9 end as s2", "l_partkey % 13 as near", "l_suppkey % 5 <> 0 as uniq")
    c = F.col
    return rows.withColumn("q", mapq.pair(c("uniq"), c("complete"), c("s1"), c("s2"), c("near")))


@query(f"with {PAIR_SQL} select l_orderkey, l_linenumber, l_partkey, cast(q as int) as mapq, cast(case when direct_singleton or audited or greatest(located_rows, candidate_starts) >= 384 then least(q, 19) else q end as int) as effective from pq")
def mapq_pe(spark, d):
    c = F.col
    return _pair_evidence(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", c("q").alias("mapq"), mapq.pair_effective(c("q"), c("direct_singleton"), c("audited"), c("located_rows"), c("candidate_starts")).alias("effective"))


@query(f"""with {PAIR_SQL} select l_orderkey, l_linenumber, l_partkey, cast(case when not uniq then 0 else least(q, coalesce(second * 10, 60), case when direct_singleton then 20 when rounds = 4 then 30 when located_rows >= 384 and not audited then 30 else 60 end, case when audited then 60 else 39 end, case when first_hits % 2 = 0 then 20 else 60 end) end as int) as mapq from pq""")
def mapq_pe_final(spark, d):
    c = F.col
    return _pair_evidence(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", mapq.pair_final(c("uniq"), c("q"), c("second") * 10, c("direct_singleton"), c("rounds") == 4, c("located_rows"), c("audited"), c("first_hits") % 2 == 0).alias("mapq"))


@query("select l_orderkey, l_linenumber, l_partkey, cast(bit_count((l_partkey * 37) & 1023) as int) as support from lineitem")
def seed_support_popcount(spark, d):
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", mapq.round_support(F.col("l_partkey") * 37).alias("support"))


# --- evaluation ------------------------------------------------------------------------------------------

LEDGER_SQL = "ledger as (select o_orderkey as id, case when o_orderkey % 11 = 0 then null else cast(o_custkey % 61 as int) end as mapq, o_orderkey % 5 < 3 and o_orderkey % 11 <> 0 as correct from orders)"
CURVE_SQL = LEDGER_SQL + """, per as (select mapq, count(*) as k, cast(sum(case when correct then 1 else 0 end) as bigint) as r from ledger where mapq is not null group by mapq),
cum as (select mapq, cast(sum(k) over w as bigint) as chosen, cast(sum(r) over w as bigint) as "right", (select count(*) from ledger) as n from per window w as (order by mapq desc rows between unbounded preceding and current row))"""


def _ledger(spark, d):
    return v.table(spark, d, "orders").selectExpr("o_orderkey as id", "case when o_orderkey % 11 = 0 then null else cast(o_custkey % 61 as int) end as mapq", "o_orderkey % 5 < 3 and o_orderkey % 11 <> 0 as correct")


@query(f'with {CURVE_SQL} select mapq, chosen, "right", round("right" / chosen, 6) as precision, round("right" / n, 6) as recall, round(2 * "right" / (n + chosen), 6) as f1 from cum')
def pr_curve(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return evaluate.curve(_ledger(spark, d)).select("mapq", "chosen", "right", r("precision"), r("recall"), r("f1"))


@query(f'with {CURVE_SQL}, g as (select "right" / chosen as p, "right" / n - coalesce(lag("right" / n) over (order by mapq desc), 0) as g from cum) select round(sum(p * g), 6) as average_precision from g')
def average_precision(spark, d):
    return evaluate.average_precision(evaluate.curve(_ledger(spark, d))).select(F.round("average_precision", 6).alias("average_precision"))


@query(f"""with {LEDGER_SQL}, q(q) as (values (10), (20), (30), (40)), s as (select q, cast(count(*) filter (mapq >= q) as bigint) as chosen, cast(count(*) filter (mapq >= q and correct) as bigint) as "right", count(*) as n from ledger, q group by q)
select q, chosen, "right", round("right" / chosen, 6) as precision, round("right" / n, 6) as recall, round(2 * "right" / (n + chosen), 6) as f1 from s""")
def q_operating_points(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return evaluate.operating_points(_ledger(spark, d)).select("q", "chosen", "right", r("precision"), r("recall"), r("f1"))


@query("""with t as (select o_orderkey as name, 'c' || (o_custkey % 4) as contig, o_custkey % 2 = 0 as reverse, o_custkey % 1000 as five_prime from orders), c as (select name, 'c' || ((five_prime + case when name % 13 = 0 then 1 else 0 end) % 4) as contig, case when name % 17 = 0 then not reverse else reverse end as reverse, five_prime + name % 14 as five_prime from t where name % 7 <> 0),
j as (select t.contig as tc, c.contig as cc, t.reverse = c.reverse and t.contig = c.contig as same, abs(t.five_prime - c.five_prime) as o from t left join c on t.name = c.name)
select count(*) as truth, count(cc) as placed, count(*) filter (tc = cc) as contig, count(*) filter (same) as orientation, count(*) filter (same and o <= 0) as within_0, count(*) filter (same and o <= 1) as within_1, count(*) filter (same and o <= 5) as within_5, count(*) filter (same and o <= 10) as within_10 from j""")
def tolerance_counts(spark, d):
    t = v.table(spark, d, "orders").selectExpr("o_orderkey as name", "concat('c', o_custkey % 4) as contig", "o_custkey % 2 = 0 as reverse", "o_custkey % 1000 as five_prime")
    c = t.where("name % 7 <> 0").selectExpr("name", "concat('c', (five_prime + case when name % 13 = 0 then 1 else 0 end) % 4) as contig", "case when name % 17 = 0 then not reverse else reverse end as reverse", "five_prime + name % 14 as five_prime")
    return evaluate.tolerance_counts(t, c)


# --- parsing ------------------------------------------------------------------------------------------------


@query("""with t as (select o_orderkey, case o_orderkey % 5 when 0 then 'chr' || o_custkey || ':1,234-' || (2000 + o_custkey) when 1 then 'a:b:' || (1 + o_custkey) || '-' || (o_custkey + 50) when 2 then 'chr1:0-10' when 3 then 'chr1:20-10' else 'chr' || o_custkey end as s from orders),
p as (select o_orderkey, regexp_full_match(s, '.+:([0-9]+|[0-9]{1,3}(,[0-9]{3})+)-([0-9]+|[0-9]{1,3}(,[0-9]{3})+)') as ok, regexp_extract(s, '^(.+):[0-9,]+-[0-9,]+$', 1) as c, try_cast(replace(regexp_extract(s, ':([0-9,]+)-[0-9,]+$', 1), ',', '') as bigint) as a, try_cast(replace(regexp_extract(s, '-([0-9,]+)$', 1), ',', '') as bigint) as b from t)
select o_orderkey, case when ok and a >= 1 and b >= a then c end as contig, case when ok and a >= 1 and b >= a then a - 1 end as start, case when ok and a >= 1 and b >= a then b end as "end" from p""")
def region_spec_parse(spark, d):
    s = F.expr("case o_orderkey % 5 when 0 then concat('chr', o_custkey, ':1,234-', 2000 + o_custkey) when 1 then concat('a:b:', 1 + o_custkey, '-', o_custkey + 50) when 2 then 'chr1:0-10' when 3 then 'chr1:20-10' else concat('chr', o_custkey) end")
    contig, start, end = numeric.region_parts(F.col("s"))
    return v.table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", contig.alias("contig"), start.alias("start"), end.alias("end"))


@query("""with t as (select o_orderkey, case when o_custkey % 4 = 0 then '0.' || o_orderkey when o_custkey % 4 = 1 then '1.0' when o_custkey % 4 = 2 then '2' else '0.12345678901' end as s from orders)
select o_orderkey, case when regexp_full_match(s, '(0(\\.[0-9]{1,9})?|1(\\.0{1,9})?|\\.[0-9]{1,9})') then cast(cast(s as decimal(20, 10)) * 1000000000 as bigint) end as ppb from t""")
def ppb_parse(spark, d):
    s = F.expr("case when o_custkey % 4 = 0 then concat('0.', o_orderkey) when o_custkey % 4 = 1 then '1.0' when o_custkey % 4 = 2 then '2' else '0.12345678901' end")
    return v.table(spark, d, "orders").select("o_orderkey", numeric.parts_per_billion(s).alias("ppb"))
