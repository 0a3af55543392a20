"""Queries of parsers, record composition and alignment kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chem, kernels
from ..operators import alignment, evidence, records
from ..sources import fastq, sites
from . import catalogue as c
from . import virtual as v

_BED = "case when event_id % 17 = 0 then '# note ' || event_id when event_id % 17 = 1 then 'track name=x' when event_id % 17 = 2 then '' else 'chr' || (user_id % 3) || chr(9) || event_id || chr(9) || (event_id + 1 + user_id % 9) || chr(9) || event_type end"


@c.query(f"""with t as (select {_BED} as s, event_id % 17 as k from events), f as (select string_split(s, chr(9)) as f from t where k > 2)
select f[1] as contig, cast(f[2] as bigint) as start, cast(f[3] as bigint) as "end" from f""")
def bed_parse(spark, d):
    return sites.bed_rows(v.table(spark, d, "events").selectExpr(f"{_BED} as text"))


_FIELDS = """concat_ws(chr(9), 'chr1', case when l_linenumber = 7 then 'A' when l_suppkey % 2 = 0 then 'C' else 'G' end, case when l_partkey % 19 = 0 then '0' else cast(l_partkey as {text}) end,
 case when l_partkey % 3 = 0 then 'CG' when l_partkey % 3 = 1 then 'CHG' else 'CHH' end, case when l_partkey % 3 = 0 then 'CG' else 'CA' end,
 case when l_suppkey % 23 = 0 then 'na' else '0.500000' end, cast(l_linenumber as {text}), cast(l_suppkey % 30 as {text}))"""


@c.query(f"""with t as (select l_orderkey, l_linenumber, l_partkey, string_split({_FIELDS.format(text='varchar')}, chr(9)) as f from lineitem)
select l_orderkey, l_linenumber, l_partkey, case when f[2] not in ('C', 'G') then 'the nucleotide is neither C nor G' when cast(f[3] as bigint) < 1 then 'the position is not 1 or more' when cast(f[7] as bigint) > cast(f[8] as bigint) then 'more methylated than total'
 when (f[6] = 'na') <> (cast(f[8] as bigint) = 0) then 'the level is na exactly without coverage' end as problem from t""")
def cgmap_parse(spark, d):
    rows = v.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"split({_FIELDS.format(text='string')}, chr(9)) as f")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", sites.cgmap_problem(F.col("f")).alias("problem"))


_BM = """concat_ws(chr(9), 'chr1', cast(l_partkey as {text}), cast(l_partkey + 1 + case when l_suppkey % 31 = 0 then 1 else 0 end as {text}), 'm,CG,0', cast(l_linenumber + l_suppkey % 9 as {text}), case when l_suppkey % 2 = 0 then '+' else '-' end,
 cast(l_partkey as {text}), cast(l_partkey + 1 + case when l_suppkey % 31 = 0 then 1 else 0 end as {text}), '255,0,0', cast(l_linenumber + l_suppkey % 9 as {text}), '12.50', cast(l_linenumber as {text}), cast(l_suppkey % 9 + case when l_partkey % 29 = 0 then 1 else 0 end as {text}), '0', '0', '0', '0', '0')"""


@c.query("""select l_orderkey, l_linenumber, l_partkey, case when l_suppkey % 31 = 0 then 'the site is not one base' when l_partkey % 29 = 0 then 'coverage is not methylated plus unmethylated' end as problem from lineitem""")
def bedmethyl_parse(spark, d):
    rows = v.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"split({_BM.format(text='string')}, chr(9)) as f")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", sites.bedmethyl_problem(F.col("f")).alias("problem"))


_Q = "case when o_orderkey % 7 = 0 then 'r' || o_orderkey else '@r' || o_orderkey || ' x' end as header, substr('ACGTNACGTN', 1, cast(o_custkey % 10 as int)) as seq, case when o_custkey % 5 = 0 then '+' when o_custkey % 5 = 1 then '-' else '+r' || (o_orderkey - o_custkey % 2) || ' x' end as plus, substr('IIIIIIIIII', 1, cast((o_custkey + case when o_orderkey % 11 = 0 then 1 else 0 end) % 10 as int)) as qual"


@c.query(f"""with t as (select o_orderkey, {_Q} from orders) select o_orderkey, case when not starts_with(header, '@') then 'no name after @' when not starts_with(plus, '+') then 'the third line does not begin with +' when plus <> '+' and substr(plus, 2) <> substr(header, 2) then 'the third line names another read'
 when length(seq) = 0 then 'the read is empty' when length(seq) <> length(qual) then 'bases and qualities differ in number' end as problem from t""")
def fastq_validate(spark, d):
    rows = v.table(spark, d, "orders").selectExpr("o_orderkey", *_split_select(_Q))
    return rows.select("o_orderkey", fastq.problem(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual")).alias("problem"))


def _split_select(text: str) -> list[str]:
    """A select list at the commas outside brackets."""
    out, depth, now = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


_NAMES = "case when o_orderkey % 3 = 0 then 'r' || o_orderkey else 'r' || o_orderkey || '/1' end as a, case when o_orderkey % 3 = 0 then 'r' || o_orderkey when o_orderkey % 3 = 1 then 'r' || o_orderkey || '/2' else 'q' || o_orderkey || '/2' end as b"


@c.query(f"with t as (select o_orderkey, {_NAMES} from orders) select o_orderkey, case when a = b then a when a like '%/1' and b like '%/2' and substr(a, 1, length(a) - 2) = substr(b, 1, length(b) - 2) then substr(a, 1, length(a) - 2) end as shared from t")
def pair_names(spark, d):
    rows = v.table(spark, d, "orders").selectExpr("o_orderkey", *_split_select(_NAMES))
    return rows.select("o_orderkey", fastq.shared_name(F.col("a"), F.col("b")).alias("shared"))


def _windows(spark, d, size: int = c.READ):
    """Reads beside the reference bases of their candidate places, with two bases of flank, all in the
    reference's orientation; ``top`` tells the strand."""
    rows = alignment.windows(c._votes(spark, d, size).join(v.reads(spark, d, size), "read_id"), v.contigs(spark, d), 2, size)
    top = F.col("strand") == "OT"
    turned = lambda x: F.when(top, x).otherwise(chem.reverse_complement(x))
    flanked = F.left("window", F.length("seq") + 4)
    plain = F.substring(flanked, F.lit(3), F.length("seq"))
    return rows.select("read_id", "contig", "strand", "start", top.alias("top"), turned(F.col("seq")).alias("seq"), turned(plain).alias("window"), turned(flanked).alias("flanked"))


_PLACE = ["read_id", "contig", "strand", "start"]

_WIN = c.KMER_SQL + """, win as (
  select v.read_id, v.contig, v.strand, v.start, r.seq, t.bases, cast(unnest(range(1, length(r.seq) + 1)) as int) as i from vote v join reads r using (read_id) join texts t on t.contig = v.contig and t.strand = v.strand
), ch as (
  select read_id, contig, strand, start, i, substr(seq, i, 1) as q, substr(bases, cast(start + i as int), 1) as r, substr(bases, cast(start + i + 1 as int), 1) as r1, substr(bases, cast(start + i + 2 as int), 1) as r2 from win
)"""


@c.query(f"""with {_WIN}, x as (select *, case when r <> 'C' then '.' when r1 = 'G' then 'z' when r1 not in ('A', 'C', 'T') or r1 is null or r1 = '' or r2 not in ('A', 'C', 'G', 'T') or r2 is null or r2 = '' then 'u' when r2 = 'G' then 'x' else 'h' end as l from ch)
select read_id, contig, strand, start, string_agg(case when l = '.' then '.' when q = 'C' then upper(l) when q = 'T' then l else '.' end, '' order by case when strand = 'OT' then i else -i end) as xm from x group by read_id, contig, strand, start""")
def bismark_xm(spark, d):
    rows = _windows(spark, d).withColumn("d", records.described(F.col("flanked"), F.col("seq"), F.col("top"), F.lit(None).cast("int")))
    return rows.select(*_PLACE, F.col("d.xm").alias("xm"))


@c.query(f"with {_WIN} select read_id, contig, strand, start, cast(sum(case when q = r and q <> 'N' then 0 else 1 end) as int) as nm from ch group by read_id, contig, strand, start")
def nm_ungapped(spark, d):
    rows = _windows(spark, d).withColumn("d", records.described(F.col("flanked"), F.col("seq"), F.col("top"), F.lit(None).cast("int")))
    return rows.select(*_PLACE, F.col("d.nm").alias("nm"))


@c.query(f"""with {_WIN}, x as (select *, case when q = 'N' or r = 'N' then 'u' when q = r then 'm' when r = 'C' and q = 'T' then 'c' else 'x' end as k from ch)
select read_id, contig, strand, start, cast(sum(case when k = 'm' then 1 else 0 end) as int) as matches, cast(sum(case when k = 'c' then 1 else 0 end) as int) as compatible, cast(sum(case when k = 'x' then 1 else 0 end) as int) as mismatches,
 cast(sum(case when k = 'u' then 1 else 0 end) as int) as unknown, cast(sum(case when k in ('x', 'u') then 1 else 0 end) as int) as distance, cast(sum(case when k = 'm' then 0 else 1 end) as int) as literal_nm from x group by read_id, contig, strand, start""")
def ungapped_evaluation(spark, d):
    rows = _windows(spark, d).withColumn("e", records.evaluation(F.col("window"), F.col("seq"), F.lit(None).cast("string"), F.col("top")))
    return rows.select(*_PLACE, *[F.col(f"e.{k}").alias(k) for k in ("matches", "compatible", "mismatches", "unknown", "distance", "literal_nm")])


@c.query()
def edit_distance_bs(spark, d):
    """Gapped distances where the window has lost a base."""
    short, bottom = F.concat(F.substring("window", 1, 10), F.substring("window", 12, 200)), ~F.col("top")
    rows = _windows(spark, d).withColumn("distance", kernels.distance_udf(short, F.col("seq"), bottom))
    return rows.select(*_PLACE, "distance", kernels.alignment_udf(short, F.col("seq"), bottom).alias("path"))


@c.query()
def affine_score(spark, d):
    return _windows(spark, d).select(*_PLACE, kernels.affine_udf(F.col("window"), F.col("seq"), ~F.col("top")).alias("score"))


@c.query()
def semi_global_endpoint(spark, d):
    """Reads of 96 bases, as a clipped placement keeps 50 at least."""
    return _windows(spark, d, 96).select(*_PLACE, kernels.clipped_udf(F.col("window"), F.col("seq"), F.lit(5), ~F.col("top")).alias("clip"))


@c.query()
def map_single_end(spark, d):
    """Documents' letters mapped to the passages' letters."""
    from ..operators import single

    return single.map_reads(v.reads(spark, d), v.contigs(spark, d)).select("read_id", "status", "mapq", "contig", "strand", "start", "end", "distance")


_CIGAR = "concat(l_linenumber, 'S', 10 + l_suppkey % 5, 'M', 1 + l_partkey % 3, case when l_partkey % 2 = 0 then 'D' else 'I' end, 20, 'M')"


@c.query("""select l_orderkey, l_linenumber, l_partkey, cast(10 + l_suppkey % 5 + 20 + case when l_partkey % 2 = 0 then 1 + l_partkey % 3 else 0 end as bigint) as reference_span, cast(l_linenumber + 10 + l_suppkey % 5 + 20 + case when l_partkey % 2 = 0 then 0 else 1 + l_partkey % 3 end as bigint) as query_span from lineitem""")
def cigar_spans(spark, d):
    runs = evidence.cigar_runs(F.expr(_CIGAR))
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", evidence.reference_span(runs).alias("reference_span"), evidence.query_span(runs).alias("query_span"))


@c.query("""with t as (select l_orderkey, l_linenumber, l_partkey, 10 + l_suppkey % 5 as m, 1 + l_partkey % 3 as g, l_partkey % 2 = 0 as del from lineitem), i as (select *, unnest(range(0, m + 20 + case when del then g else 0 end)) as i from t)
select l_orderkey, l_linenumber, l_partkey, cast(count(*) as bigint) as covered, cast(sum(case when del and i >= m and i < m + g then 1 else 0 end) as bigint) as deleted, cast(sum(i) as bigint) as checksum from i group by l_orderkey, l_linenumber, l_partkey""")
def cigar_columns(spark, d):
    seq = F.lit("ACGT" * 20)
    rows = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(0).cast("bigint").alias("pos"), F.expr(_CIGAR).alias("cigar"), seq.alias("seq"), F.lit("I" * 80).alias("qual"))
    cols = evidence.alignment_columns(rows)
    return cols.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("covered"), F.sum(F.col("query_base").isNull().cast("bigint")).alias("deleted"), F.sum("position").alias("checksum"))


@c.query("""select l_orderkey, l_linenumber, l_partkey, l_partkey % 16 as flag from lineitem where ((l_suppkey % 64) * 64) & 3844 = 0""")
def record_exclusion(spark, d):
    rows = v.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "cast((l_suppkey % 64) * 64 as int) as flag")
    return evidence.kept_records(rows).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 16).alias("flag"))
