"""Deterministic sequencing relations over the given tables, in integer arithmetic.

The tables hold no sequencing data, so parts stand for reference positions, line items for observed
bases, documents for reads, benchmark passages for contigs and events for intervals. Each relation is
defined twice, for Spark and as SQL text, and both engines give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "substr('ACGT', cast(1 + ((p_partkey * p_partkey * 7919 + p_partkey * 104729 + 12345) % 65521) % 251 % 4 as int), 1)"
FRAGMENT = "l_orderkey % 401"
QUERY = """case when cast(round(l_discount * 100) as int) = 10 then null
  when cast(round(l_tax * 100) as int) = 8 and cast(round(l_discount * 100) as int) = 0 then 'N'
  when l_partkey % 37 = 0 and cast(round(l_discount * 100) as int) % 2 = 0 then substr('CATG', instr('ACGT', base), 1)
  when base = 'C' and strand = 'T' and (cast(round(l_discount * 100) as int) + l_partkey) % 3 <> 0 then 'T'
  when base = 'G' and strand = 'B' and (cast(round(l_discount * 100) as int) + l_partkey) % 3 <> 0 then 'A'
  else base end"""

REF_SQL = f"""ref as (
  select cast(p_partkey % 4 as bigint) as contig, cast((p_partkey - p_partkey % 4) / 4 as bigint) as position, p_partkey, {BASE} as base from part
)"""

CTX_SQL = (
    REF_SQL
    + """, nbr as (
  select *, lag(base, 1) over w as l1, lag(base, 2) over w as l2, lead(base, 1) over w as r1, lead(base, 2) over w as r2 from ref
  window w as (partition by contig order by position)
), ctx as (
  select contig, position, p_partkey, base,
    case when base = 'C' then case when r1 is null then null when r1 = 'G' then 'CG' when r2 is null then null when r2 = 'G' then 'CHG' else 'CHH' end
         when base = 'G' then case when l1 is null then null when l1 = 'C' then 'CG' when l2 is null then null when l2 = 'C' then 'CHG' else 'CHH' end end as context,
    case when base = 'C' then r1 when base = 'G' then translate(l1, 'ACGT', 'TGCA') end as second
  from nbr
)"""
)

OBS_SQL = (
    CTX_SQL
    + f""", raw as (
  select *, case when fragment_id % 2 = 0 then 'T' else 'B' end as strand from (
    select cast({FRAGMENT} as bigint) as fragment_id, cast(1 + l_linenumber % 2 as int) as segment, ctx.contig, ctx.position, ctx.base, ctx.context, ctx.second,
      l_partkey, l_discount, l_tax,
      case when l_quantity < 5 then null else cast(l_quantity - 5 as int) end as base_quality,
      case when (l_suppkey * 7 + l_linenumber) % 64 = 63 then 255 else cast((l_suppkey * 7 + l_linenumber) % 64 as int) end as mapping_quality
    from lineitem join ctx on l_partkey = p_partkey) z
), obs as (
  select fragment_id, segment, contig, position, base as reference_base, {QUERY} as query_base, base_quality, mapping_quality, strand, context, second from raw
)"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey % 4 as bigint) as contig", "cast((p_partkey - p_partkey % 4) / 4 as bigint) as position", "p_partkey", f"{BASE} as base")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed bases with their reference base and context."""
    from ..operators.methylation import with_context

    ctx = with_context(reference(spark, sf_dir))
    rows = table(spark, sf_dir, "lineitem").join(ctx, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.selectExpr(
        f"cast({FRAGMENT} as bigint) as fragment_id",
        "cast(1 + l_linenumber % 2 as int) as segment",
        "contig",
        "position",
        "base",
        "context",
        "second",
        "l_partkey",
        "l_discount",
        "l_tax",
        "case when l_quantity < 5 then null else cast(l_quantity - 5 as int) end as base_quality",
        "case when (l_suppkey * 7 + l_linenumber) % 64 = 63 then 255 else cast((l_suppkey * 7 + l_linenumber) % 64 as int) end as mapping_quality",
    ).selectExpr("*", "case when fragment_id % 2 = 0 then 'T' else 'B' end as strand")
    return rows.selectExpr("fragment_id", "segment", "contig", "position", "base as reference_base", f"{QUERY} as query_base", "base_quality", "mapping_quality", "strand", "context", "second")


# letters stand for bases in turn; z for an unknown one
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAN"

READS_SQL = f"""letters as (
  select doc_id, translate(regexp_replace(text, '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') as t from documents
), reads as (
  select doc_id * 100000 + i // 36 as read_id, substr(t, cast(i + 1 as int), 36) as seq from (select doc_id, t, unnest(range(0, length(t), 36)) as i from letters) z where length(substr(t, cast(i + 1 as int), 36)) >= 3
), contigs as (
  select 'c' || item_id as contig, translate(regexp_replace(text, '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') as seq from benchmark
)"""


def reads(spark: SparkSession, sf_dir: str, size: int = 36) -> DataFrame:
    """Documents' small letters as bases, cut into reads."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.translate(F.regexp_replace("text", "[^a-z]", ""), _LETTERS, _BASES).alias("t")).where("length(t) > 0")
    # one pass over the text: taking each read by its place would walk the text from its start every time
    rows = rows.select("doc_id", F.posexplode(F.regexp_extract_all("t", F.lit(f".{{1,{size}}}"), F.lit(0))).alias("i", "seq"))
    return rows.selectExpr("doc_id * 100000 + i as read_id", "seq").where("length(seq) >= 3")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("contig"), F.translate(F.regexp_replace("text", "[^a-z]", ""), _LETTERS, _BASES).alias("seq"))


INTERVALS_SQL = """intervals as (
  select cast(user_id % 4 as bigint) as contig, (event_id * 7) % 5000 as start, (event_id * 7) % 5000 + 1 + cast(floor(abs(value)) as bigint) % 60 as "end" from events
)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("cast(user_id % 4 as bigint) as contig", "(event_id * 7) % 5000 as start", "(event_id * 7) % 5000 + 1 + cast(floor(abs(value)) as bigint) % 60 as end")


SAMPLES = ("AF", "AO", "NF", "NO", "RF", "RO")

SITES_SQL = (
    OBS_SQL
    + f""", sample_obs as (
  select l_returnflag || l_linestatus as sample, ctx.contig, ctx.position, ctx.context, case when ({FRAGMENT}) % 2 = 0 then '+' else '-' end as strand, base,
    (cast(round(l_discount * 100) as int) + l_partkey) % 3 as kept
  from lineitem join ctx on l_partkey = p_partkey
), sites as (
  select sample, contig, position as start, position + 1 as "end", 'm,' || context || ',0' as modification, strand,
    cast(sum(case when kept = 0 then 1 else 0 end) as bigint) as meth, cast(count(*) as bigint) as total
  from sample_obs where context is not null and ((base = 'C' and strand = '+') or (base = 'G' and strand = '-'))
  group by all
)"""
)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methylation counts of six samples."""
    from ..operators.methylation import with_context

    ctx = with_context(reference(spark, sf_dir))
    rows = table(spark, sf_dir, "lineitem").join(ctx, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "concat(l_returnflag, l_linestatus) as sample",
        "contig",
        "position as start",
        "position + 1 as end",
        "concat('m,', context, ',0') as modification",
        f"case when ({FRAGMENT}) % 2 = 0 then '+' else '-' end as strand",
        "base",
        "context",
        "(cast(round(l_discount * 100) as int) + l_partkey) % 3 as kept",
    )
    rows = rows.where("context is not null and ((base = 'C' and strand = '+') or (base = 'G' and strand = '-'))")
    return rows.groupBy("sample", "contig", "start", "end", "modification", "strand").agg(F.sum(F.when(F.col("kept") == 0, 1).otherwise(0)).cast("bigint").alias("meth"), F.count("*").alias("total"))
