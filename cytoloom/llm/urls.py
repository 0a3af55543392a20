"""URL filters by host-suffix and path-prefix expressions.

A URL is expanded into its host suffixes, at label borders up to the rules' greatest number of labels, and
each suffix that is a rule's host into path prefixes, of the lengths that this host's rules have; so a URL
costs a row a suffix, whatever the number of rules. Hosts and then whole expressions are equi-joined to the
rules on a short hash prefix, the full SHA-256 digest then confirms the match, and the longest rule wins
(of equal length: longer host, then block). All built-in functions.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the default
verdict; repeated rows are kept as often as they came; a null id is kept; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import size_checked

#: Rules (verdict, host, path) of the registered query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Bytes of the digest that the join uses, and the verdict where no rule fits.
PREFIX_HEX, DEFAULT = 8, "allow"
#: Rules up to this number are broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url):
    """After the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    return rows.select("verdict", "host", "path", _digest(F.col("host"), F.col("path")).alias("digest"))


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\u0000"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Id, ``host``, ``path``, ``rule`` and ``verdict`` of each row; ``rules`` as from ``rule_table``."""
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels")).first()["labels"] or 0
    hosts = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    hosts = hosts.select(F.sha2(F.col("host").cast("binary"), 256).alias("hdigest"), "lengths").withColumn("hshort", F.substring("hdigest", 1, PREFIX_HEX))
    # equal rows meet once and are counted, so that a hot url costs one row a task
    rows = pages.groupBy(F.col(id_col).alias("id"), F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("id", "url", "n", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.least(F.lit(max(1, labels)), F.size(parts))), lambda k: F.array_join(F.slice(parts, -k, k), ".")))
    ends = rows.select("id", "url", "n", "host", "path", F.explode_outer(suffixes).alias("h")).withColumn("hfull", F.sha2(F.col("h").cast("binary"), 256))
    ends = ends.join(size_checked(hosts, BROADCAST_RULES), (F.substring("hfull", 1, PREFIX_HEX) == F.col("hshort")) & (F.col("hfull") == F.col("hdigest")), "left")
    prefixes = F.transform(F.filter("lengths", lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    exprs = ends.select("id", "url", "n", "host", "path", "h", F.explode_outer(prefixes).alias("p"))
    # what fits no rule's host gets a digest that no rule has, not a null, so that such rows are dealt evenly
    exprs = exprs.withColumn("full", _digest(F.coalesce("h", F.lit("")), F.coalesce("p", F.concat(F.lit("\u0001"), F.coalesce("url", F.lit(""))))))
    keyed = size_checked(rules.select(F.substring("digest", 1, PREFIX_HEX).alias("short"), "digest", "verdict", F.col("host").alias("rh"), F.col("path").alias("rp")), BROADCAST_RULES)
    hit = exprs.join(keyed, (F.substring("full", 1, PREFIX_HEX) == F.col("short")) & (F.col("full") == F.col("digest")), "left")
    order = F.struct((F.length("rh") + F.length("rp")).alias("l"), F.length("rh").alias("h"), (F.col("verdict") == "block").alias("b"), F.concat("rh", "rp").alias("rule"), F.col("verdict").alias("v"))
    best = hit.groupBy("id", "url", "n", "host", "path").agg(F.max(F.when(F.col("rh").isNotNull(), order)).alias("best"))
    out = best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return out.drop("copy")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP8_SQL = """
with u as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from u
), r(verdict, rh, rp) as (
  values ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')
), m as (
  select h.*, (
    select max({'l': length(rh) + length(rp), 'h': length(rh), 'b': r.verdict = 'block', 'rule': rh || rp, 'v': r.verdict})
    from r where (h.host = rh or ends_with(h.host, '.' || rh)) and starts_with(h.path, rp)) as best
  from h
)
select page_id, host, path, best['rule'] as rule, coalesce(best['v'], 'allow') as verdict from m
"""
