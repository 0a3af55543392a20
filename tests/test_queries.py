"""Every registered query with SQL gives that SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not there")
SQL = entry.oracle_sql()
SOME = ["call_meth_cgmap", "call_meth_bed", "overlap_collapse", "snp_candidates", "snp_ad_iad", "combine_level", "combine_count", "interval_merge", "region_clip", "candidate_votes", "pair_band_join", "origin_status", "mapq_se", "mapq_pe", "pr_curve", "cgmap_parse"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_names_agree():
    assert set(SQL) <= set(entry.queries())
    assert set(SOME) <= set(SQL)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(SQL[name])
    cols = [x[0] for x in cur.description]
    want = sorted(tuple(show(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_partitions_do_not_matter(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, entry.queries()["joint_calls"](spark, SF).collect())))
        spark.catalog.clearCache()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert rows[0] == rows[1] == rows[2]


def test_running_counts_end_as_the_batch(spark, tmp_path):
    from cytoloom.operators.methylation import site_counts
    from cytoloom.plans import virtual
    from cytoloom.streaming import methylation

    obs = virtual.observations(spark, SF)
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def sink(df, _):
        for r in df.collect():
            seen[r.contig, r.position, r.strand, r.context] = tuple(r)

    methylation.start(stream, sink, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(str, seen.values())) == sorted(str(tuple(r)) for r in site_counts(obs).collect())
