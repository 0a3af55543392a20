"""Stored tables: few files, and damage is noticed."""

import os

import pytest

from cytoloom.llm.scratch import discard, stored


def _files(df):
    folder = df._scratch.removeprefix("file://")
    return {f: os.path.join(folder, f) for f in os.listdir(folder)}


def test_a_stored_table_is_its_part_files_alone(spark):
    got = stored(spark.range(1000).repartition(3).selectExpr("id", "cast(id as string) s"), "test")
    assert got.count() == 1000 and {r.id for r in got.collect()} == set(range(1000))
    # a checksum or marker beside them would be a process each, in an executor or the driver
    assert len(_files(got)) == 3 and all(f.startswith("part-") for f in _files(got))
    none = stored(spark.range(0), "test")
    assert none.count() == 0 and none.columns == ["id"]
    discard(got, none)


def test_damage_to_a_stored_table_is_an_error(spark):
    got = stored(spark.range(5000).repartition(1).selectExpr("md5(cast(id as string)) s"), "test")
    (path,) = _files(got).values()
    with open(path, "r+b") as f:
        f.seek(5000)
        x = f.read(8)
        f.seek(5000)
        f.write(bytes(255 - b for b in x))
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        got.selectExpr("sum(hash(s))").collect()
    discard(got)
