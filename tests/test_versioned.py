import random

import pytest
from pyspark.sql import functions as F

from factloom.sources.versioned import VersionConflict, VersionedTable

SCHEMA = "id long, name string, n int"


def rows(df):
    return {r["id"]: (r["name"], r["n"]) for r in df.collect()}


@pytest.fixture
def held(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.create(spark.createDataFrame([(i, f"a{i}", i) for i in range(50)], SCHEMA), "id", buckets=8) == 0
    return t


def test_history_matches_a_plain_one(spark, held):
    rng = random.Random(6)
    now, past = {i: (f"a{i}", i) for i in range(50)}, []
    for step in range(4):
        past.append(dict(now))
        changes = {i: (f"s{step}", rng.randrange(99)) for i in rng.sample(range(80), 15)}
        gone = {i for i in changes if rng.random() < 0.4}
        v = held.merge(spark.createDataFrame([(i, *c, i in gone) for i, c in changes.items()], SCHEMA + ", gone boolean"), deleted=F.col("gone"))
        now = {i: c for i, c in {**now, **changes}.items() if i not in gone}
        assert v == step + 1 and rows(held.snapshot()) == now
    assert held.compact() == 5 and rows(held.snapshot()) == now and not held.manifest().changes
    assert [rows(held.snapshot(v)) for v in range(4)] == past
    assert rows(held.lookup([1, 2, 77, 500])) == {i: now[i] for i in (1, 2, 77) if i in now}
    assert held.expire(keep=1) and rows(held.snapshot()) == now and held.versions() == [5]


def test_lookup_reads_its_buckets_only(held):
    plan = held.lookup([3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_writer_that_dies_leaves_the_old_snapshot(spark, held):
    before = rows(held.snapshot())
    bad = spark.createDataFrame([(i, "new", 1) for i in range(60)], SCHEMA).withColumn("name", F.when(F.col("id") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        held.merge(bad)
    held._fs.create(held._file(f"{held.path}/manifests/{7:012d}.json"), False).close()  # a manifest cut short
    assert rows(held.snapshot()) == before and held.manifest().version == 0
    assert held.merge(spark.createDataFrame([(1, "b", 2)], SCHEMA)) == 8 and rows(held.snapshot()) == before | {1: ("b", 2)}


def test_two_writers_of_a_version_conflict(spark, held):
    other = VersionedTable(spark, held.path)
    other._next = lambda: 1  # looked before the first writer committed
    held.merge(spark.createDataFrame([(1, "first", 1)], SCHEMA))
    with pytest.raises(VersionConflict):
        other.merge(spark.createDataFrame([(1, "second", 2)], SCHEMA))
    assert rows(held.snapshot())[1] == ("first", 1)


def test_readers_keep_their_version(spark, held):
    before = held.snapshot()
    held.merge(spark.createDataFrame([(1, "later", 1)], SCHEMA))
    held.compact()
    assert rows(before)[1] == ("a1", 1)


def test_repeated_and_null_keys(spark, held):
    twice = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], SCHEMA)
    with pytest.raises(Exception, match="repeated id"):
        held.merge(twice)
    held.merge(twice, order="n")
    assert rows(held.snapshot())[1] == ("y", 2)
    with pytest.raises(Exception, match="null id"):
        held.merge(spark.createDataFrame([(None, "x", 1)], SCHEMA))
    assert held.merge(spark.createDataFrame([], SCHEMA)) == 2 and len(rows(held.snapshot())) == 50
