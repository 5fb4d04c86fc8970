"""Kept tables: what a change writes, what readers of older versions see, and writers that meet."""

import os

import pytest
from pyspark.sql import functions as F

from leafsieve.sources.bucketed import Conflict, Table

DDL = "archive string, name string, size bigint"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def pages(spark, books, per_book=5, size=1):
    return spark.range(books * per_book).select(F.concat(F.lit("b"), F.col("id") % books).alias("archive"), F.col("id").cast("string").alias("name"), F.lit(size).cast("long").alias("size"))


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t", DDL, "archive", 32)


def test_a_change_writes_its_buckets_only(spark, table, tmp_path):
    table.put(pages(spark, 1000))
    before, old = files(tmp_path), table.read()
    assert table.read().count() == 5000 and len(table.manifest().live) == 32
    changed = pages(spark, 1000, size=2).where("archive in ('b7', 'b77', 'b777')").limit(12)
    gone = spark.createDataFrame([("b5",), ("unknown",)], "archive string")
    touched = {r[0] for r in changed.select("archive").unionByName(gone).select(table.bucket(32)).distinct().collect()}
    made = table.put(changed, gone)
    after = files(tmp_path)
    assert made.number == 2 and {k: after[k] for k in before} == before
    new = set(after) - set(before)
    assert new and {int(f.split("bucket=")[1].split("/")[0]) for f in new} <= touched and len(touched) <= 5
    want = {(r.archive, r.name, r.size) for r in pages(spark, 1000).where("archive not in ('b5', 'b7', 'b77', 'b777')").collect()} | {tuple(r) for r in changed.collect()}
    kept = changed.select("archive").distinct().collect()
    want |= {tuple(r) for r in pages(spark, 1000).where("archive in ('b7', 'b77', 'b777')").collect() if r.archive not in {k.archive for k in kept}}
    assert {tuple(r) for r in table.read().collect()} == want
    # Who read the version before reads it still, and by its number.
    assert old.count() == 5000 and table.read(1).count() == 5000
    assert table.vacuum(keep=1) == len(touched)
    assert {tuple(r) for r in table.read().collect()} == want
    assert not any("version=1-" in f and int(f.split("bucket=")[1].split("/")[0]) in touched for f in files(tmp_path))


def test_nothing_to_do_and_emptied_buckets(spark, table):
    assert table.read().count() == 0 and table.put(pages(spark, 0)).number == 0
    table.put(pages(spark, 3))
    assert table.put(spark.createDataFrame([], DDL)).number == 1
    table.put(spark.createDataFrame([], DDL), pages(spark, 3).select("archive"))
    assert table.read().count() == 0 and table.manifest().live == {} and table.read(1).count() == 15


def test_null_keys_repeated_rows_and_overwrite(spark, table):
    rows = spark.createDataFrame([(None, "a", 1), (None, "a", 1), ("x", None, None)], DDL)
    table.put(rows)
    assert table.read().count() == 3
    table.put(spark.createDataFrame([(None, "b", 2)], DDL))
    assert sorted(map(str, table.read().collect())) == sorted(map(str, spark.createDataFrame([(None, "b", 2), ("x", None, None)], DDL).collect()))
    table.overwrite(table.read().withColumn("size", F.lit(9).cast("long")))
    assert {r.size for r in table.read().collect()} == {9}
    table.put(pages(spark, 40))
    table.rebucket(4)
    assert table.manifest().buckets == 4 and table.read().count() == 202
    table.put(spark.createDataFrame([("b1", "new", 3)], DDL))
    assert table.read().where("archive = 'b1'").count() == 1 and table.read().count() == 198


def test_writers_that_meet(spark, table, tmp_path, monkeypatch):
    """Another writer commits between reading and committing: its rows are not lost."""
    table.put(pages(spark, 4))
    other, write, met = Table(spark, table.path, DDL, "archive"), Table._write, []

    def slow(self, rows, version, buckets):
        out = write(self, rows, version, buckets)
        if self is table and not met:
            met.append(other.put(spark.createDataFrame([("b1", "theirs", 7)], DDL)))
        return out

    monkeypatch.setattr(Table, "_write", slow)
    table.put(spark.createDataFrame([("b2", "ours", 8)], DDL))
    rows = {r.archive: r.name for r in table.read().where("size > 1").collect()}
    assert rows == {"b1": "theirs", "b2": "ours"} and table.manifest().number == 3
    monkeypatch.setattr(Table, "_commit", lambda self, manifest: False)
    with pytest.raises(Conflict):
        table.put(spark.createDataFrame([("b3", "never", 8)], DDL))
    assert table.read().where("name = 'never'").count() == 0


def test_runs_that_died(spark, table, tmp_path):
    """Files without a manifest are not read; a claim without one is void after a time."""
    table.put(pages(spark, 4))
    table._write(spark.createDataFrame([("b1", "half", 7)], DDL), "2-dead", 32)
    assert table.read().where("name = 'half'").count() == 0
    claim = tmp_path / "t" / "manifest" / "000000002.claim"
    claim.write_text("")
    with pytest.raises(Conflict):
        table.put(spark.createDataFrame([("b1", "early", 7)], DDL))
    os.utime(claim, (1, 1))
    table.put(spark.createDataFrame([("b1", "late", 7)], DDL))
    assert table.read().where("archive = 'b1'").count() == 1 and table.manifest().number == 2
    assert table.vacuum() > 0 and not list((tmp_path / "t" / "data").glob("*/kept_version=2-dead"))


def test_columns_of_any_other_name(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/n", "archive string, version string, bucket bigint", "archive")
    table.put(spark.createDataFrame([("a", "v1", 7)], "archive string, version string, bucket bigint"))
    assert [tuple(r) for r in table.read().collect()] == [("a", "v1", 7)]
    with pytest.raises(ValueError):
        Table(spark, f"file://{tmp_path}/n", "archive string, kept_version string", "archive")
