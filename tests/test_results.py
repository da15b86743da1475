"""Result tables: dead writers, retries, writers at the same time, generations."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from procmon.session import scratch_path
from procmon.sources import results as R


def rows(spark, lo, hi, **extra):
    df = spark.range(lo, hi).select("id", (F.col("id") % 3).cast("string").alias("method"))
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def ids(spark, path):
    return sorted(r["id"] for r in R.read(spark, path).collect())


def test_a_dead_writer_leaves_no_row_and_a_retry_one(spark):
    path = scratch_path(spark, "results")
    with pytest.raises(ValueError):
        R.read(spark, path)
    R.stage(rows(spark, 0, 10), path, ["method"])  # dies before its commit
    with pytest.raises(ValueError):
        R.read(spark, path)
    assert R.write(rows(spark, 0, 10), path, "a", partition_by=["method"])
    assert not R.write(rows(spark, 0, 10), path, "a", partition_by=["method"])
    R.stage(rows(spark, 50, 60), path)  # dies too
    assert ids(spark, path) == list(range(10))
    assert R.read(spark, path).columns == ["id", "method"]
    assert dict(R.read(spark, path).dtypes)["method"] == "string"


def test_two_attempts_of_a_run_count_once(spark):
    path = scratch_path(spark, "results")
    one, two = R.stage(rows(spark, 0, 5), path), R.stage(rows(spark, 0, 5), path)
    R.commit(spark, path, "a", one)
    R.commit(spark, path, "a", two)
    R.commit(spark, path, "a", one)  # a commit that is sent again
    assert ids(spark, path) == list(range(5))
    assert R.manifest(spark, path).count() == 1


def test_writers_at_the_same_time_lose_nothing(spark):
    path = scratch_path(spark, "results")
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda i: R.write(rows(spark, 10 * (i % 6), 10 * (i % 6) + 10), path, f"run {i % 6}"), range(12)))
    assert sum(done) >= 6
    assert ids(spark, path) == list(range(60))
    named = R.read(spark, path, "run").groupBy("run").count().collect()
    assert sorted((r["run"], r["count"]) for r in named) == [(f"run {i}", 10) for i in range(6)]


def test_generations_replace_and_vacuum_keeps_what_counts(spark):
    path = scratch_path(spark, "results")
    R.write(rows(spark, 0, 4), path, "a")
    R.write(rows(spark, 10, 14), path, "b")
    assert R.write(rows(spark, 20, 23), path, "a", generation=1)
    assert not R.write(rows(spark, 0, 4), path, "a")  # a late retry of the first
    lost = R.stage(rows(spark, 90, 99), path)
    want = [10, 11, 12, 13, 20, 21, 22]
    assert ids(spark, path) == want
    assert R.vacuum(spark, path) == []  # all too young
    gone = R.vacuum(spark, path, older_than=-60)
    assert len(gone) == 2 and lost.attempt in gone
    assert ids(spark, path) == want


def test_empty_runs_other_columns_and_clashes(spark, monkeypatch):
    path = scratch_path(spark, "results")
    assert R.write(rows(spark, 0, 0), path, "none", partition_by=["method"])
    assert not R.write(rows(spark, 0, 3), path, "none")
    assert ids(spark, path) == [] and R.read(spark, path, "run").columns == ["id", "method", "run"]
    R.write(rows(spark, 0, 3, score=0.5), path, "scored")
    R.write(rows(spark, 5, 6), path, "plain 'quoted' ü")
    got = sorted((r["id"], r["score"], r["run"]) for r in R.read(spark, path, "run").collect())
    assert got == [(0, 0.5, "scored"), (1, 0.5, "scored"), (2, 0.5, "scored"), (5, None, "plain 'quoted' ü")]
    monkeypatch.setattr(R, "PRUNED_RUNS", 1)  # more runs than a literal filter takes
    assert ids(spark, path) == [0, 1, 2, 5] and R.read(spark, path, "run").count() == 4
    with pytest.raises(ValueError, match="named"):
        R.read(spark, path, "method")
    R.write(rows(spark, 7, 8, score="x"), path, "text")
    with pytest.raises(ValueError, match="score"):
        R.read(spark, path)
