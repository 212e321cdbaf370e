"""Ids, replaced partitions, vectors of new texts, and jobs that break off."""

import math

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import loading as L


def test_ids_stay_and_new_ones_follow(spark):
    table = spark.createDataFrame([(7, "b", 1), (3, "a", 1)], "id long, path string, size int")
    new = spark.createDataFrame([("b", 2), ("z", 2), ("c", 2), ("é", 2)], "path string, size int")
    after, returned = L.upsert_returning(table, new, ["path"])
    assert {tuple(r) for r in after.collect()} == {(3, "a", 1), (7, "b", 2), (8, "c", 2), (9, "z", 2), (10, "é", 2)}
    assert {tuple(r) for r in returned.collect()} == {("b", 7, False), ("c", 8, True), ("z", 9, True), ("é", 10, True)}
    again, told = L.upsert_returning(after, new.repartition(7), ["path"])
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in after.collect()} and not told.filter("is_new").count()
    first, _ = L.upsert_returning(table.limit(0), new.repartition(3), ["path"])
    assert {(r.path, r.id) for r in first.collect()} == {("b", 1), ("c", 2), ("z", 3), ("é", 4)}
    many = spark.range(0, 5000, 1, 9).select(F.format_string("%05d", "id").alias("path"), F.lit(0).alias("size"))
    got = L.upsert_returning(table, many, ["path"])[1]
    assert got.filter("id <> cast(path as int) + 8").count() == 0 and got.count() == 5000


def test_a_killed_batch_is_repeated(spark):
    """The table wasn't replaced when the batch was lost: its repetition gives the same ids."""
    table = spark.createDataFrame([(1, "a", 0)], "id long, path string, size int")
    new = spark.createDataFrame([(f"p{k}", k) for k in range(50)], "path string, size int")
    lost = {tuple(r) for r in L.upsert_returning(table, new, ["path"])[0].collect()}
    assert {tuple(r) for r in L.upsert_returning(table, new.repartition(11), ["path"])[0].collect()} == lost


def test_other_partitions_stay(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "v int, repo string")
    L.replace_partitions(rows, str(tmp_path / "t"), "repo")
    L.replace_partitions(rows.filter("v = 2"), str(tmp_path / "t"), "repo")
    bad = rows.select(F.raise_error(F.lit("lost")).cast("int").alias("v"), "repo")
    with pytest.raises(Exception, match="lost"):
        L.replace_partitions(bad, str(tmp_path / "t"), "repo")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("v", "repo").collect()} == {(2, "x"), (3, "y")}


def test_vectors_of_new_texts(spark):
    stored = spark.createDataFrame([("x",)], "t string").select(F.sha1("t").alias("hash"))
    rows = spark.createDataFrame([(1, "x"), (2, "Two two one"), (3, "Two two one"), (4, None), (5, "123")], "id int, t string")
    vectors, tagged = L.embed_new(stored, rows, "t")
    got = vectors.collect()
    assert len({r.hash for r in got}) == 1 and tagged.count() == 5
    assert sum(r.weight**2 for r in got) == pytest.approx(1) and max(r.weight for r in got) == pytest.approx(2 / math.sqrt(5))


def test_job_goes_on_where_it_stopped(spark, tmp_path):
    ran, stop = [], [True]

    def work(n):
        ran.append(n)
        if n == 2 and stop[0]:
            # rows of the attempt are there, but its manifest isn't: as if the machine had gone
            spark.createDataFrame([(n, "half")], "n int, v string").write.parquet(f"{tmp_path}/job/data/batch={n}/attempt=lost")
            raise KeyboardInterrupt
        return spark.createDataFrame([(n, "whole")], "n int, v string")

    job = L.Job(spark, str(tmp_path / "job"), 5)
    with pytest.raises(KeyboardInterrupt):
        job.run(work)
    assert job.state() == L.State("running", 2, 5, 0, None)
    stop[0] = False
    assert L.Job(spark, str(tmp_path / "job"), 5).run(work) == L.State("ready", 5, 5, 1, None)
    assert ran == [0, 1, 2, 2, 3, 4] and {tuple(r) for r in job.result().collect()} == {(n, "whole") for n in range(5)}
    assert job.run(work).status == "ready" and len(ran) == 6


def test_job_gives_up(spark, tmp_path):
    def breaks(n):
        raise KeyboardInterrupt

    job = L.Job(spark, str(tmp_path / "job"), 1)
    for _ in range(3):
        with pytest.raises(KeyboardInterrupt):
            job.run(breaks)
    assert job.run(breaks) == L.State("failed", 0, 1, 2, "broken off 3 times")

    def fails(n):
        raise ValueError("bad rows")

    other = L.Job(spark, str(tmp_path / "other"), 1)
    with pytest.raises(ValueError):
        other.run(fails)
    assert other.state().status == "failed" and "bad rows" in other.state().error
    assert other.run(lambda n: spark.range(3).toDF("n")).status == "ready" and other.result().count() == 3
