"""Streams against the same work on a table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sedimenta.streaming import maintain as S

SCHEMA = "id long, stamp long, state string"


def test_upsert_stream_in_batches_and_again(spark, tmp_path):
    inbox, store, log = (str(tmp_path / x) for x in ("in", "store", "log"))

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
        S.upsert_stream(stream, store, log, ["id"], "stamp").awaitTermination(120)

    feed([(1, 1, "a"), (2, 1, "a"), (1, 2, "b")])
    run()
    feed([(2, 5, "c"), (3, 1, "a"), (None, 1, None)])
    run()
    run()  # nothing new: no version, no change
    assert S.versions(spark, store) == [0, 1]
    assert {tuple(r) for r in S.current(spark, store).collect()} >= {(1, 2, "b"), (2, 5, "c"), (3, 1, "a")}
    assert S.current(spark, store, before=0) is None


def test_new_content_and_blocked_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i % 2, start + timedelta(seconds=40 * i), f"t{i % 5}") for i in range(40)]
    d = spark.createDataFrame(rows, "who long, at timestamp, text string")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))

    def collected(df, name):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    assert collected(S.new_content(stream, "text", "at"), "fresh").count() == 5
    want = {tuple(r) for r in S.blocked_windows(d, "who", "at").collect()}
    got = {tuple(r) for r in collected(S.blocked_windows(stream, "who", "at"), "blocked").collect()}
    assert want and got <= want and {r for r in want if r[2] < start + timedelta(seconds=40 * 39 - 300)} <= got
    for who, a, b, n in want:
        assert n == sum(1 for w, t, _ in rows if w == who and a <= t < b) >= S.MAX_FAILURES


def test_throttle_against_plain_count(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 3, start + timedelta(seconds=i // 2 * 37), i % 4 != 0) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, who long, at timestamp, failed boolean")
    for r in S.throttled(d, "who", "at", F.col("failed")).collect():
        n = sum(1 for _, w, t, f in rows if f and w == r.who and 0 < (r.at - t).total_seconds() < S.FAILURE_WINDOW)
        assert (r.recent, r.blocked) == (n, n >= S.MAX_FAILURES)
