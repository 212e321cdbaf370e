"""Streams that keep a store current: upserts by micro-batch, chunks by content hash, and a limit on failed logins.

Each batch writes a new version of the table under its batch's number, so a batch that runs again after a failure replaces
its own version and nothing else."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimenta.operators.incremental import upsert
from sedimenta.plans.registry import query

c = F.col
# Failures of one account that block it, and the seconds for which a failure counts.
MAX_FAILURES = 8
FAILURE_WINDOW = 15 * 60


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions of a table, ascending."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(path)]
    return sorted(int(m[1]) for p, n in names if (m := re.fullmatch(r"version=(\d+)", n)) and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest below `before`; None if there is none."""
    own = [v for v in versions(spark, folder) if before is None or v < before]
    return spark.read.parquet(f"{folder}/version={own[-1]}") if own else None


def newest(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the one with the greatest `order`; other columns decide ties."""
    rest = [x for x in batch.columns if x not in (*keys, order)]
    top = batch.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("__r"))
    return top.select(*keys, "__r.*").select(*batch.columns)


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Merges a stream of rows into the table at `folder`, one version a batch, until the input at hand is used up. Nothing is
    deleted; the checkpoint lets a stopped run go on."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = newest(batch, keys, order)
        old = current(spark, folder, before=number)
        update = [x for x in rows.columns if x not in keys]
        (rows if old is None else upsert(old, rows, keys, update)).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_content(stream: DataFrame, text: str, when: str, late: str = "1 day") -> DataFrame:
    """Rows whose text hash no earlier row within `late` had: only those need to be embedded again."""
    return stream.withColumn("hash", F.sha2(text, 256)).withWatermark(when, late).dropDuplicatesWithinWatermark(["hash"])


def blocked_windows(failures: DataFrame, who: str, when: str, late: str = "5 minutes") -> DataFrame:
    """Sliding windows, one a minute, in which an account failed at least MAX_FAILURES times; for streams and tables."""
    span = F.window(when, f"{FAILURE_WINDOW} seconds", "60 seconds")
    return failures.withWatermark(when, late).groupBy(span.alias("w"), who).agg(F.count("*").alias("failures")).filter(c("failures") >= MAX_FAILURES).select(who, c("w.start"), c("w.end"), "failures")


def throttled(events: DataFrame, who: str, when: str, failed, seconds: int = FAILURE_WINDOW, most: int = MAX_FAILURES) -> DataFrame:
    """Each row with how many of the account's failures lie less than `seconds` before it, and whether that blocks it. Failures
    of the same moment don't count for each other."""
    micros = F.unix_micros(c(when).cast("timestamp"))
    w = Window.partitionBy(who).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), -1)
    n = F.count_if(failed).over(w)
    return events.withColumn("recent", n).withColumn("blocked", n >= most)


@query("st_login_throttle", """SELECT event_id, count(*) FILTER (WHERE event_type = 'error') OVER w AS recent, (count(*) FILTER (WHERE event_type = 'error') OVER w) >= 2 AS blocked
FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604799999999 PRECEDING AND 1 PRECEDING)""")
def st_login_throttle(t):
    return throttled(t.events, "user_id", "ts", c("event_type") == "error", 7 * 86_400, 2).select("event_id", "recent", "blocked")
