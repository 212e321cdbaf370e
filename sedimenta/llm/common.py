"""What the operators of this package share: reading, shared storage and clean-up."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into objects at a time. Spark itself bounds an Arrow batch by bytes (64 MB unless set otherwise).
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store that it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the workers, which may not have it installed; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).parents[1]
        path = f"{tempfile.mkdtemp(prefix='sedimenta-code-')}/{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)


def mapped(df: DataFrame, run, schema, rows: int = ARROW_ROWS) -> DataFrame:
    """df.mapInArrow(run, schema) with this package at hand on every worker, in batches of `rows` rows at most."""
    ship(df.sparkSession)

    def sliced(batches):
        return run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.mapInArrow(sliced, schema)


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where that is unset, one of our own for each application, if all
    of Spark runs on this machine; on a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own_dirs.get(sc.applicationId) or _own_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="sedimenta-"))
    return path.rstrip("/")


_kept: dict[str, list[str]] = {}


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: lineage ends there, and a lost
    executor costs no more than the stage that was running. The folder stays until discard()."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _kept.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return _written(df, path)


def discard(spark: SparkSession) -> None:
    """Deletes the folders of all stored() steps of this application. Frames that read them, such as an operator's result that
    isn't written yet, can't be used any longer."""
    for path in _kept.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


#: Tasks for each core that write a step at most. Spark runs the partitions of such a task one after the other, so that its memory stays
#: that of one partition, and an iterative operator doesn't leave thousands of small files.
TASKS = 4


class Steps:
    """Intermediate tables of one call, in a folder of their own in the shared folder; dropped when no frame needs them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.dir, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        return _written(df.coalesce(TASKS * self.spark.sparkContext.defaultParallelism), f"{self.dir}/{self.n}-{tag}")

    def drop(self, *tags: str) -> None:
        """Deletes the tables kept under these tags so far, or all, and the shuffle files that led to them."""
        for tag in tags:
            _delete(self.spark, f"{self.dir}/*-{tag}")
        if not tags:
            _delete(self.spark, self.dir)
        release(self.spark)


#: Bytes of an Arrow batch in steps that this package writes itself; results follow the session.
ARROW_BYTES = "8m"


def _written(df: DataFrame, path: str) -> DataFrame:
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, ARROW_BYTES)
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(at) or ():
        fs.delete(found.getPath(), True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps."""
    spark.sparkContext._jvm.System.gc()


#: A key with this part of all rows counts as hot, so there are at most SHARE of them; its rows are dealt over SALTS tasks.
SHARE, SALTS = 256, 64


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """Values of the rows of (key, n) that hold at least 1 / SHARE of the sum of n: SHARE of them at most."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.filter((F.col(n) > 1) & (F.col(n) * SHARE >= total)).select(key).collect()]


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], on: str, hot: list, by: list[str], how: str = "inner") -> DataFrame:
    """Joins on `keys`. Rows whose key column `on` is hot are dealt by a hash of the columns `by`, and the small side, which
    has few rows of such keys, is there in each of their tasks."""
    if not hot:
        return big.join(small, keys, how)
    is_hot, (salt,) = F.col(on).isin(hot), fresh(big.join(small, keys), "salt")
    dealt = big.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = small.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of the frame's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(col: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(key, id, text, rest): key is a long of its own for each row, in order of id (null first), then text.
    It is the id itself where ids are whole numbers, all different and none null; otherwise rows are sorted once, and a row's
    key is the place of its partition and its place therein. rest holds the other columns, if carry."""
    rest = [F.col(f"`{c}`") for c in docs.columns if carry and c not in (id_col, text_col)]
    (pad,) = fresh(docs, "pad")
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*rest, F.lit(0).alias(pad)).alias("rest"))
    whole = d.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and not d.groupBy("id").count().filter("count > 1 or id is null").limit(1).count():
        return d.select(F.col("id").cast("long").alias("key"), "id", "text", "rest")
    return stored(d.orderBy(F.col("id").asc_nulls_first(), "text").select(F.monotonically_increasing_id().alias("key"), "*"), "keyed")
