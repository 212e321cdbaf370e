"""Loading: ids that stay, partitions replaced whole, vectors for new texts alone, jobs that go on where they stopped."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.plans.registry import query
from sedimenta.plans.storage import Kept, shared_folder

c = F.col
#: Times that a job which broke off is taken up again, and width of a hashed vector.
RESUMES, DIMENSIONS = 2, 64


def numbered(rows: DataFrame, keys: list[str], column: str, after: int, kept: Kept) -> DataFrame:
    """Adds after + 1, after + 2, ... in order of keys: a sort by ranges, then each row's place in its partition after the sizes of those
    before. Equal for equal rows, however often and on whatever partitions it runs. Keys are unique."""
    at = F.monotonically_increasing_id()
    placed = rows.orderBy(*keys).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    placed = kept.write(placed, "numbered")
    bases, n = [], after + 1
    for part, size in sorted((r[0], r[1]) for r in placed.groupBy("_part").count().collect()):  # a row for each partition
        bases.append((part, n))
        n += size
    base = rows.sparkSession.createDataFrame(bases, "_part long, _base long")
    return placed.join(F.broadcast(base), "_part").withColumn(column, c("_base") + c("_at")).drop("_part", "_at", "_base")


def upsert_returning(table: DataFrame, incoming: DataFrame, keys: list[str], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(table after, returned): rows of `incoming` (one for each key) replace those of their key and keep its id; new keys get the next ids, without
    gaps, in order of keys. returned has the keys, the id and is_new of each incoming row. A batch that is repeated changes nothing."""
    kept = Kept(table.sparkSession, "upsert")
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]
    ids = table.select(*keys, id_col)
    known = incoming.join(ids, keys, "left_semi").join(ids, keys)
    fresh = numbered(incoming.join(ids, keys, "left_anti"), keys, id_col, top, kept)
    every = kept.write(known.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True))), "result")
    kept.drop(but="result")
    after = table.join(incoming.select(*keys), keys, "left_anti").select(table.columns).unionByName(every.select(table.columns))
    return after, every.select(*keys, id_col, "is_new")


def replace_partitions(rows: DataFrame, folder: str, by: str) -> None:
    """Writes rows in place of the partitions of `by` that they have; other partitions stay. Spark puts the new files in place when all tasks are
    through, so a write that fails leaves what was there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


def hashed_vector(rows: DataFrame, key: str, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, bucket, weight): counts of a text's letter words by hash, of length 1. dimensions is a power of 2, 256 at most."""
    words = rows.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    bucket = F.conv(F.substring(F.md5("word"), 31, 2), 16, 10).cast("int") % dimensions
    counts = words.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    size = counts.groupBy(key).agg(F.sqrt(F.sum((c("n") * c("n")).cast("double"))).alias("size"))
    return counts.join(size, key).select(key, "bucket", (c("n") / c("size")).alias("weight"))


def embed_new(stored: DataFrame, rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(vectors of texts that weren't stored, rows with their hash): each new text is worked out once, however many rows have it. stored has the
    column hash."""
    tagged = rows.withColumn("hash", F.sha1(c(text)))
    new = tagged.select("hash", text).dropDuplicates(["hash"]).join(stored.select("hash").distinct(), "hash", "left_anti")
    return hashed_vector(new, "hash", c(text)), tagged


class State(NamedTuple):
    """A job's record. status: running, ready or failed."""

    status: str
    done: int
    total: int
    resumes: int
    error: str | None


class Job:
    """Work in numbered batches that goes on where it stopped.

    A batch's rows go to a folder of their own attempt; then a manifest that names the attempt is put in place in one step, and only rows that a
    manifest names are read. So a batch counts once, whole or not at all, whatever was lost before. A job found running was broken off:
    it is taken up again RESUMES times, then it has failed."""

    def __init__(self, spark: SparkSession, folder: str, batches: int, resumes: int = RESUMES):
        self.spark, self.folder, self.batches, self.resumes = spark, folder.rstrip("/"), batches, resumes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, name: str, value: dict, again: bool = False) -> bool:
        """Puts a small file in place by a rename; False if it is there and not to be replaced."""
        part, at = self._path(f"{self.folder}/.{name.replace('/', '-')}-{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if again:
            self._fs.delete(at, False)
        won = not self._fs.exists(at) and self._fs.rename(part, at)
        if not won:
            self._fs.delete(part, False)
        return won

    def _read(self, name: str) -> dict | None:
        rows = self.spark.read.text(f"{self.folder}/{name}", wholetext=True).collect() if self._fs.exists(self._path(f"{self.folder}/{name}")) else []
        return json.loads(rows[0].value) if rows else None

    def manifests(self) -> dict[int, dict]:
        """Committed batches: number to attempt and rows."""
        found = self._fs.globStatus(self._path(f"{self.folder}/manifests/*.json")) or ()
        names = [f.getPath().getName() for f in found]
        return {int(n.removesuffix(".json")): self._read(f"manifests/{n}") for n in names}

    def state(self) -> State | None:
        s = self._read("state.json")
        return State(**s) if s else None

    def _say(self, **new) -> State:
        s = (self.state() or State("running", 0, self.batches, 0, None))._replace(**new)
        self._put("state.json", s._asdict(), again=True)
        return s

    def run(self, work: Callable[[int], DataFrame]) -> State:
        """Commits work(n) of each batch that has no manifest. An error marks the job failed with its message and is raised; a job that
        was broken off without one goes on."""
        before = self.state()
        if before and before.status == "running":
            if before.resumes >= self.resumes:
                return self._say(status="failed", error=f"broken off {self.resumes + 1} times")
            self._say(resumes=before.resumes + 1)
        elif before and before.status == "ready":
            return before
        else:
            self._say(status="running", resumes=0, error=None)
        done = self.manifests()
        try:
            for n in range(self.batches):
                if n not in done:
                    attempt = f"batch={n}/attempt={uuid.uuid4().hex}"
                    work(n).write.parquet(f"{self.folder}/data/{attempt}")
                    rows = self.spark.read.parquet(f"{self.folder}/data/{attempt}").count()
                    self._put(f"manifests/{n}.json", {"attempt": attempt, "rows": rows})
                    done = self.manifests()
                    self._say(done=len(done))
        except Exception as e:
            self._say(status="failed", error=str(e)[:2000])
            raise
        return self._say(status="ready", done=len(done))

    def result(self) -> DataFrame:
        """Rows of the committed batches."""
        paths = [f"{self.folder}/data/{m['attempt']}" for m in self.manifests().values()]
        return self.spark.read.parquet(*paths)


@query("k06_upsert_ids", """WITH old AS (SELECT o_orderkey AS id, concat('f', o_orderkey) AS path, o_totalprice AS size FROM orders WHERE o_orderkey % 3 = 0),
new AS (SELECT concat('f', o_orderkey) AS path, o_totalprice + 1 AS size FROM orders WHERE o_orderkey % 2 = 0),
ids AS (SELECT new.path, new.size, coalesce(old.id, (SELECT max(id) FROM old) + row_number() OVER (PARTITION BY old.id IS NULL ORDER BY new.path)) AS id, old.id IS NULL AS is_new FROM new LEFT JOIN old USING (path))
SELECT path, size, CAST(id AS BIGINT) AS id, is_new FROM ids UNION ALL SELECT path, size, id, NULL FROM old WHERE path NOT IN (SELECT path FROM new)""")
def k06(t):
    """Orders as files: some are there, some of these come again with others that are new."""
    own = lambda where, size: t.orders.filter(where).select(F.concat(F.lit("f"), c("o_orderkey")).alias("path"), size.alias("size"), c("o_orderkey").alias("id"))
    after, returned = upsert_returning(own("o_orderkey % 3 = 0", c("o_totalprice")), own("o_orderkey % 2 = 0", c("o_totalprice") + 1).drop("id"), ["path"])
    return after.join(returned.select("path", "is_new"), "path", "left")


@query("k01_bulk_load", """SELECT o_orderstatus AS part, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS fresh FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0 GROUP BY 1""")
def k01(t):
    """All orders are loaded by status, then one status is loaded anew."""
    folder = f"{shared_folder(t.spark)}/load-{uuid.uuid4().hex}"
    rows = t.orders.select("o_orderkey", c("o_orderstatus").alias("part"))
    replace_partitions(rows.withColumn("fresh", F.lit(0)), folder, "part")
    replace_partitions(rows.filter("part = 'F' and o_orderkey % 2 = 0").withColumn("fresh", F.lit(1)), folder, "part")
    return t.spark.read.parquet(folder).groupBy("part").agg(F.count("*").alias("n"), F.sum("fresh").alias("fresh"))


@query("k11_embed_new", """WITH d AS (SELECT doc_id, text, sha1(text) AS hash FROM documents), new AS (SELECT hash, any_value(text) AS text FROM d WHERE doc_id % 2 = 1 AND hash NOT IN (SELECT hash FROM d WHERE doc_id % 2 = 0) GROUP BY hash),
w AS (SELECT hash, CAST('0x' || right(md5(word), 2) AS INT) % 64 AS bucket, count(*) AS n FROM (SELECT hash, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM new) GROUP BY 1, 2)
SELECT hash, bucket, n / sqrt(sum(CAST(n * n AS DOUBLE)) OVER (PARTITION BY hash)) AS weight FROM w""")
def k11(t):
    """Vectors of the texts that only documents with odd ids have."""
    d = t.documents.select("doc_id", "text")
    old = d.filter("doc_id % 2 = 0").select(F.sha1("text").alias("hash"))
    return embed_new(old, d.filter("doc_id % 2 = 1"), "text")[0]


@query("k17_resumed_job", "SELECT o_orderpriority AS priority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1")
def k17(t):
    """Orders in eight batches by a job that breaks off after three and is taken up again."""
    folder = f"{shared_folder(t.spark)}/job-{uuid.uuid4().hex}"
    work = lambda n: t.orders.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(8)) == n).select(c("o_orderpriority").alias("priority"), "o_totalprice")

    def breaks(n: int) -> DataFrame:
        if n == 3:
            raise KeyboardInterrupt
        return work(n)

    job = Job(t.spark, folder, 8)
    try:
        job.run(breaks)
    except KeyboardInterrupt:
        job.run(work)
    return job.result().groupBy("priority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
