"""Steps of iterative operators, written to the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and Spark runs on this machine alone, a folder of the application's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sedimenta-steps-")
    return _own[app]


class Kept:
    """Tables of one call. A written step cuts the lineage, so a lost executor costs the step that runs and not those before it."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}-{tag}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: str = "") -> None:
        """Deletes the steps, all but those whose tag is `but`."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(at) or ():
            if not but or not found.getPath().getName().endswith(f"-{but}"):
                fs.delete(found.getPath(), True)
