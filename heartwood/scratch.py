"""Tables in the folder that driver and executors share.

Loops and operators that read a result several times write it there, which cuts lineage
and survives the loss of an executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, a new one if driver
    and executors are one process, else an error: hosts don't share a local folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="heartwood-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get()


class Scratch:
    """Tables written to the shared folder. ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.top = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, rows: int | None = None, per_file: int = 32_768) -> DataFrame:
        """``rows``: about how many there will be, where that is known; a small table then
        makes few files, whatever the number of shuffle partitions. It is dealt out to them
        by one more exchange, so what makes the rows keeps its own partitions."""
        if rows is not None and 2 * (files := max(1, -(-rows // per_file))) < self.wide:
            df = df.repartition(files)
        path = f"{self.top}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = path
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
