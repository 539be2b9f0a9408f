"""Tables between the rounds of a loop, in storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a temporary folder, but only if all of Spark runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ramus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path; the folder goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class Tables:
    """Parquet tables of one computation.

    A table that is read back has no lineage and its true size, where a checkpoint keeps
    the planner's estimate for the plan that it cut; in a loop those estimates grow
    without bound, and small tables are never broadcast. ``put`` of a name that was put
    before deletes the table before last of that name.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str = "zstd"):
        self.spark, self.root, self.codec = spark, fresh_path(spark, name), codec
        self.paths: dict[str, list[str]] = defaultdict(list)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", self.codec).parquet(path)
        self.paths[name].append(path)
        if len(self.paths[name]) > 2:
            delete(self.spark, self.paths[name].pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                delete(self.spark, path)


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """One table, written and read back."""
    return Tables(df.sparkSession, name).put("rows", df)
