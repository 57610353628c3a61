"""Tables between the steps of a job, written once and read by every step that needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all run in one process, else an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


#: Spark's own setting: the shuffle files of a query go when it has ended, not when the driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, by: str | None = None) -> None:
    """df as Parquet, packed (zstd), in folders of `by`; what lies at path is replaced, and no shuffle files stay."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        conf.set(CLEAN_UP, before)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stages:
    """Stage tables of one job in a folder of its own. As a context manager it deletes them at the end, when nothing reads them any more."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a Parquet table: computed once, short lineage, whole again when executors are lost."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)
