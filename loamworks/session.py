"""Session helpers: table readers and written intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables of long texts, and bytes up to which one of few files is dealt to all cores.
TEXTS = ("documents", "pages")
SMALL = 256 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a file or a folder of part files."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in TEXTS else table


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer files than there are cores, dealt to all of them; others as they are.

    A file of one row group is one task's, however many cores there are. Large tables have splits enough and aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for an in-process master without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loamworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Workspace:
    """Written tables of one job: each cuts the lineage and survives the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, name: str) -> None:
        """For tables that nothing lazily read still needs."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
