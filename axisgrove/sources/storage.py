"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine is made, which only a local master can share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="axisgrove-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str = "step", kept: list[str] | None = None) -> DataFrame:
    """df written as parquet and read again: a plan of one scan, which a lost executor can repeat. The path is added to
    kept, for removed()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if kept is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables, and empties the list."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()
