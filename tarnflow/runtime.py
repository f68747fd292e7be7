"""Session helpers: where lineage is cut, and how tables are read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Uses the session's spark.checkpoint.dir; a folder of its own only where that is unset and Spark runs in one process."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            folder = tempfile.mkdtemp(prefix="tarnflow-checkpoint-")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: later steps read it and don't compute it again."""
    prepare(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder, for large tables: it is compressed, and later steps read only the columns they need."""
    spark = prepare(df.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def plain(df: DataFrame) -> bool:
    """Whether df only selects from rows that are stored: to compute it again costs no more than to read it."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return all(re.match(r"[\s:+-]*(Project|Filter|Relation|LocalRelation|LogicalRDD|Range)\b", x) for x in lines)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, folder: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())


def finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the subfolders that were written to their end, in order."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(_path(spark, f"{folder}/{n}/_SUCCESS")[0]))


def remove(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)
