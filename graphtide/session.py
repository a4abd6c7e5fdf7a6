"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRAPHTIDE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only in local mode where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        sc.setCheckpointDir(found)
    return found


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/graphtide/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder; for when no result of it is read any more."""
    remove(spark, own_dir(spark))


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, gives true sizes."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphtide_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*dfs: DataFrame) -> None:
    """Deletes tables made by materialize that no later result reads."""
    for df in dfs:
        path = getattr(df, "_graphtide_path", None)
        if path:
            remove(df.sparkSession, path)
