"""Session set-up and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lakesieve", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LAKESIEVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (local tests) a temporary folder is made and set; on a cluster the
    setting is expected, because a machine-local folder would not be seen by other executors.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"lakesieve-{sc.applicationId}")
        sc.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_scratch: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; ``drop_scratch`` removes what was written to such paths."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; returns their number.

    To be called once the results that read them are written: results are lazy and read them until then.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared file system, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` does and survives the loss of executors, but keeps the
    columns prunable and compressed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its files are split into fewer.

    A small table in one file would otherwise be worked on by one core. Large inputs have more splits than
    cores and are left as they are, so nothing is shuffled for them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str, spread_out: bool = False) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; ``spread_out`` for work that is heavy for each row."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if spread_out else df
