"""Settings that hold for every query of the engine."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a folder of this machine serves, but only if everything runs on it; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return "file://" + os.path.join(tempfile.gettempdir(), "planloom-shared")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/planloom-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it from there.

    It is computed once, its lineage ends there, and no executor's loss can take it away. The table is deleted when
    the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _drop_tables() -> None:
    for spark, path in _tables:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


def build_session(app: str = "planloom", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and ``bench.py`` use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLANLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
