"""A session for local runs and tests; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "tidewire") -> SparkSession:
    """local[cores], UTC, AQE on. spark.checkpoint.dir is set only where nothing has set it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's setting, else (local
    masters only) a folder of the machine's temporary folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = os.path.join(os.environ.get("TMPDIR", "/tmp"), "tidewire-checkpoints")
    sc.setCheckpointDir(path)
    return path


def cut(df):
    """checkpoint() in the shared folder: the lineage ends there and lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
