"""Sessions and the few things every operator needs from one."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lodestone", cores: str | int = "*", **conf) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, where it is not installed on them (or give its archive to
    ``spark-submit --py-files``)."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()
    name = os.path.basename(root)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", os.path.dirname(root), name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Input read as fewer partitions than there are cores, spread over them before Python work. Large
    tables are read as many partitions and stay as they are, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Applications whose folder is ours and goes when this process ends.
_OWN: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. One of our own is made only in local mode, as in tests;
    on a cluster a missing name is an error, as no folder of one machine would do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"lodestone-{spark.sparkContext.applicationId}")
        if spark.sparkContext.applicationId not in _OWN:
            _OWN.add(spark.sparkContext.applicationId)
            atexit.register(shutil.rmtree, named, ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
