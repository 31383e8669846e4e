"""Session helpers: configuration for local runs and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusflow") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter configures it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> None:
    """Session settings the plans need.

    Unions that keep a common partitioning zip their inputs, which fails in this Spark
    version when adaptive execution gave them different partition counts.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    The setting is read from the session. Where it is unset on a local master, as in tests, a temporary folder becomes the
    checkpoint folder; on a cluster that is an error, since no other folder is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusflow-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_dir(spark)}/corpusflow/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared work folder and read it back.

    Cuts the lineage and, unlike a cache, survives the loss of executors. Zstandard keeps the copy small.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A plain scan over at least as many partitions as there are cores.

    Only inputs of few files are moved, so that row-local text work uses the whole machine; a table with enough
    splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
