"""Session helpers: a local session for tests, table access, the shared checkpoint folder and input spreading."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names in `spark.checkpoint.dir`.

    Only a session in one process (tests, benchmarks) gets a temporary folder where none is named; on a cluster, whose
    machines would each see another folder, that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all machines of the cluster share")
        path = tempfile.mkdtemp(prefix="palimpsest-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, factor: int = 3) -> DataFrame:
    """Spread an input of fewer partitions than cores before a stage that is heavy on CPU; the rows are the same.

    The number of partitions is estimated from the size of what is scanned, so nothing is run to learn it. Large inputs
    come in enough partitions and pass unchanged: nothing is shuffled there.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    scanned = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(factor * cores) if scanned < 2 * cores * most else df
