"""Session defaults shared by the tests, the benchmark and the entry module."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int | None = None, app: str = "swarf", small_partitions: bool = False) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC timestamps.

    Shuffle partitions are the cluster's own unless given; ``small_partitions`` suits tests and small benchmarks.
    """
    builder = SparkSession.builder.master(master).appName(app)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if small_partitions:
        # small partitions may still be costly (spectra, regular expressions): keep all cores busy
        builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
