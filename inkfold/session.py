"""Session defaults, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def builder(cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """Settings for a local session; on a cluster the submitted configuration wins where it sets these."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkfold")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else b


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that losing an executor costs nothing before it.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own;
    on a cluster a machine-local folder would be lost with its machine, so there the setting is required.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), f"inkfold-checkpoint-{os.getuid()}")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def small(df: DataFrame, max_bytes: int) -> bool:
    """Whether the optimizer's size estimate proves that ``df`` may be broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= max_bytes
