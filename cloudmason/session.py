"""Session helpers: a local session for tests and benches, and lineage cutting that survives lost executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "cloudmason", memory: str = "8g") -> SparkSession:
    """A session on this machine. On a cluster the caller brings its own session; nothing here is needed there."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CLOUDMASON_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir. Only a purely local session without that setting gets a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cloudmason-checkpoint-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: plans stay short and executors may be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def uncut(df: DataFrame) -> None:
    """Delete the files of a result of cut() that nothing reads any more."""
    rdd = df._jdf.queryExecution().logical().rdd()
    if rdd.getCheckpointFile().isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, rows: int = 0, per_task: int = 400_000) -> int:
    """Shuffle partitions for tasks that hold their rows as arrays: the configured number, or more where rows ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
