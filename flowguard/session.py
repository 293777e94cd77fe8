"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "flowguard") -> SparkSession:
    """A local session for tests and benches; clusters bring their own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # numpy temporaries stay in the worker's heap instead of being mapped and unmapped at every step
        .config("spark.executorEnv.MALLOC_MMAP_THRESHOLD_", str(512 * 1024 * 1024))
        .config("spark.executorEnv.MALLOC_TRIM_THRESHOLD_", str(512 * 1024 * 1024))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local master may fall back to a temp folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="flowguard-ckpt-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and go on from there; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STAGED = "flowguard-staged-"


def staged(df: DataFrame) -> DataFrame:
    """As ``materialise``, but as compressed columns; partitions come back in other sizes. Disk of the shuffles that made it is given back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{_STAGED}{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # Spark deletes the files of a shuffle when nothing refers to it any more
    return spark.read.schema(df.schema).parquet(path)


def _delete(df: DataFrame, path: str) -> None:
    jvm = df.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` reads, or the checkpoint that it is; nothing may read them after this."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.rpartition("/")[2].startswith(_STAGED):
            _delete(df, path)
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        _delete(df, plan.rdd().getCheckpointFile().get())
