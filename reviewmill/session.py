"""Session helpers: where durable intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written stages.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder: on a cluster that folder would not be visible to other machines.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="reviewmill-")
    return _local_dirs[app]


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never reused, so no write replaces another."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/reviewmill/{app}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the checkpoint folder the cluster set; set one only where there is none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark) + "/checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are fixed on shared storage and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage boundary as Parquet in the shared folder and read it back."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect garbage: Spark removes the shuffle files of plans that nothing refers to only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def build_session(app: str = "reviewmill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are designed for; callers may override any."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
