"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch of texts.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(app: str = "factloom", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects everywhere: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='factloom-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Where it is unset, a local session gets one
    folder of its own a process; on a cluster that is an error, since executors would not see each other's files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        where = _own_dir()
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Unless the session sets its own bound, its Arrow batches hold BATCH_BYTES at most (or one row) from here on."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
