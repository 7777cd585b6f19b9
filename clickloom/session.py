"""Session settings for local runs and advice for clusters."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are planned for.  AQE sizes and splits shuffle
# partitions; forcing the skew join lets it split a hot key even where the
# split costs one more exchange.  The small minimum keeps
# small inputs that expand in a join spread over all cores; large ones never
# reach it.  Call-site capture only slows plan building.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A hot user's session windows are merged before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Set by tests and local runs whose session names no spark.checkpoint.dir.
local_folder: str | None = None


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "clickloom"):
    """A local[*] session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "localhost")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh folder under spark.checkpoint.dir, the folder all executors share.

    Without that setting a session in one process may use ``local_folder``;
    anything else is an error, since executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.conf.get("spark.master", "").split("[")[0] == "local":
        base = local_folder
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def written(df: DataFrame, prefix: str) -> DataFrame:
    """`df` written to the shared folder and read back, for plans that use it several times."""
    path = shared_dir(df.sparkSession, prefix)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffled_over(spark: SparkSession, tasks: int):
    """Shuffles planned inside have at least ``tasks`` partitions, so a task's share does not grow with the input."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), tasks)))
    try:
        yield
    finally:
        spark.conf.set(key, before)
