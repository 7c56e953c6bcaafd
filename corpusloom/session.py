"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Rows of a few numbers that one task should write, where a table is known to be light.
LIGHT_ROWS = 1 << 16


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a folder of its own.
    On a cluster a machine-local folder would be invisible to the executors, so the
    missing setting is an error there.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        root = root.rstrip("/")
    elif spark.sparkContext.master.startswith("local"):
        root = _local_root(spark)
    else:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


_local_roots: dict[str, str] = {}


def _local_root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="corpusloom-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder; nothing is created yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df):
    """Spread a small input over all cores before costly work on each row.

    A table of a few splits would leave cores idle. The size that Spark estimates decides:
    anything that fills every core with splits of its own is left where it is.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df


def fine_parts(df, part_bytes: int) -> int:
    """Partitions of some ``part_bytes`` of a stored table, four a core at least, so that all cores end at about one time."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))


def stage(df, name: str = "stage", rows: int | None = None):
    """Write ``df`` once to the scratch folder and read it back.

    Cuts the lineage with a table that outlives lost executors, and lets later steps
    read single columns of an expensive result. ``rows`` is a bound on the rows of a light table: it
    is written by a task for each ``LIGHT_ROWS`` of them, and by one a core at least. On a local file system
    Hadoop starts processes of its own for each file that an executor creates, so many tiny files cost more than their rows.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // LIGHT_ROWS)))
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
