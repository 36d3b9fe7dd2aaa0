"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the session comes from spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tillwise")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only for local masters."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


def pin(df: DataFrame) -> DataFrame:
    """Keep the optimizer from copying the column expressions of ``df`` into the filters and columns above it.

    Filters are pushed through plain columns by repeating their expressions, which for long derivations
    means working them out once per mention. They are not pushed through a generated row.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal the rows of an input over tasks before costly work on each row.

    Inputs that already have a partition per core are returned as they are: nothing is shuffled. Scans are cut by bytes,
    though, and a file of narrow rows holds millions in one cut: with ``rows``, about so many go to a task, however
    large the input. Meant for plain scans, whose rows the file footers tell; an input with shuffles would run them.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        want = max(want, -(-df.count() // rows))
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through reliable storage, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
