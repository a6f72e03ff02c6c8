"""Session helpers: staging of shared intermediates and bounded look-ups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        # Wide projections compile to methods the JVM will not optimise; run those piecewise.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="tallyspark-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def new_stage_path(spark: SparkSession, name: str = "t") -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "t", row_group: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage for frames that several jobs read. Parquet rather than an
    RDD checkpoint: columns stay prunable, and the planner sees true file sizes,
    so its own size check decides whether a join side may be broadcast.
    """
    path = new_stage_path(df.sparkSession, name)
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Very wide projections run piecewise: fused, they make one method that the JVM will not optimise.
PIECEWISE = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# Survey rows take a few bytes in a file and very many in a sort, so tasks read little.
SMALL_READS = {"spark.sql.files.maxPartitionBytes": str(16 << 20)}
ROW_GROUP = 16 << 20  # bytes that a task cannot divide further
# Shuffles are dealt finely and merged up to this many bytes, so a task's share does not grow with the table.
SMALL_SHARES = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(8 << 20),
}


@contextmanager
def configured(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    """Session options for what runs inside; they are as before afterwards."""
    before = {name: spark.conf.get(name, None) for name in options}
    for name, value in options.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Rows of a result whose size is known to be small; refuses to collect more."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows of {what}; this operator needs a bounded number")
    return rows


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when its files give fewer splits than there are.

    Large inputs have more splits than cores and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
