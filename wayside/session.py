"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wayside", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Shuffle files of a query are removed when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether rows that are dealt out by some of a join's keys are dealt out again by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def settle(df: DataFrame, codec: str | None = None, **settings: str) -> DataFrame:
    """Materialise a result that several branches of a plan read.

    It is written as Parquet to the shared folder named by
    ``spark.checkpoint.dir`` and read again, so a lost executor costs a re-read
    and not a recomputation, a branch reads only its columns, and the optimizer
    knows the size (a checkpoint keeps the estimate of its plan, which grows with
    every join).  Where that setting is absent (tests, benchmarks) the folder
    lies in the session's warehouse, which every executor sees as well.  The
    shuffle files of the writing query go with its end, so that the disk holds
    those of one step at a time.  ``codec`` is for tables too large to be
    broadcast, as the optimizer takes the size of the files for the rows';
    ``settings`` hold for the writing query only.
    """
    session = df.sparkSession
    sc = session.sparkContext
    if sc.getCheckpointDir() is None:
        shared = session.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or f"{session.conf.get('spark.sql.warehouse.dir')}/_settled")
    path = f"{sc.getCheckpointDir()}/settled/{uuid.uuid4().hex}"
    settings = {CLEANUP: "true", **settings}
    before = {name: session.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            session.conf.set(name, value)
        df.write.parquet(path, compression=codec)
    finally:
        for name, value in before.items():
            session.conf.unset(name) if value is None else session.conf.set(name, value)
    return session.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows that are about to be multiplied.

    Adaptive execution sizes partitions by their bytes before the growth, so a
    small table that fans out would be left to one task.  A fixed partition
    count is kept as it is.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
