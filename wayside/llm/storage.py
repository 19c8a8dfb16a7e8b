"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    The written table cuts lineage, outlives executors and has a known size.
    A checkpoint keeps the size that was estimated for its plan, which squares
    with every join in a loop and in the end takes the optimizer minutes.  The
    folder is that of ``spark.checkpoint.dir``; where the setting is absent, as
    in tests, one in the session's warehouse.
    """
    session = df.sparkSession
    sc = session.sparkContext
    if sc.getCheckpointDir() is None:
        shared = session.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or f"{session.conf.get('spark.sql.warehouse.dir')}/_settled")
    path = f"{sc.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)
