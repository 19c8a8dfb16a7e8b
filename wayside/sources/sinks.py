"""Sinks: append-only log, keyed upsert, scoped replace, versioned tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folder of the marks of complete parts; readers of the table pass it over.
_MARKS = "_complete"


def _read_marks(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("number long").parquet(f"{path}/{_MARKS}")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def marked(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete parts (versions or batches) of a table, in order; none if nothing was marked yet."""
    marks = _read_marks(spark, path)
    return sorted({r["number"] for r in marks.select("number").collect()}) if marks else []  # a row per part


def _write_once(df: DataFrame, path: str, part: str, number: int, partition_by: tuple[str, ...] = ()) -> bool:
    """Write a part and then its mark.

    A part with a mark is whole and stays as it is, so writing it again does
    nothing.  One without a mark is what a writer left that died on the way; it
    is replaced.  Returns whether the part was written.
    """
    if number in marked(df.sparkSession, path):
        return False
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{part}={number}")
    df.sparkSession.range(1).coalesce(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{path}/{_MARKS}/part={number}")
    return True


def append_once(df: DataFrame, path: str, batch: int, partition_by: tuple[str, ...] = ()) -> bool:
    """Append rows under a batch number; a batch that is tried again adds nothing."""
    return _write_once(df, path, "batch", batch, partition_by)


def committed(spark: SparkSession, path: str, schema: str, after: int | None = None, batches: list[int] | None = None) -> DataFrame:
    """Rows of the complete batches (of those ``after`` a number, or of the listed ones); files without a mark are not read."""
    found = [b for b in marked(spark, path) if (after is None or b > after) and (batches is None or b in set(batches))]
    reader = spark.read.schema(schema)
    return reader.parquet(*[f"{path}/batch={b}" for b in found]) if found else spark.createDataFrame([], schema)


def commits(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The commit log as a stream: the column ``number`` of every batch that becomes complete, once each."""
    if _read_marks(spark, path) is None:  # the folder must be there
        spark.createDataFrame([], "number long").coalesce(1).write.mode("append").parquet(f"{path}/{_MARKS}")
    reader = spark.readStream.schema("number long")
    return (reader.option("maxFilesPerTrigger", most) if most else reader).option("recursiveFileLookup", "true").parquet(f"{path}/{_MARKS}")


def append_user_events(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Append to the log, one folder per day; with a batch number a retried append adds nothing."""
    dated = df.withColumn("event_date", F.to_date("occurred_at"))
    if batch is None:
        dated.write.mode("append").partitionBy("event_date").parquet(path)
    else:
        append_once(dated, path, batch, ("event_date",))


def upsert(target: DataFrame, new: DataFrame, keys: list[str], ts: str | None = None) -> DataFrame:
    """Union in which the last write per key wins; new rows beat stored ones.

    Of new rows of one key the one with the largest ``ts`` wins; where that
    leaves a tie, the same row wins in every run, but which one is not defined.
    A partial aggregate instead of a window: a key with very many versions is
    reduced before the shuffle.
    """
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [n for n in both.columns if n not in (*keys, "_new")]
    order = [F.col("_new"), *([F.col(ts)] if ts else []), F.xxhash64(*rest).alias("_tie")]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{n}").alias(n) for n in rest]).select(*target.columns, *[n for n in rest if n not in target.columns])


def replace_scope(target: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """Drop the rows of a scope and put the new rows in."""
    return target.where(~F.coalesce(scope, F.lit(False))).unionByName(new)


def replace_scope_by_key(target: DataFrame, new: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """As ``replace_scope``, the scope given as keys."""
    return target.join(scope.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def publish(df: DataFrame, path: str, version: int) -> bool:
    """Write a table as a new version, then mark it; readers keep the old one until the mark is there, and a marked version is not written again."""
    return _write_once(df, path, "version", version)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a published table: the newest one with a mark."""
    return spark.read.parquet(f"{path}/version={marked(spark, path)[-1]}")
