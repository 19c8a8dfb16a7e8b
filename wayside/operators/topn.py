"""The first n rows per key, however many rows a key has and however large n is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Windows that are filtered on their row number cut before their shuffle only up to this setting.
THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Shuffle partitions for each part that a key is dealt to.
PARTITIONS_PER_SALT = 16


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column], n: int, salts: int | None = None, number: Callable[[], Column] = F.row_number) -> DataFrame:
    """The first ``n`` rows by ``order`` of every key (nulls are a key); ties are cut anywhere, so ``order`` should be total.

    First rows of parts are first rows of the whole, so each task cuts to ``n``
    before its shuffle, then every key is cut in ``salts`` parts, and the parts
    meet: a key with most of all rows costs one task ``salts * n`` rows at most.
    ``salts`` follows from the shuffle partitions if it isn't given; with one,
    the parts are left out.  Spark cuts before the shuffle up to a threshold; it
    is raised in the session where ``n`` is larger.  With ``F.dense_rank`` as
    ``number``, rows that tie count once and stay together.
    """
    session = df.sparkSession
    if n > int(session.conf.get(THRESHOLD)):
        session.conf.set(THRESHOLD, str(n))
    salts = salts or max(1, int(session.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_PER_SALT)

    def cut(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("_rn", number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")

    if salts > 1:
        df = cut(df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts))), [*keys, "_salt"]).drop("_salt")
    return cut(df, keys)
