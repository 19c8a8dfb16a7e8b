"""Results that are settled, and what they leave on the disk."""

import time

from pyspark.sql import functions as F

from wayside.session import CLEANUP, settle


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = (blocks.getAllFiles().apply(i).getName() for i in range(blocks.getAllFiles().size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    rows = spark.range(20000).select((F.col("id") % 5000).alias("k"), F.md5(F.col("id").cast("string")).alias("v")).groupBy("k").agg(F.max("v").alias("v"))
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    kept = settle(rows, "zstd")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get(CLEANUP, None) == setting
