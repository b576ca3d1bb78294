"""Shuffle files go once their result is written."""

import time

from pyspark.sql import functions as F

from tidemark.llm.common import written


def test_a_finished_write_leaves_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in (str(files.getAllFiles().apply(i)) for i in range(files.getAllFiles().size())) if "/shuffle_" in f}

    written(spark.range(1000))
    time.sleep(1)
    before = shuffled()
    out = written(spark.range(0, 100_000, 1, 4).withColumn("x", F.xxhash64("id")).repartition(4, "x"))
    until = time.time() + 3
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert out.count() == 100_000
