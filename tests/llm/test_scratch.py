"""What written tables leave behind."""

import time

from pyspark.sql import functions as F

from quern.llm.common import Scratch


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    kept = Scratch(spark.range(10_000).groupBy(F.col("id") % 100).count(), "kept")
    for _ in range(20):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and kept.df.count() == 100
