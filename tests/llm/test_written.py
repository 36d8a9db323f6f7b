"""What steps leave behind once they are written."""

import os
import time

from pyspark.sql import functions as F

from terrachron.llm import common


def shuffled(spark):
    """Shuffle files of this session."""
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_written_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids"))
    found = common.written(df.join(spark.range(100).withColumnRenamed("id", "k").hint("merge"), "k"), "test-shuffles")
    until = time.time() + 10
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert found.count() == 100 and spark.conf.get(common.SHUFFLES_GO, "false") == "false"


def test_forget(spark):
    found = common.written(spark.range(10), "test-forget")
    path = found.written_to.removeprefix("file:")
    assert found.count() == 10 and os.path.isdir(path)
    common.forget(found)
    assert not os.path.exists(path)
