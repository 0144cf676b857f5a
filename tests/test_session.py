"""Durable cuts leave their rows and nothing else."""

import time

from pyspark.sql import functions as F

from tablekeep.session import CLEANUP, materialize_tidy


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    before, was = shuffled(), spark.conf.get(CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.max("id").alias("id"))
    kept = materialize_tidy(df.repartition("id"), "kept")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(CLEANUP, None) == was
    assert sorted(kept.collect()) == sorted(df.collect())
