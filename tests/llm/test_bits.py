from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from tideline import session
from tideline.llm.bits import bitmap, has


def test_a_bitmap_leaves_no_shuffle_files(spark):
    """A chain of bitmaps would else pile up the shuffles that their values came from."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_")}

    before = files()
    often = spark.range(100).groupBy((F.col("id") % 7).alias("v")).count().filter("count > 14")
    bits = bitmap(often.select(F.col("v").cast("long").alias("v")), "v")
    assert has(bits, np.arange(7)).tolist() == [True, True] + [False] * 5
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(session.CLEANUP) == "false"
