"""running_within equals a whole-group window, also when one group spans many partitions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from hashsieve.operators.ranking import running_within


def test_running_within_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.randint(0, 50), rnd.randint(1, 5)) for _ in range(2000)]
    rows += [(f"g{i % 7}", rnd.randint(0, 50), rnd.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = running_within(df, ["g"], ["o", "v"], {"s": F.col("v").cast("long"), "c": F.lit(1).cast("long")},
                         firsts=["o"], partitions=8)
    w = Window.partitionBy("g").orderBy("o", "v").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "o", "v", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("c"),
                     F.count(F.lit(1)).over(Window.partitionBy("g")).alias("c_total"),
                     F.min("o").over(Window.partitionBy("g")).alias("o_first"))
    cols = ["g", "o", "v", "s", "c", "c_total", "o_first"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in want.select(*cols).collect())
    assert a == b
