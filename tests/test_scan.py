import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import scan


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_two_levels_are_one_window(spark, size):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i * 3, rng.choice([None, 1, 2, 5]), rng.choice(["x", None, "y"])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, v int, t string")
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("g").orderBy(F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)
    block = scan.block_of("o", size)
    pairs = [
        (scan.running(df, ["g"], ["o"], F.coalesce("v", F.lit(0)), "x", block=block), df.withColumn("x", F.sum(F.coalesce("v", F.lit(0))).over(w))),
        (scan.running(df, ["g"], ["o"], F.col("v"), "x", "last", block), df.withColumn("x", F.last("v", ignorenulls=True).over(w))),
        (scan.running(df, ["g"], ["o"], F.col("t"), "x", "last", block, descending=True), df.withColumn("x", F.last("t", ignorenulls=True).over(down))),
        (scan.previous(df, ["g"], ["o"], ["t"], "p", block).withColumn("x", F.col("p.t")).drop("p"), df.withColumn("x", F.lag("t").over(Window.partitionBy("g").orderBy("o")))),
    ]
    for got, want in pairs:
        assert sorted(map(tuple, got.select("g", "o", "x").collect())) == sorted(map(tuple, want.select("g", "o", "x").collect()))
