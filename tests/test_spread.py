"""Work that is costly by row is dealt to tasks by rows, not by bytes."""

from pyspark.sql import functions as F

from corvane.operators import metrics as M


def test_bootstrap_rows_are_not_joined_into_one_task(spark):
    a = spark.range(4000).select("id", (F.col("id") % 7).cast("double").alias("x"))
    one = a.repartition(1).join(a.select("id", F.col("x").alias("y")).hint("merge"), "id")
    sums = M.replicate_sums(one, "id", 3, "s", {"n": F.lit(1), "x": F.col("x") - F.col("y")})
    assert sums.collect() and f", {2 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in sums._jdf.queryExecution().executedPlan().toString()
