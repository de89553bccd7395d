"""The two hashes of a line are independent."""

from pyspark.sql import functions as F

from motorspark.llm import line_dedup


def test_second_hash_is_no_function_of_the_first(spark):
    k = F.concat(F.lit("line "), F.col("id").cast("string"))
    made = line_dedup.line_hashes(k)
    got = spark.range(100).select(made["a"].alias("a"), made["b"].alias("b"), F.xxhash64(k, F.lit(1)).alias("chained"), F.xxhash64(F.lit(1), k).alias("seeded")).collect()
    assert all(r["b"] != r["chained"] and r["b"] == r["seeded"] for r in got)
