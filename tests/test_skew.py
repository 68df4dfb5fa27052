from pyspark.sql import functions as F

from lodespark.operators import skew


def rows(spark):
    hot = [("hot", i, f"v{i % 7}") for i in range(3000)]
    rest = [(f"k{i % 40}", i, None if i % 5 == 0 else f"v{i % 3}") for i in range(400)]
    return spark.createDataFrame(hot + rest + [(None, 1, "x"), ("", None, "y")], "key string, n long, v string").repartition(9)


def test_tree_equals_group_by(spark):
    df = rows(spark)
    states = {"mentions": ("count", F.lit(1)), "given": ("count", F.col("n")), "total": ("sum", F.col("n")), "last": ("max", F.col("n")), "first": ("min", F.col("n"))}
    for levels in (1, 2, 4):
        tree = skew.tree_aggregate(df, ["key"], states, rows_per_chunk=16, fan_in=3, levels=levels)
        plain = df.groupBy("key").agg(F.count(F.lit(1)), F.count("n"), F.sum("n"), F.max("n"), F.min("n"))
        assert sorted(tree.collect(), key=str) == sorted(plain.collect(), key=str)


def test_distinct_values(spark):
    got = {r["key"]: r["values"] for r in skew.tree_distinct(rows(spark), ["key"], "v", "values", fan_in=2, levels=3).collect()}
    want = {r["key"]: r["n"] for r in rows(spark).where("v is not null").groupBy("key").agg(F.countDistinct("v").alias("n")).collect()}
    assert got == want


def test_heavy_keys_and_fields(spark):
    df = rows(spark).withColumnRenamed("key", "a").withColumnRenamed("v", "b").withColumn("field", F.lit("clash")).withColumn("mentions", F.lit(0))
    got = {(r["field"], r["key_value"], r["mentions"]) for r in skew.heavy_keys(df, ["a", "b"], 0.2).collect()}
    counts = {("a", "hot", 3000)}
    assert got == counts
    assert {r["key_value"] for r in skew.heavy_keys(df, ["b"], 0.1).collect()} == {f"v{i}" for i in range(7)}


def test_share_is_reached_by_equality(spark):
    # 0.02 * 350 is more than 7 in floating point.
    df = spark.createDataFrame([("a",)] * 7 + [(f"x{i}",) for i in range(343)], "a string")
    assert [r["key_value"] for r in skew.heavy_keys(df, ["a"], 0.02).collect()] == ["a"]


def test_empty(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert skew.heavy_keys(df, ["a", "b"], 0.02).count() == 0
    assert skew.tree_distinct(df, ["a"], "b", "n").count() == 0
