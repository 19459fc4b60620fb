"""Components of long chains."""

from pyspark.sql import functions as F

from lexloom.operators.graph import label_components


def test_long_chain(spark):
    links = spark.range(1, 41).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    links = links.unionByName(spark.createDataFrame([(100, 101), (101, 101), (103, 102)], "src long, dst long"))
    got = {r["id"]: r["label"] for r in label_components(links).collect()}
    assert got == {i: 1 for i in range(1, 42)} | {100: 100, 101: 100, 102: 102, 103: 102}
