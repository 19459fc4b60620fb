"""Pairs of ids by classes: what is quadratic is written out where it is made, never shuffled."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many ids a block holds at most, about: two blocks make this squared pairs from one row.
BLOCK = 1000


def blocks(members: DataFrame, size: int = BLOCK) -> DataFrame:
    """class, part, ids: the ids of each class (class, id), dealt by hash into parts of about `size`."""
    counts = members.groupBy("class").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    dealt = members.join(counts, "class").select("class", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    return dealt.groupBy("class", "part").agg(F.collect_list("id").alias("ids"))


def linked_pairs(members: DataFrame, links: DataFrame, size: int = BLOCK) -> DataFrame:
    """a, b and what links have besides x and y: pairs of ids (a < b) of linked classes (x <= y; x = y: pairs within the class).

    members: class, id, one class an id. Blocks of ids meet, are dealt out evenly and make their pairs in the task they come to.
    """
    held = blocks(members, size)
    x, y = (held.select(F.col("class").alias(n), F.col("part").alias(f"{n}_part"), F.col("ids").alias(f"{n}_ids")) for n in "xy")
    more = [c for c in links.columns if c not in ("x", "y")]
    met = links.join(x, "x").join(y, "y").where("x <> y OR x_part <= y_part")
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = (F.col("x") == F.col("y")) & (F.col("x_part") == F.col("y_part"))
    dealt = met.select(same.alias("same"), "x_ids", "y_ids", *more).repartition(tasks)
    each = dealt.select("same", "y_ids", F.explode("x_ids").alias("i"), *more).select("same", "i", F.explode("y_ids").alias("j"), *more)
    return each.where("i <> j AND (NOT same OR i < j)").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), *more)
