"""Mentions and relations: overlaps resolved, pairs within reach, linking, and triples under a vocabulary of predicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import unclaimed
from .resolution import fuzzy_top

#: Which types a predicate may join.
PREDICATES = {
    "EMPLOYED_BY": ["PERSON ORG"],
    "BANKS_WITH": ["PERSON ORG"],
    "INSURED_BY": ["PERSON ORG"],
    "CUSTOMER_OF": ["PERSON ORG"],
    "CONTRACTS_WITH": ["PERSON ORG"],
    "REPRESENTED_BY": ["PERSON ORG", "PERSON PERSON"],
    "MEMBER_OF": ["PERSON ORG"],
    "RESIDES_IN": ["PERSON GPE", "PERSON LOCATION"],
    "LOCATED_IN": ["ORG GPE", "ORG LOCATION"],
    "RELATED_TO": ["PERSON PERSON"],
    "HAS_POSTAL_CODE": ["GPE POSTAL_CODE", "LOCATION POSTAL_CODE"],
}
MENTION = "struct<rank:double,score:double,size:int,start:int,end:int,label:string,value:string>"


def vocabulary(spark) -> DataFrame:
    """predicate, src_type, dst_type."""
    return spark.createDataFrame([(p, *pair.split()) for p, pairs in PREDICATES.items() for pair in pairs], "predicate string, src_type string, dst_type string")


def best_mentions(mentions: DataFrame, priority: Column) -> DataFrame:
    """mentions (document_id, start, stop, label, value, score) without those that overlap a better one of their document.

    Better: a higher priority, then score, length, an earlier start, label and value. Equal mentions are one. An array holds
    the mentions of one document.
    """
    mention = F.struct(-priority.cast("double"), -F.col("score"), F.col("start") - F.col("stop"), "start", F.col("stop").alias("end"), "label", "value").cast(MENTION)
    held = mentions.groupBy("document_id").agg(F.array_sort(F.collect_set(mention)).alias("all"))
    kept = held.select("document_id", F.explode(unclaimed(F.col("all"), MENTION)).alias("m"))
    return kept.select("document_id", "m.start", F.col("m.end").alias("stop"), "m.label", "m.value", (-F.col("m.score")).alias("score"))


def near_pairs(mentions: DataFrame, reach: int) -> DataFrame:
    """document_id, a_*, b_*: pairs of a document's mentions, a before b, with at most `reach` characters from a's end to b's start.

    They meet in stretches of `reach` characters, so a long document's mentions do not all meet.
    """
    stretch = F.floor(F.col("start") / reach)
    fields = ["start", "stop", "label", "value"]
    a = mentions.select("document_id", *(F.col(c).alias(f"a_{c}") for c in fields), F.floor(F.col("stop") / reach).alias("s"))
    a = a.withColumn("s", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)))
    b = mentions.select("document_id", *(F.col(c).alias(f"b_{c}") for c in fields), stretch.alias("s"))
    return a.join(b, ["document_id", "s"]).drop("s").where((F.struct("a_start", "a_stop") < F.struct("b_start", "b_stop")) & (F.abs(F.col("b_start") - F.col("a_stop")) <= reach))


def linked(mentions: DataFrame, gazetteer: DataFrame, threshold: tuple[int, int] = (3, 5)) -> DataFrame:
    """label, value, node, how of each distinct mention: the gazetteer's most similar name of the label (id, entity_type, value), or a slug."""
    wanted = mentions.select("label", "value").distinct().select("label", "value", F.xxhash64("label", "value").alias("query_id"))
    found = fuzzy_top(gazetteer, wanted.select("query_id", F.col("label").alias("entity_type"), "value"), threshold, 1)
    how = F.when(F.col("score") == 1, "exact").when(F.col("score").isNotNull(), "fuzzy").otherwise("slug")
    slug = F.concat(F.lower("label"), F.lit(":"), F.regexp_replace(F.lower("value"), r"[^a-z0-9]+", "-"))
    return wanted.join(found, "query_id", "left").select("label", "value", F.coalesce(F.col("id").cast("string"), slug).alias("node"), how.alias("how"))


def legal_triples(raw: DataFrame, phrases: DataFrame, predicates: DataFrame) -> DataFrame:
    """src, predicate, dst, evidence from raw (src, src_type, phrase, dst, dst_type, evidence).

    A phrase (phrase, predicate; a vocabulary) that fits the types the other way round is turned; what fits neither way, and
    loops, are left out; of equal triples the longest evidence stays, then the least, cut at 250 characters.
    """
    named = raw.join(F.broadcast(phrases), "phrase").where("src <> dst")
    ahead = predicates.select("predicate", "src_type", "dst_type", F.lit(True).alias("ahead"))
    back = predicates.select("predicate", F.col("src_type").alias("dst_type"), F.col("dst_type").alias("src_type"), F.lit(True).alias("back"))
    typed = named.join(F.broadcast(ahead), ["predicate", "src_type", "dst_type"], "left").join(F.broadcast(back), ["predicate", "src_type", "dst_type"], "left").where("ahead OR back")
    turned = F.col("ahead").isNull()
    found = typed.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), "predicate", F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.substr("evidence", F.lit(1), F.lit(250)).alias("evidence"))
    return found.groupBy("src", "predicate", "dst").agg(F.min_by("evidence", F.struct(-F.length("evidence"), "evidence")).alias("evidence"))


def shares(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1 of found rows against gold ones, both counted once a key."""
    f, g = found.select(*keys).distinct(), gold.select(*keys).distinct()
    both = f.join(g, keys, "left_semi")
    n = both.agg(F.count("*").alias("hit")).join(f.agg(F.count("*").alias("found"))).join(g.agg(F.count("*").alias("gold")))
    p, r = (F.col("hit") / F.greatest(c, F.lit(1)) for c in ("found", "gold"))
    return n.select(p.alias("precision"), r.alias("recall"), F.when(F.col("hit") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
