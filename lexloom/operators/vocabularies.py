"""Controlled vocabularies: categories that labels resolve to under a cap, and tags that merge."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import category_key, set_matches, trigrams

#: Categories of a tenant and of a document, and the least similarity of a fuzzy hit.
MOST, MOST_OF_DOCUMENT, FUZZY = 50, 8, (7, 10)


def resolve_labels(labels: DataFrame, categories: DataFrame, most: int = MOST) -> DataFrame:
    """label, key, category, how: the category that each distinct label gets: exact, fuzzy, new or nearest; null where nothing is left of a label.

    labels: label, first (its first place); categories: category (a vocabulary, at most `most` rows). New categories are made
    in order of first places while the cap allows; labels beyond it get the nearest category there is. Of labels with one key
    the first makes the category.
    """
    named = labels.groupBy("label").agg(F.min("first").alias("first")).withColumn("key", category_key(F.col("label")))
    keys = named.where("key <> ''").groupBy("key").agg(F.min_by("label", "first").alias("label"), F.min("first").alias("first"))
    held = categories.select("category", category_key(F.col("category")).alias("held_key"))
    exact = keys.join(held, F.col("key") == F.col("held_key"), "left").select("key", "label", "first", F.col("category").alias("exact"))
    # a vocabulary is bounded by its cap, so each open key may look at all of it
    near = nearest(exact.where("exact IS NULL").select("key"), held.select("category", "held_key"))
    found = exact.join(near, "key", "left")
    fuzzy = F.when(F.col("both") * FUZZY[1] >= F.col("either") * FUZZY[0], F.col("nearest"))
    found = found.withColumn("fuzzy", F.when(F.col("exact").isNull(), fuzzy))
    fresh = found.where("exact IS NULL AND fuzzy IS NULL")
    room = held.agg(F.greatest(F.lit(most) - F.count("*"), F.lit(0)).alias("room"))
    made = fresh.orderBy("first", "key").limit(most).select("key", F.trim("label").alias("new"), F.row_number().over(W.orderBy("first", "key")).alias("place"))  # at most `most` rows in this window
    made = made.join(F.broadcast(room)).where("place <= room").select(F.col("key").alias("new_key"), "new")
    found = found.join(made, F.col("key") == F.col("new_key"), "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("fuzzy").isNotNull(), "fuzzy").when(F.col("new").isNotNull(), "new").when(F.col("nearest").isNotNull(), "nearest")
    by_key = found.select(F.col("key").alias("k"), F.coalesce("exact", "fuzzy", "new", "nearest").alias("category"), how.alias("how"))
    return named.join(by_key, F.col("key") == F.col("k"), "left").select("label", "key", "category", "how")


def nearest(keys: DataFrame, held: DataFrame) -> DataFrame:
    """key, nearest, both, either: for each key the category (category, held_key; a bounded vocabulary) with the most similar trigrams, ties by name."""
    pairs = keys.select("key", trigrams(F.col("key")).alias("g")).join(F.broadcast(held.withColumn("h", trigrams(F.col("held_key")))))
    sized = pairs.select("key", "category", F.size(F.array_intersect("g", "h")).alias("both"), F.size(F.array_union("g", "h")).alias("either"))
    best = sized.groupBy("key").agg(F.min_by(F.struct("category", "both", "either"), F.struct(-(F.col("both") / F.greatest("either", F.lit(1))), "category")).alias("b"))
    return best.select("key", F.col("b.category").alias("nearest"), "b.both", "b.either")


def document_categories(labelled: DataFrame, resolved: DataFrame, most: int = MOST_OF_DOCUMENT) -> DataFrame:
    """document_id, category, rank: a document's categories in the order of its labels (document_id, place, label), each once, the first `most`."""
    found = labelled.join(resolved.where("category IS NOT NULL").select("label", "category"), "label")
    first = found.groupBy("document_id", "category").agg(F.min("place").alias("place"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy("place", "category")) - 1)
    return ranked.where(F.col("rank") < most).select("document_id", "category", "rank")


def tag_key(name: Column) -> Column:
    """Compatibility-composed, lower case, no pictographs, single spaces."""
    plain = F.pandas_udf(_composed, "string")(name)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]+", ""), r"\s+", " "))


def _composed(names):
    return names.str.normalize("NFKC")


def similar_tags(wanted: DataFrame, tags: DataFrame, threshold: tuple[int, int] = (3, 5), k: int = 3) -> DataFrame:
    """query, tag, score, place: of each wanted key (query) the k tags (tag) whose word sets are most similar, ties by tag."""
    asked, held = (rows.distinct().select(F.col(n).alias("id"), F.lit(0).alias("block"), F.array_distinct(F.filter(F.split(n, " "), lambda w: w != "")).alias("items")) for rows, n in ((wanted.select("query"), "query"), (tags.select("tag"), "tag")))
    scored = set_matches(asked, held, threshold).select(F.col("a").alias("query"), F.col("b").alias("tag"), "score")
    return scored.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "tag"))).where(F.col("place") <= k)


def merged_tags(links: DataFrame, merges: DataFrame) -> DataFrame:
    """links (document_id, tag) after merges (loser, survivor): the loser's documents carry the survivor, each once."""
    moved = links.join(merges, F.col("tag") == F.col("loser"), "left")
    return moved.select("document_id", F.coalesce("survivor", "tag").alias("tag")).distinct()


def updated_tags(links: DataFrame, documents: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """links (document_id, tag) after adding tags (tag) to documents (document_id) and then removing others from them."""
    wanted = documents.select("document_id").distinct().join(add.select("tag").distinct())  # a request's documents times its tags
    gone = documents.select("document_id").distinct().join(remove.select("tag").distinct())
    return links.select("document_id", "tag").unionByName(wanted).distinct().join(gone, ["document_id", "tag"], "left_anti")
