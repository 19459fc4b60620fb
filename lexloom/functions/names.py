"""Name keys and fuzzy comparison, all as Spark expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .pairs import linked_pairs


def trigrams(value: Column) -> Column:
    """Distinct 3-grams of the lower-cased words, each padded by two spaces before and one behind."""
    words = F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the trigram sets; 0 when both are empty."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def bits(item: Column, word: int) -> Column:
    """The bit that an item sets in one of two words of 64."""
    h = F.pmod(F.xxhash64(item), F.lit(128)).cast("int")
    return F.when(F.floor(h / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), h)).otherwise(F.lit(0).cast("long"))


def prefixes(sets: DataFrame, counts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """no, block, n, at, item, bits0, bits1: the first n - ceil(t * n) + 1 items of each set (no, block, items), by counts (block, item, names), rare ones first."""
    p, q = threshold
    each = sets.select("no", "block", F.size("items").alias("n"), F.explode("items").alias("item"))
    ranked = each.join(counts, ["block", "item"], "left").groupBy("no", "block").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("names", F.lit(0)), "item"))).alias("items"), *(F.bit_or(bits(F.col("item"), w)).alias(f"bits{w}") for w in (0, 1))
    )
    first = ranked.select("no", "block", "n", "bits0", "bits1", F.posexplode(F.slice("items", F.lit(1), (F.col("n") - F.ceil(F.col("n") * p / q) + 1).cast("int"))).alias("at", "i"))
    return first.select("no", "block", "n", "bits0", "bits1", "at", F.col("i.item").alias("item"))


def set_matches(left: DataFrame, right: DataFrame | None = None, threshold: tuple[int, int] = (3, 5)) -> DataFrame:
    """a, b, score: ids of sets of one block, of left and of right, whose Jaccard similarity reaches threshold[0] / threshold[1]; without right, pairs (a < b) of left.

    Sets: id, block, items (distinct; an empty set matches none). Items are ordered by how many sets hold them, rare ones
    first. A similar pair shares one of the first n - ceil(t * n) + 1 items of each side, at positions that leave enough
    behind them; its sizes are near, and so are its sets' hashes in 128 bits: no more bits differ than items do. Only numbers
    of pairs that pass all this leave the join; to them the sets are attached for the final comparison.
    """
    p, q = threshold
    ws = Workspace(left.sparkSession, "sets")
    # written once, so that the numbers stay what they are
    sets = [ws.save(s.where(F.size("items") > 0).select(F.monotonically_increasing_id().alias("no"), "id", "block", "items"), name) for s, name in ((left, "left"), (right, "right")) if s is not None]
    counts = sets[-1].select("block", F.explode("items").alias("item")).groupBy("block", "item").agg(F.count("*").alias("names"))
    fields = ["n", "at", "bits0", "bits1"]
    a, b = (prefixes(s, counts, threshold).select(F.col("no").alias(x), "block", "item", *(F.col(f).alias(f"{x}_{f}") for f in fields)) for x, s in (("a", sets[0]), ("b", sets[-1])))
    total = F.col("a_n") + F.col("b_n")
    near = (F.least("a_n", "b_n") * q >= F.greatest("a_n", "b_n") * p) & (F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) * (p + q) >= total * p)
    apart = sum((F.bit_count(F.col(f"a_bits{w}").bitwiseXOR(F.col(f"b_bits{w}"))) for w in (0, 1)), F.lit(0))
    # by sort-merge: what explode makes of small tables is no small table
    met = a.join(b.hint("merge"), ["block", "item"]).where(near & (apart * (p + q) <= total * (q - p)))
    met = (met.where("a < b") if right is None else met).select("a", "b").distinct()
    held = [s.select(F.col("no").alias(x), F.col("id").alias(f"{x}_id"), F.col("items").alias(f"{x}_items")).hint("merge") for x, s in (("a", sets[0]), ("b", sets[-1]))]
    whole = met.join(held[0], "a").join(held[1], "b")
    both, either = F.size(F.array_intersect("a_items", "b_items")), F.size(F.array_union("a_items", "b_items"))
    found = whole.where(both * q >= p * either).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), (both / either).alias("score"))
    return found if right is not None else found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a < b")


def gram_matches(rows: DataFrame, threshold: tuple[int, int] = (3, 5)) -> DataFrame:
    """a, b, score: pairs (a < b) of one block whose trigram similarity reaches threshold[0] / threshold[1]. rows: id, block, name, each name once a block."""
    return set_matches(rows.select("id", "block", trigrams(F.col("name")).alias("items")), threshold=threshold)


def trigram_pairs(rows: DataFrame, threshold: tuple[int, int] = (3, 5)) -> DataFrame:
    """a, b, score: pairs (a < b) of one block whose trigram similarity reaches threshold[0] / threshold[1]. rows: id, block, name.

    Equal names of a block are compared once; their pairs are made from the names that match.
    """
    held = rows.where("name IS NOT NULL").groupBy("block", "name").agg(F.min("id").alias("name_id"))
    names = gram_matches(held.select(F.col("name_id").alias("id"), "block", "name"), threshold)
    alike = held.where(F.size(trigrams(F.col("name"))) > 0).select(F.col("name_id").alias("x"), F.col("name_id").alias("y"), F.lit(1.0).alias("score"))
    named = rows.join(held, ["block", "name"]).select(F.col("name_id").alias("class"), "id")
    return linked_pairs(named, names.select(F.col("a").alias("x"), F.col("b").alias("y"), "score").unionByName(alike))


def name_tokens(name: Column) -> Column:
    """Distinct sorted tokens, lower-cased, punctuation as spaces; the lower-cased words themselves where nothing is left."""
    words = F.filter(F.split(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}\s_]", " ")), r"\s+"), lambda w: w != "")
    bare = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.when(F.size(words) > 0, words).otherwise(bare)))


def resolution_key(name: Column) -> Column:
    """The name's tokens, joined; one key for any order, case and punctuation of its words."""
    return F.array_join(name_tokens(name), " ")


def display_key(name: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def merchant_key(name: Column) -> Column:
    """Punctuation as spaces, lower case, single spaces; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s_]", " "), r"\s+", " ")), F.lit(""))


def postal_place(value: Column) -> Column:
    """struct(code, place) of a name that begins with 4 or 5 digits and goes on with a letter; null for others."""
    pattern = r"^(\d{4,5})\s+(\p{L}.+)$"
    bare = F.trim(value)
    return F.when(bare.rlike(pattern), F.struct(F.regexp_extract(bare, pattern, 1).alias("code"), F.trim(F.regexp_extract(bare, pattern, 2)).alias("place")))


def typo_tokens(a: Column, b: Column) -> Column:
    """Different tokens of at least 4 characters with one first character and one edit between them."""
    return (a != b) & (F.least(F.length(a), F.length(b)) >= 4) & (F.substr(a, F.lit(1), F.lit(1)) == F.substr(b, F.lit(1), F.lit(1))) & within_one_edit(a, b)


def edit_keys(value: Column) -> Column:
    """The value and what is left of it without one character: values within one edit, or one swap, share a key."""
    n = F.length(value)
    dropped = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(value, F.lit(1), i - 1), F.substr(value, i + 1, n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(value), dropped))


def category_key(name: Column) -> Column:
    """Punctuation to spaces, lower case, single spaces, and a final s dropped from longer names that do not end in ss."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    return F.when((F.length(key) > 3) & key.endswith("s") & ~key.endswith("ss"), F.substr(key, F.lit(1), F.length(key) - 1)).otherwise(key)


def within_one_edit(a: Column, b: Column) -> Column:
    """Equal but for one inserted, dropped, changed or swapped character."""
    i = F.levenshtein(a, b)
    positions = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swapped = F.exists(positions, lambda k: F.concat(F.substr(a, F.lit(1), k - 1), F.substr(a, k + 1, F.lit(1)), F.substr(a, k, F.lit(1)), F.substr(a, k + 2, F.length(a))) == b)
    return (i <= 1) | ((i == 2) & (F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped)


def one_edit_pairs(values: DataFrame) -> DataFrame:
    """first, second: pairs (first < second) of distinct values that are within one edit. values: value.

    Such values share a key among the value itself and the value with one character removed; two swapped neighbours too.
    """
    keys = values.select("value").where("value IS NOT NULL").distinct().select("value", F.explode(edit_keys(F.col("value"))).alias("key"))
    met = keys.withColumnRenamed("value", "first").join(keys.withColumnRenamed("value", "second"), "key").where("first < second").dropDuplicates(["first", "second"])
    return met.where(within_one_edit(F.col("first"), F.col("second"))).select("first", "second")


#: Roman numerals that count as ordinals.
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]


def is_ordinal(token: Column) -> Column:
    return token.rlike("^[0-9]+$") | F.lower(token).isin(ROMAN)
