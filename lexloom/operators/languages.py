"""Languages of texts by a naive Bayes model over the letters, pairs and triples of letters of their words.

The model is learned from labelled texts as a Spark table: texts shrink to counts of words by language before anything is
cut into grams, and each distinct word is scored once, so a text is a sum over its words. The most common words (HEAD of
them) are sent to all tasks with their scores and leave one row a text; only the rare ones meet their scores in a shuffle. Logarithms are whole millionths,
so sums do not depend on the order of rows. All languages count as equally likely; c occurrences of N in a language with V
grams of that length over all languages weigh (c + 1) / (N + V).

Defined cases: a null text, one of fewer than 20 characters (spaces at its ends aside) and one without letters is unknown, as
all are without labelled texts; equal scores go to the first language in order of code points; words are runs of letters,
lower-cased; labels that are null teach nothing; rows that repeat, or share an id, get an answer each;
a column language of docs is replaced. Texts meet by a 64-bit hash.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

UNKNOWN = "unknown"
LEAST_LENGTH = 20
MOST_LANGUAGES = 1000
HEAD = 100_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def grams_of(word: Column) -> Column:
    """The letters of a word; pairs and triples with a space at both ends."""
    padded, n = F.concat(F.lit(" "), word, F.lit(" ")), F.length(word)

    def pieces(source: Column, k: int, upto: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), upto), lambda i: F.substr(source, i, F.lit(k)))

    return F.concat(pieces(word, 1, n), pieces(padded, 2, n + 1), pieces(padded, 3, n))


def millionths(x: Column) -> Column:
    return F.round(F.ln(x) * 1e6).cast("long")


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """lang (null: of unlabelled texts), word, n of whole texts."""
    return docs.select("lang", F.explode(words_of(F.col(text))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, gram, n from rows (lang, word, n)."""
    labelled = words.where("lang IS NOT NULL").select("lang", "n", F.explode(grams_of(F.col("word"))).alias("gram"))
    return labelled.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, what each gram adds to a language's score (a table), and the logarithms of N + V by length of gram."""

    def __init__(self, counts: DataFrame, ws: Workspace):
        counts = ws.save(counts, "gram_counts")
        totals = counts.groupBy("lang", F.length("gram").alias("k")).agg(F.sum("n").alias("n")).limit(3 * MOST_LANGUAGES + 1).collect()  # three rows a language
        if len(totals) > 3 * MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        self.languages = sorted({r["lang"] for r in totals})
        kinds = {r["k"]: r["v"] for r in counts.groupBy(F.length("gram").alias("k")).agg(F.countDistinct("gram").alias("v")).collect()}
        seen = {(r["lang"], r["k"]): r["n"] for r in totals}
        self.sizes = {(lang, k): seen.get((lang, k), 0) + kinds.get(k, 0) for lang in self.languages for k in (1, 2, 3)}
        parts = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) for lang in self.languages]
        # written, so that Spark knows its size: it is sent to all tasks if small enough
        self.grams = ws.save(counts.groupBy("gram").agg(*[millionths(c + 1).alias(f"g{i}") for i, c in enumerate(parts)]), "grams") if parts else None

    def word_scores(self, words: DataFrame) -> DataFrame:
        """word, n, s0, s1, ...: each word's score in each language, of rows (word, n) with different words."""
        found = words.select("word", "n", F.explode(grams_of(F.col("word"))).alias("gram")).join(self.grams, "gram", "left")
        within = [F.sum(F.coalesce(f"g{i}", F.lit(0))) for i in range(len(self.languages))]
        size = F.length("word")
        bases = [_total([length * millionths(F.lit(float(max(self.sizes[lang, k], 1)))) for k, length in ((1, size), (2, size + 1), (3, size))]) for lang in self.languages]
        return found.groupBy("word", "n").agg(*[(w - F.max(b)).alias(f"s{i}") for i, (w, b) in enumerate(zip(within, bases, strict=True))])


def detected(docs: DataFrame, model: Model, words: DataFrame, ws: Workspace, text: str = "text", head: int = HEAD) -> DataFrame:
    """docs and a column language; words: word_counts() of docs, or of more. head only sets how the work is done."""
    if not model.languages:
        return docs.withColumn("language", F.lit(UNKNOWN))
    every = range(len(model.languages))
    scores = ws.save(model.word_scores(words.groupBy("word").agg(F.sum("n").alias("n"))), "word_scores")
    common = F.broadcast(scores.orderBy(F.desc("n"), "word").limit(head).drop("n"))  # HEAD rows: some 10 MB for a few languages
    named = docs.withColumn("_text", F.xxhash64(text))
    long_enough = F.length(F.trim(F.col(text))) >= LEAST_LENGTH
    # copies of a text share an answer: all its sums only grow by a common factor
    read = named.where(long_enough).select("_text", F.explode(words_of(F.col(text))).alias("word")).join(common, "word", "left")
    spread = F.concat(F.lit(" "), F.pmod("_text", F.lit(4096)).cast("string"))  # no word: rows of common words meet nothing, in any task
    rare = F.when(F.col("s0").isNull(), F.col("word")).otherwise(spread).alias("rare")
    first = read.groupBy("_text", rare).agg(F.count("*").alias("times"), *[F.sum(f"s{i}").alias(f"t{i}") for i in every])
    found = first.join(scores.withColumnRenamed("word", "rare"), "rare", "left")
    totals = found.groupBy("_text").agg(*[F.sum(F.coalesce(f"t{i}", F.col("times") * F.col(f"s{i}"))).alias(f"s{i}") for i in every])
    best = F.greatest(*[F.col(f"s{i}") for i in every]) if len(every) > 1 else F.col("s0")
    chosen = F.coalesce(*[F.when(F.col(f"s{i}") == best, F.lit(lang)) for i, lang in enumerate(model.languages)])
    answers = totals.select("_text", chosen.alias("_language"))
    return named.join(answers, "_text", "left").withColumn("language", F.when(long_enough, F.coalesce("_language", F.lit(UNKNOWN))).otherwise(UNKNOWN)).drop("_text", "_language")
