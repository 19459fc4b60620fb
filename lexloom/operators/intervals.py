"""Intervals of texts met by bins, relations by rules within sentences, and one-to-one scoring of mentions."""

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MARK = re.compile(r"[.!?\n]")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str], width: int = 256) -> DataFrame:
    """All pairs of rows of equal keys whose spans (start, end exclusive) share a character, each pair once.

    Spans are dealt into the bins of `width` characters that they touch and meet there by equality; a pair that meets in
    several bins counts in the first, where the later of both begins. Empty spans meet nothing. Columns of left and right
    must differ but for the keys.
    """

    def binned(rows: DataFrame, span: tuple[str, str]) -> DataFrame:
        start, stop = F.col(span[0]), F.col(span[1])
        return rows.where(start < stop).withColumn("_bin", F.explode(F.sequence(F.floor(start / width), F.floor((stop - 1) / width))))

    met = binned(left, l_span).join(binned(right, r_span), [*keys, "_bin"])
    share = (F.col(l_span[0]) < F.col(r_span[1])) & (F.col(r_span[0]) < F.col(l_span[1]))
    return met.where(share & (F.col("_bin") == F.floor(F.greatest(l_span[0], r_span[0]) / width))).drop("_bin")


def within_reach(mentions: DataFrame, key: str, reach: int) -> DataFrame:
    """key, a_*, b_*: pairs of a text's mentions (start, stop, ...), a before b, with at most `reach` characters between a's end and b's start."""
    others = [c for c in mentions.columns if c != key]
    a = mentions.select(key, *(F.col(c).alias(f"a_{c}") for c in others)).withColumn("_from", F.col("a_stop") - reach).withColumn("_to", F.col("a_stop") + reach + 1)
    b = mentions.select(key, *(F.col(c).alias(f"b_{c}") for c in others)).withColumn("_at", F.col("b_start")).withColumn("_behind", F.col("b_start") + 1)
    pairs = overlapping(a, b, [key], ("_from", "_to"), ("_at", "_behind"), 2 * reach + 1)
    return pairs.where(F.struct("a_start", "a_stop") < F.struct("b_start", "b_stop")).drop("_from", "_to", "_at", "_behind")


def sentences_of(text: str):
    """(number, start, stop) of each sentence: up to and with its mark; the last goes to one past the text's end."""
    start, number = 0, 0
    for m in MARK.finditer(text):
        yield number, start, m.end()
        start, number = m.end(), number + 1
    yield number, start, len(text) + 1


def placed(spans: DataFrame, sentences: DataFrame, key: str = "document_id") -> DataFrame:
    """Spans (key, start, stop, ...) with number, s_start, s_stop of the sentence that they begin in, by bins."""
    starts = spans.withColumn("_end", F.col("start") + 1)
    return overlapping(starts, sentences, [key], ("start", "_end"), ("s_start", "s_stop")).drop("_end")


def rule_relations(mentions: DataFrame, triggers: DataFrame, reach: int = 200, key: str = "document_id") -> DataFrame:
    """key, a_start, a_stop, b_start, b_stop, predicate, score, evidence_start, evidence_stop: pairs of mentions that a rule relates.

    mentions: key, start, stop, number, s_start, s_stop; triggers: key, number, predicate, score (number: of the sentence).
    Two mentions are related where a trigger of the predicate lies in what reaches from the first one's sentence to the
    second one's, so also between them; the best score of a predicate stays. Equal mentions are one.
    """
    ruled = triggers.groupBy(key, "number", "predicate").agg(F.max("score").alias("score"))
    pairs = within_reach(mentions.select(key, "start", "stop", "number", "s_start", "s_stop"), key, reach)
    met = pairs.withColumn("number", F.explode(F.sequence("a_number", F.greatest("a_number", "b_number")))).join(ruled, [key, "number"])
    names = [key, "a_start", "a_stop", "b_start", "b_stop", "predicate"]
    return met.groupBy(*names).agg(F.max("score").alias("score"), F.min("a_s_start").alias("evidence_start"), F.max("b_s_stop").alias("evidence_stop"))


def placed_matches(text: str, patterns: list):
    """(number of the pattern, number, start and stop of the sentence it begins in, start, stop) of all that patterns match in a text."""
    sentences = list(sentences_of(text))
    starts = [s for _, s, _ in sentences]
    for k, pattern in enumerate(patterns):
        for m in pattern.finditer(text):
            yield k, *sentences[bisect_right(starts, m.start()) - 1], *m.span()


def one_to_one(gold: set[str], found: set[str]) -> list[tuple[str, str]]:
    """Pairs of gold and found values, each used once, where one's words are a subset of the other's: gold in order, each with the first found value that is left."""
    by_word: dict[str, list[str]] = {}
    for value in found:
        for word in set(value.split()):
            by_word.setdefault(word, []).append(value)
    used, pairs = set(), []
    for value in sorted(gold):
        words = set(value.split())
        met = {other for word in words for other in by_word.get(word, ()) if other not in used}
        first = min((other for other in met if words <= set(other.split()) or set(other.split()) <= words), default=None)
        if first is not None:
            used.add(first)
            pairs.append((value, first))
    return pairs


def mention_lists(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, gold, found: the distinct values of each side, of mentions (keys, label, value, is_gold)."""
    side = [F.collect_set(F.when(F.col("is_gold") == g, F.col("value"))).alias(n) for g, n in ((True, "gold"), (False, "found"))]
    return mentions.groupBy(*keys, "label").agg(*side)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, gold, found, keys) sorted by keys and label to counts by label, a row for each batch and label."""
    key, gold, found, counts = None, set(), set(), {}

    def close() -> None:
        exact = gold & found
        paired = one_to_one(gold - exact, found - exact)
        for k, n in enumerate((len(gold), len(found), len(exact), len(paired))):
            counts.setdefault(key[0], [0, 0, 0, 0])[k] += n

    def flush() -> pa.RecordBatch:
        rows = [(label, *n) for label, n in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(5)], names=["label", "gold", "found", "exact", "paired"])

    for batch in batches:
        for label, g, f, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (label, *rest):
                if key is not None:
                    close()
                key, gold, found = (label, *rest), set(), set()
            gold.update(g or ())
            found.update(f or ())
        yield flush()
    if key is not None:
        close()
        yield flush()


def mention_scores(lists: DataFrame, keys: list[str]) -> DataFrame:
    """label ('' for all), gold, found, exact, relaxed counts, and precision, recall and f1 of both.

    lists: keys, label, gold, found (see mention_lists); rows of equal keys and label add up. Values count once on each side of a text and label. Exact ones are
    those of both sides; what is left is paired one to one within a text and label, and relaxed counts both. Mentions of
    one text meet in one task, as distinct values; only sums by label leave it.
    """
    rows = lists.select("label", "gold", "found", *keys).where("label IS NOT NULL")
    counted = rows.repartition(*keys, "label").sortWithinPartitions(*keys, "label").mapInArrow(_scored, "label string, gold long, found long, exact long, paired long")
    names = ["gold", "found", "exact", "paired"]
    by_label = counted.groupBy("label").agg(*(F.sum(n).alias(n) for n in names))
    total = by_label.agg(F.lit("").alias("label"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    both = by_label.unionByName(total).withColumn("relaxed", F.col("exact") + F.col("paired")).drop("paired")
    shares = []
    for n in ("exact", "relaxed"):
        p, r = F.coalesce(F.try_divide(n, "found"), F.lit(0.0)), F.coalesce(F.try_divide(n, "gold"), F.lit(0.0))
        shares += [p.alias(f"{n}_precision"), r.alias(f"{n}_recall"), F.coalesce(F.try_divide(F.lit(2.0) * F.col(n), F.col("found") + F.col("gold")), F.lit(0.0)).alias(f"{n}_f1")]
    return both.select("label", "gold", "found", "exact", "relaxed", *shares)
