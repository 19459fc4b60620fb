"""Similar sets and pairs of classes against brute force, and how many rows their joins make."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.catalog import frame
from lexloom.functions import names
from lexloom.operators import resolution, vocabularies
from lexloom.plans import QUERIES


def join_rows(spark, frame):
    """Rows that the joins of a frame's plan put out, Generate left out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    frame.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    for i in range(before, store.executionsCount()):
        execution = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for n in (nodes.apply(k) for k in range(nodes.size())):
            for m in (n.metrics().apply(k) for k in range(n.metrics().size())) if "Join" in n.name() else ():
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


@pytest.mark.parametrize("threshold", [(3, 5), (7, 10), (1, 1)])
def test_set_matches(spark, threshold):
    draw = random.Random(5)
    made = [(i, i % 2, sorted({draw.choice("abcdefghijklmno") + str(draw.randrange(1 + i % 3)) for _ in range(draw.randrange(0, 14))})) for i in range(240)]
    made += [(300 + i, 0, [f"{k}" for k in range(i, i + 200)]) for i in range(0, 120, 10)]  # more items than bits
    rows = spark.createDataFrame(made, "id long, block int, items array<string>")
    p, q = threshold

    def plain(left, right):
        return {(a, b, round(len({*s} & {*t}) / len({*s} | {*t}), 9)) for a, x, s in left for b, y, t in right if x == y and s and t and len({*s} & {*t}) * q >= p * len({*s} | {*t})}

    every = plain(made, made)
    assert {(r["a"], r["b"], round(r["score"], 9)) for r in names.set_matches(rows, threshold=threshold).collect()} == {r for r in every if r[0] < r[1]}
    asked = [r for r in made if r[0] % 3 == 0]
    assert {(r["a"], r["b"], round(r["score"], 9)) for r in names.set_matches(rows.where("id % 3 = 0"), rows, threshold).collect()} == plain(asked, made)


def words(n, seed=7):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghijklmnoprstuvwz", k=9)) for _ in range(n)]


def test_a_word_in_every_tag(spark):
    tags = spark.createDataFrame([(f"the {w}",) for w in words(1000)], "tag string")
    assert join_rows(spark, vocabularies.similar_tags(tags.select(F.col("tag").alias("query")), tags)) < 50_000  # of 1,000,000 pairs


def test_a_word_in_every_name(spark):
    named = spark.createDataFrame([(i, "ORG", f"aaa {w}") for i, w in enumerate(words(1000))], "id long, entity_type string, value string")
    assert join_rows(spark, resolution.fuzzy_top(named, named.selectExpr("id AS query_id", "entity_type", "value"), (3, 5), 1)) < 200_000


def test_names_of_matches_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    named = spark.createDataFrame([(i, "ORG", f"{a} {b}") for i, (a, b) in enumerate(zip(words(60, 1), words(60, 2), strict=True))], "id long, entity_type string, value string")
    resolution.matches(named.mapInArrow(counted, named.schema)).collect()
    assert seen.value == 60


def test_pairs_of_equal_names(spark):
    """Names that very many rows share: their pairs leave the joins as blocks, and all of them are there."""
    rows = [(i, "t", ["red bolt", "red bolts", "blue ring", "!"][i % 4]) for i in range(1600)]
    made = names.trigram_pairs(spark.createDataFrame(rows, "id long, block string, name string"))
    got = [(r["a"], r["b"]) for r in made.select("a", "b").collect()]
    like = {"red bolt": 0, "red bolts": 0, "blue ring": 1}
    assert len(got) == len({*got}) and {*got} == {(a, b) for a, _, x in rows for b, _, y in rows if a < b and x in like and y in like and like[x] == like[y]}
    assert join_rows(spark, made) < 20_000  # of 399,600 pairs


def test_families_meet_in_blocks(spark, tmp_path):
    """One last word in very many names: no join or exchange sees their pairs, but those decided are left out."""
    words_ = [w for w in words(500) if len(w) == 9]
    rows = [(2 * i, f"{w.title()} the Sea") for i, w in enumerate(words_)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = QUERIES["l13_family_pairs"](spark, str(tmp_path))
    named = {r["value"]: r["id"] for r in frame(spark, str(tmp_path), "named").where("entity_type = 'PERSON'").collect()}
    family = {}
    for value, i in named.items():
        family.setdefault(value.split(" ")[-1], []).append(i)
    want = {f"{a}|{b}" for ids in family.values() for a in ids for b in ids if a < b and not (b == a + 2 and str(a) < str(b))}
    got = [r["pair_key"] for r in made.collect()]
    assert len(got) == len({*got}) and {*got} == want and "8|10" in got and len(got) > 10_000
    assert join_rows(spark, made) < 3000
