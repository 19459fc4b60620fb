"""Shingles of many documents: their index lists are led by blocks, and what that shuffles."""

import numpy as np

from lexloom.llm import jaccard


def shuffled_bytes(spark, docs, long_list: int) -> tuple[int, list[tuple]]:
    """Bytes that labelled_components shuffles, and its rows."""

    def stages() -> dict[int, int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    docs.count()
    last = max(stages())
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.labelled_components(docs, long_list=long_list).collect())
    return sum(n for k, n in stages().items() if k > last), rows


def test_long_lists_do_not_shuffle_prefixes_again(spark):
    """One opening in all documents; short ones have it in their prefixes. Copies and near copies among the long ones."""
    rng = np.random.default_rng(8)
    opening = "this text is the same".split()
    rows = []
    for i in range(1500):
        own = opening + [f"w{x}" for x in rng.integers(0, 1 << 40, 400)]
        rows.append((i, " ".join(own)))
        if i % 10 == 0:
            rows.append((10_000 + i, " ".join(own)))
        if i % 15 == 0:
            rows.append((20_000 + i, " ".join([*own[:200], "other", *own[201:]])))
    rows += [(30_000 + i, " ".join([*opening, *(["end"] * (i % 3))])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    plain, expected = shuffled_bytes(spark, docs, 10_000)
    blocks, found = shuffled_bytes(spark, docs, 100)
    assert found == expected
    label = {d: c for d, _, c in found}
    assert all(label[10_000 + i] == i for i in range(0, 1500, 10)) and all(label[20_000 + i] == i for i in range(0, 1500, 15))
    assert [label[30_000 + i] for i in range(90)] == [30_000 + i % 3 for i in range(90)]
    assert blocks < 1.1 * plain, (blocks, plain)
    docs.unpersist()
