"""The two classifiers: held-out quality above what the majority answer has, and scores against plain walks of the same models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import quality, toxicity
from lexloom.llm.words import powers

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("operator", "label", "rare"), [(toxicity.toxicity, "toxic", 1), (quality.quality, "quality", 0)])
def test_held_out(spark, operator, label, rare):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = operator(table, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("truth")).toPandas()
    truth, score = got["truth"].to_numpy(), got["score"].to_numpy()
    right = [(got["predicted"][truth == k] == k).mean() for k in (0, 1)]
    order = np.argsort(np.argsort(score)) + 1
    ones = (truth == 1).sum()
    area = (order[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (truth == 0).sum())
    assert len(got) > 500 and right[rare] >= 0.7 and sum(right) / 2 >= 0.85 and area >= 0.9


def plain_toxicity(model, text):
    """A walk over words, windows and n-grams, one character at a time."""
    text = " " + text.lower() + " " * 6
    part = [ord(c) < 128 and not c.isalnum() for c in text]
    words, i = [], 0
    while i < len(text):
        if not part[i]:
            j = i
            while not part[j]:
                j += 1
            words.append((i, j))
            i = j
        i += 1
    echo = [k > 0 and text[slice(*w)] == text[slice(*words[k - 1])] for k, w in enumerate(words)]
    silent = {p for w, same in zip(words, echo, strict=True) if same for p in range(w[0] - 1, w[1] - 1)}
    begins = [w[0] - 1 for w, same in zip(words, echo, strict=True) if not same]
    if not begins:
        return model.bias
    starts = [b for k, b in enumerate(begins) if k % toxicity.WINDOW == 0 and (k == 0 or k + toxicity.WINDOW <= len(begins))]
    factors = [(int(x) >> 32 | 1) & 0xFFFFFFFF for x in powers(8)[1:]]
    value = [1 if p else ord(c) + 2 for c, p in zip(text, part, strict=True)]
    best = -math.inf
    for begin, end in zip(starts, [*starts[1:], len(text) - 5], strict=True):
        total, n = 0.0, 0
        for p in range(begin, end):
            for size in toxicity.GRAMS:
                if p + size > len(text) or p in silent or any(part[p + k] for k in range(1, size - 1)):
                    continue
                h = sum(value[p + k] * factors[k] for k in range(size)) & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                h = (h ^ h >> 12) * 0x297A2D39 & 0xFFFFFFFF
                total, n = total + model.weights[h >> (32 - toxicity.BITS)], n + 1
        best = max(best, total / (n + toxicity.PRIOR) + model.bias)
    return best


def test_toxicity_scores():
    random = np.random.default_rng(6)
    model = toxicity.Model(random.normal(size=1 << toxicity.BITS), 0.3, 1.7, -0.2)
    letters = list("abcdeéß日0 ,.") + [" "] * 4
    texts = ["", "  ", "a", "go go go away", "x" * 40, "one. two, THREE"] + ["".join(random.choice(letters, int(random.integers(1, 900)))) for _ in range(25)]
    want = [1 / (1 + math.exp(-(model.slope * plain_toxicity(model, t) + model.shift))) for t in texts]
    assert model.score(texts) == pytest.approx(want, abs=1e-5)


def test_quality_scores(spark):
    """Spark's score column is what the rules say of the statistics, one rule at a time."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(table, labels)
    assert model.rules
    names = list(quality.statistics(F.col("text")))
    rows = quality.scored(table, model).select("row.doc_id", "row.text", "score").select("doc_id", "score", *(c.alias(n) for n, c in quality.statistics(F.col("text")).items())).collect()
    for r in rows:
        total = model.shift
        for bounds, weight in model.rules:
            if all((r[name] > limit) == above for name, above, limit in bounds):
                total += weight
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))
    assert len(rows) == table.count() and len(names) == len(set(names))


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_awkward_labels(spark, operator):
    """Labels that repeat, contradict each other, are null, or name no document; null ids; clashing columns."""
    docs = [(1, "good clean words stand here in a row", 1), (2, None, 2), (3, "", 3), (None, "no id", 4), (1, "again the same id", 5), (4, "w " * 5000, 6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, label long").withColumn("score", F.lit("s")).withColumn("toxic", F.lit("t")).withColumn("row", F.lit(1)).withColumn("_id", F.lit(9))
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 0, 0), (2, 0, None), (4, None, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = operator(frame, labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got) and sum(r["doc_id"] is None for r in got) == 1
