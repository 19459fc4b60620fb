"""The inverted index against scores that are worked out chunk by chunk."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.catalog import frame
from lexloom.operators import postings
from lexloom.plans import searches
from lexloom.workspace import Workspace

WORDS = ["the", "of", "sea", "été", "ß", "x9", "rare"]


def chunks_of(n, seed=1):
    draw = random.Random(seed)
    rows = [(f"{i // 3}:{i % 3}", i // 3, " ".join(draw.choices(WORDS, [30, 20, 10, 5, 2, 1, 0.2], k=draw.randrange(0, 40)))) for i in range(n)]
    return [*rows, ("z:0", 900, None), ("z:1", 901, ""), ("z:2", 902, "The OF, the—of!"), ("z:3", 903, "The OF, the—of!"), ("z:4", None, "sea " * 500)]


def plain(rows, terms, k, by, all_terms):
    words = {c: re.findall(r"[^\W_]+", (t or "").lower()) for c, _, t in rows}
    n, mean = len(rows), sum(map(len, words.values())) / max(len(rows), 1)
    terms = {t.lower() for t in terms}
    held = {t: sum(t in w for w in words.values()) for t in terms}
    scored = []
    for c, d, _ in rows:
        counts = Counter(words[c])
        own = [t for t in terms if counts[t]]
        if len(own) >= (len(terms) if all_terms else 1):
            if by == "hits":
                score = float(sum(counts[t] for t in own))
            else:
                score = sum(math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) * counts[t] * 2.2 / (counts[t] + 1.2 * (0.25 + 0.75 * len(words[c]) / mean)) for t in own)
            scored.append((-round(score, 9), c, d))
    return [(c, d, round(-s, 6)) for s, c, d in sorted(scored)[:k]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    frame = spark.createDataFrame([(*r, "t", 1) for r in chunks_of(400)], "chunk_id string, document_id long, text string, term string, bucket int").repartition(3)
    return postings.build(frame, f"file://{tmp_path_factory.mktemp('index')}", size=8, shards=5)


@pytest.mark.parametrize("terms", [["the"], ["The", "of", "the"], ["rare", "ß"], ["sea", "absent"], ["absent"], ["été", "x9", "sea"]])
def test_search(index, terms):
    for by in ("bm25", "hits"):
        for all_terms in (True, False):
            for k in (1, 7, 1000):
                got = [(r["chunk_id"], r["document_id"], round(r["score"], 6)) for r in postings.search(index, terms, k, by, all_terms).collect()]
                assert got == plain(chunks_of(400), terms, k, by, all_terms)


def test_search_without_broadcast(spark, tmp_path):
    """Both the rows of terms and the lists of chunks come through sort-merge joins, of very different sizes."""
    rows = chunks_of(12000, 2)
    index = postings.build(spark.createDataFrame(rows, "chunk_id string, document_id long, text string").repartition(4), f"file://{tmp_path}/i", size=8, shards=5)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {key: spark.conf.get(key, None) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        for by, all_terms in (("hits", True), ("bm25", False)):
            got = [(r["chunk_id"], r["document_id"], round(r["score"], 6)) for r in postings.search(index, ["the", "of", "sea"], 20, by, all_terms).collect()]
            assert got == plain(rows, ["the", "of", "sea"], 20, by, all_terms)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_buckets_below_the_bound_stay_closed(index):
    whole = postings.open_buckets(index, ["the", "of"], 0)
    kth = postings.search(index, ["the", "of"], 3, "hits").collect()[-1]["score"]
    assert whole > 20 and postings.open_buckets(index, ["the", "of"], kth) < 0.7 * whole


def test_positions_give_the_text_back(index):
    words = {}
    ids = {(r["bucket"], i): c for r in index.lists().collect() for i, c in enumerate(json.loads(r["hits"])[0])}
    for r in index.rows.where("term IS NOT NULL").collect():
        at, (slots, counts), (positions,) = 0, postings.unpacked(r["hits"], 2), postings.unpacked(r["positions"], 1)
        assert r["n"] == len(counts) and r["most"] == max(counts)
        for slot, count in zip(slots, counts, strict=True):
            for p in positions[at : at + count]:
                words.setdefault(ids[r["bucket"], slot], {})[p] = r["term"]
            at += count
    assert {c: [w[i] for i in range(len(w))] for c, w in words.items()} == {c: re.findall(r"[^\W_]+", t.lower()) for c, _, t in chunks_of(400) if t and t.strip()}


def test_empty_index(spark, tmp_path):
    frame = spark.createDataFrame([], "chunk_id string, document_id long, text string")
    made = postings.build(frame, f"file://{tmp_path}/i")
    assert made.sizes() == (0, 0.0) and postings.search(made, ["a", "b"], 5).collect() == []


def test_searches_of_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("j1_hybrid_search", "i2_full_text", "i2_bm25", "k5_hybrid_passages", "f5_vector_top_k"):
        assert searches.QUERIES[name](spark, f"file://{tmp_path}").collect() == []


def test_active_chunks(spark, tmp_path):
    """Equal to the catalog's, copies sent or not; without a shuffle of texts where they are sent."""
    rows = [(1, "a b", "x"), (2, "a b", "x"), (3, "a b", "y"), (4, None, "x"), (5, None, "x"), (None, "c d", "x"), (6, "c d", "x"), (7, "e" * 2500, None), (8, "e" * 2500, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = sorted(map(tuple, frame(spark, str(tmp_path), "chunks").collect()))
    assert len(wanted) == 6
    for sent in (0, 100):
        made = searches.active_chunks(spark, str(tmp_path), Workspace(spark, "test"), sent)
        assert sorted(map(tuple, made.collect())) == wanted
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()


def test_one_index_for_the_same_files(spark):
    one = searches.chunk_index(spark, "/root/testdata/sf0.001")
    assert searches.chunk_index(spark, "/root/testdata/sf0.001/") is one


def test_packed_numbers():
    draw = random.Random(3)
    rows = [[[draw.randrange(10 ** draw.randrange(1, 9)) for _ in range(n)] for _ in range(2)] for n in (1, 3, 1, 200, 2)]
    cuts = np.cumsum([0, *(len(r[0]) for r in rows)])
    made = postings._packed([np.concatenate([r[k] for r in rows]) for k in range(2)], cuts)
    assert [[a.tolist() for a in postings.unpacked(x, 2)] for x in made.to_pylist()] == rows
