"""The pipeline: each stage against what its operator says of the stage's own input, run() against the stages, awkward tables."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from lexloom.llm import mixing, quality, toxicity
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    given, inputs = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = given
        stage(spark, given, SF).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        assert name == corpus_pipeline.STAGES[-1][0] or given.columns == documents.columns
    ids = lambda frame: Counter(r["doc_id"] for r in frame.select("doc_id").collect())
    clean = toxicity.score(inputs["toxicity"], toxicity.fit(inputs["toxicity"], labels)).where("score < 0.5")
    good = quality.scored(inputs["quality"], quality.fit(inputs["quality"], labels)).where("score >= 0.7").select("row.doc_id")
    assert ids(inputs["quality"]) == ids(clean) and ids(inputs["near_copies"]) == ids(good)
    rows = [(r["doc_id"], r["text"]) for r in inputs["near_copies"].collect()]
    assert ids(inputs["mixing"]) == Counter({component: 1 for _, _, component in brute_components(rows)})
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(inputs["mixing"]).where("size > 0").collect()}
    assert ids(inputs["packing"]) == Counter({i: int(x + 0.5) for i, x in taken.items() if int(x + 0.5)})
    from tokenizers import Tokenizer

    from lexloom.llm.queries import _tokenizer

    plain = Tokenizer.from_file(_tokenizer("byte_bpe_50k.json"))
    whole = sum(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in inputs["packing"].collect())
    assert given.agg(F.sum("length")).first()[0] == whole
    pieces = lambda frame: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in frame.collect())
    assert pieces(corpus_pipeline.run(spark, SF)) == pieces(given)


def test_stages_on_awkward_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, own_id string, size string"
    good = "these are plain words that stand in a row and say something of use to whoever reads them on a quiet day"
    rows = [(1, good), (1, good), (2, good.upper()), (3, None), (3, None), (4, ""), (5, " \n"), (None, good + " once more"), (6, "w " * 3000), (7, "two words")]
    docs = spark.createDataFrame([(i, t, None, None if (i or 0) % 2 else "s", 0, "r", "k", "o", "z") for i, t in rows], schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, frame, SF)
            n, least = got.count(), 0
            if name == "near_copies":
                least = 7 if frame is docs else 0  # copies of one text, and what is near it, are one; rows without words all stay
                assert n == least
            if name == "packing":
                assert n >= frame.count()
            elif frame is docs:
                assert got.columns == docs.columns
