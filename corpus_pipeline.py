"""A training-corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

toxicity and quality drop what their classifiers reject, near_copies keeps one document of each group of near copies,
mixing takes documents (some several times) until sources meet their target weights, packing cuts what is left into
sequences. All stages but the last return the columns of documents. Classifiers learn from the labels table.
"""

from lexloom.llm import jaccard, mixing, packing, quality, toxicity
from lexloom.llm.common import Workspace, table


def drop_toxic(spark, docs, sf_dir):
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark, docs, sf_dir):
    return quality.without_poor(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark, docs, sf_dir):
    return jaccard.without_near_copies(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL cannot express the classifiers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for the documents of sf_dir."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if i:
            ws.drop(STAGES[i - 1][0])
    return docs
