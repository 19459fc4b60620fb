"""Training reads whole texts."""

from lexloom.llm import toxicity


def test_training_texts_are_whole(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 9, 9)[0] == [text, "short"]
