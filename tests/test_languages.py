"""The language model against a plain walk, on held-out rows, and on odd texts."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from lexloom.operators import languages
from lexloom.workspace import Workspace

ROWS = [("en", "the cat and the dog are in the house"), ("en", "this is the thing that they have"), ("fr", "le chat et le chien sont dans la maison"), ("fr", "c'est une chose que nous avons"), ("de", "der Hund und die Katze sind im Haus"), (None, "nothing is learned from this")]


def grams(word):
    padded = f" {word} "
    return [*word, *(padded[i : i + 2] for i in range(len(word) + 1)), *(padded[i : i + 3] for i in range(len(word)))]


def walk(rows, texts):
    counts = {}
    for lang, text in rows:
        if lang is not None and text is not None:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                counts.setdefault(lang, Counter()).update(grams(word))
    kinds = Counter(len(g) for g in set().union(*counts.values()))

    def score(lang, text):
        total = Counter()
        for g, n in counts[lang].items():
            total[len(g)] += n
        part = lambda x: round(math.log(x) * 1e6)
        return sum(part(counts[lang][g] + 1) - part(total[len(g)] + kinds[len(g)]) for w in re.findall(r"[^\W\d_]+", text.lower()) for g in grams(w))

    out = []
    for text in texts:
        known = text is not None and len(text.strip(" ")) >= 20 and re.search(r"[^\W\d_]", text)
        out.append(min(counts, key=lambda lang: (-score(lang, text), lang)) if known else "unknown")
    return out


def answers(spark, rows, texts, head=languages.HEAD):
    ws = Workspace(spark, "languages")
    model = languages.Model(languages.gram_counts(languages.word_counts(spark.createDataFrame(rows, "lang string, text string"))), ws)
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id long, text string, lang string").withColumn("language", F.lit("x"))
    return [r["language"] for r in languages.detected(docs, model, languages.word_counts(docs), ws, head=head).orderBy("id").collect()]


def test_against_walk(spark):
    texts = ["the house of the cat is there", "la maison du chat est grande", "das Haus der Katze ist im Garten", None, "", "short", "   the cat           ", "12345 67890 12345 67890", "zzzzz qqqqq xxxxx wwwww", "Ärger über Öl und Straßen", "the cat and le chat et der Hund", "the house of the cat is there"]
    assert answers(spark, ROWS, texts) == answers(spark, ROWS, texts, head=3) == walk(ROWS, texts)


def test_no_labels(spark):
    assert answers(spark, [(None, "x")], ["a text that is long enough"]) == ["unknown"]
    assert answers(spark, ROWS, []) == []
    assert answers(spark, ROWS[:1], ["a text that is long enough"]) == ["en"]


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    ws = Workspace(spark, "languages")
    model = languages.Model(languages.gram_counts(languages.word_counts(docs.where("NOT held"))), ws)
    held = docs.where("held")
    found = languages.detected(held, model, languages.word_counts(held), ws, head=500).where("language <> 'unknown'")
    right, n = found.agg(F.sum((F.col("lang") == F.col("language")).cast("int")), F.count("*")).first()
    assert n > 150 and right >= 0.95 * n, (right, n)
