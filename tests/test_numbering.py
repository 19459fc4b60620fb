"""Telephone numbers by numbering plans."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import identifiers, numbering


def longest_prefix(plans: dict[str, set[int]], digits: str) -> bool:
    named = [digits[:k] for k in range(len(digits), 0, -1) if digits[:k] in plans]
    return bool(named) and len(digits) in plans[named[0]]


def test_no_two_lines_share_a_prefix():
    prefixes = [p for code, lead, _ in numbering.lines() for p in numbering.spelled(code + lead)]
    assert len(prefixes) == len(set(prefixes))


def test_pattern_is_the_longest_prefix(spark):
    plans = {p: {len(code) + n for n in lengths} for code, lead, lengths in numbering.lines() for p in numbering.spelled(code + lead)}
    rng = random.Random(5)
    starts = sorted(plans) + [""] * 200
    cases = [rng.choice(starts) + "".join(rng.choice("0123456789") for _ in range(rng.randint(0, 13))) for _ in range(20_000)]
    got = {r["d"]: r["ok"] for r in spark.createDataFrame([(c,) for c in cases], "d string").select("d", numbering.planned(F.col("d")).alias("ok")).collect()}
    wrong = [d for d, ok in got.items() if ok != longest_prefix(plans, d)]
    assert not wrong and 1_000 < sum(got.values()) < 19_000


FOUND = [
    ("Telefon: 040 7654321", ["+49407654321"]),
    ("Erreichbar unter +49 40 765432", ["+4940765432"]),
    ("Phone 0221/765432 oder Fax 0221/765433.", ["+49221765432", "+49221765433"]),
    ("Fax: +49 (0)40 76 54 32 1", ["+49407654321"]),
    ("Zentrale 0049 40 7654321 (werktags)", ["+49407654321"]),
    ("Mobil: 0171 7654321", ["+491717654321"]),
    ("call +1 (212) 555-0188 or +44 20 7946 0018", ["+12125550188", "+442079460018"]),
    ("Roma +39 06 6988 1234, Paris +33 1 70 18 99 00", ["+390669881234", "+33170189900"]),
    ("Tel.: +49 40 7654321 - 2024 Blatt 7", ["+49407654321"]),
    ("+1 (212) 555-0188 12 Stück", ["+12125550188"]),
    ("Tel. (040) 765432", ["+4940765432"]),
]
NONE = [
    "Rechnung 2025-1234-040765",
    "Auftrag: 040 7654321",
    "Artikel 1234-0567, Stück 20",
    "Kunde 9876543210",
    "Blatt 2 von 9, Beleg 20250131",
    "Im Motel 040 wohnen",
    "+999 12345678",
    "+1 (123) 555-0188",
    "+49 1234",
    "+33 1 70 18",
    "+000000000",
    "",
]


@pytest.mark.parametrize("text, wanted", FOUND)
def test_recall(spark, text, wanted):
    row = spark.createDataFrame([(text,)], "t string").select(identifiers.phone_spans(F.col("t")).alias("x")).first()
    assert [text[s["start"] : s["end"]] for s in row["x"]] == [s["value"] for s in row["x"]]
    values = spark.createDataFrame([(s["value"],) for s in row["x"]], "v string").select(numbering.e164(F.col("v")).alias("n")).collect()
    assert sorted(r["n"] for r in values) == sorted(wanted)


def test_no_false_number(spark):
    rows = spark.createDataFrame([(t,) for t in NONE] + [(None,)], "t string").select("t", identifiers.phone_spans(F.col("t")).alias("x"))
    assert not [r["t"] for r in rows.collect() if r["x"]]


def test_digits_of_an_iban_are_no_number(spark):
    text = "Tel: IBAN DE89 3704 0044 0532 0130 00, Telefon 040 7654321"
    found = spark.createDataFrame([(text,)], "t string").select(identifiers.identifiers(F.col("t")).alias("x")).first()["x"]
    assert [(s["kind"], s["value"]) for s in found] == [("IBAN", "DE89370400440532013000"), ("PHONE", "+49407654321")]
