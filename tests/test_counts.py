"""Counts cover all documents."""

from lexloom.catalog import frame
from lexloom.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_counts_by_document(spark):
    assert QUERIES["d8_counts_by_document"](spark, SF).count() == frame(spark, SF, "entities").select("document_id").distinct().count()
