"""No window over a whole table."""

import re

import pytest

from lexloom.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["k11_rerank_threshold", "e3_cross_source_rank", "f3_select_all_ids", "c3_mentions"])
def test_no_window_over_all(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\((specifiedwindowframe|[^,()]* (ASC|DESC))", plan)
