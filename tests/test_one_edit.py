"""Pairs within one edit against brute force."""

import random

from lexloom.functions.names import one_edit_pairs


def one_edit(a, b):
    cuts = [(a[:i], a[i:]) for i in range(len(a) + 1)]
    near = {x + y[1:] for x, y in cuts if y} | {x + c + y[1:] for x, y in cuts if y for c in set(b)} | {x + c + y for x, y in cuts for c in set(b)} | {x + y[1] + y[0] + y[2:] for x, y in cuts if len(y) > 1}
    return b in near



def test_one_edit_pairs(spark):
    random.seed(1)
    values = sorted({"".join(random.choices("ab", k=random.randint(0, 5))) for _ in range(60)} | {"xabcdefgh", "abcdefgh", "abcdefhg", "ybcdefgh"})
    got = [(r["first"], r["second"]) for r in one_edit_pairs(spark.createDataFrame([(v,) for v in values], "value string")).collect()]
    assert sorted(got) == [(a, b) for a in values for b in values if a < b and one_edit(a, b)]
