"""Folded merge patches against a plain walk over the patches."""

import json
import random

from lexloom.operators import patches


def merge(target, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for name, value in patch.items():
        if value is None:
            out.pop(name, None)
        else:
            out[name] = merge(out.get(name), value)
    return out


def random_value(rng, level=0):
    kind = rng.random()
    if kind < 0.5 and level < 4:
        return {rng.choice(["a", "b", "c/d", "e~f", "é", ""]): random_value(rng, level + 1) for _ in range(rng.randint(0, 3))}
    return rng.choice([None, None, 1, 2.5, "x", "a\"b", True, [], [1, {"a": None}], "\n"])


def fold(spark, rows, schema="id long, at long, patch string"):
    return {r["id"]: r["document"] for r in patches.merged_documents(spark.createDataFrame(rows, schema), ["id"], "at", "patch").collect()}


def test_against_walk(spark):
    rng, rows, want = random.Random(5), [], {}
    for key in range(150):
        state = None
        for at in range(rng.randint(1, 12)):
            patch = random_value(rng)
            state = merge(state, patch)
            rows.append((key, at, json.dumps(patch)))
        want[key] = state
    rng.shuffle(rows)
    got = fold(spark, rows + rows[:50])
    assert set(got) == set(want)
    for key, text in got.items():
        assert (None if text is None else json.loads(text)) == want[key], key


def test_published_cases(spark):
    # the first text is a patch too, applied to nothing, so a null in it leaves nothing
    cases = [('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'), ('{"a":"b"}', '{"a":null}', "{}"), ('{"a":"b","b":"c"}', '{"a":null}', '{"b":"c"}'),
             ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"c"}', '{"a":["b"]}', '{"a":["b"]}'), ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'), ('{"a":[{"b":"c"}]}', '{"a":[1]}', '{"a":[1]}'),
             ('["a","b"]', '["c","d"]', '["c","d"]'), ('{"a":"b"}', '["c"]', '["c"]'), ('{"a":"foo"}', "null", None), ('{"a":"foo"}', '"bar"', '"bar"'), ('{"e":null}', '{"a":1}', '{"a":1}'), ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'), ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}')]
    rows = [(i, at, text) for i, case in enumerate(cases) for at, text in enumerate(case[:2])]
    assert fold(spark, rows) == {i: case[2] for i, case in enumerate(cases)}


def test_odd_patches(spark):
    deep = '{"a":' * 600 + "1" + "}" * 600
    rows = [(1, 0, '{"n": 1.50, "big": 123456789012345678901234567890, "a": 1, "a": 2}'), (1, 1, "{bad"), (1, 2, None), (1, 3, "NaN"), (1, 4, deep), (1, 5, '{"s": "\\ud800"}'), (2, 0, "no"), (None, 0, '{"x": {"y": 1}}'), (None, 1, '{"x": {"z": 2}}'), (3, None, '{"a": 1, "b": 1}'), (3, 0, '{"a": 2}')]
    assert fold(spark, rows) == {1: '{"a":2,"big":123456789012345678901234567890,"n":1.50}', None: '{"x":{"y":1,"z":2}}', 3: '{"a":2,"b":1}'}
    assert fold(spark, []) == {}


def test_hot_document(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("7L AS id", "id AS at", """concat('{"last":', id, ',"by":{"', id % 50, '":', id, '},"gone":', CASE WHEN id % 2 = 0 THEN '1' ELSE 'null' END, '}') AS patch""")
    got = json.loads(patches.merged_documents(rows, ["id"], "at", "patch").first()["document"])
    assert got == {"last": n - 1, "by": {str(i): n - 50 + i for i in range(50)}}
