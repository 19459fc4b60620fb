"""Phrases, similar windows, intervals and one-to-one scores against plain versions."""

import random

import pytest

from lexloom.functions import fuzzy
from lexloom.operators import intervals, phrases

TEXTS = [(1, "The Old Man and the Sea, the old man."), (2, None), (3, ""), (4, " ... "), (5, "M-net Telekommunikations GmbH; m-net"), (6, "a b c d e f g h i"), (7, "naïve Café ÉTÉ café"), (8, "the the the sea"), (9, "ada adaptive ada")]
SURFACES = [("old man", 10), ("The Old Man and the sea", 11), ("the sea", 12), ("m-net", 13), ("m-net telekommunikations gmbh", 14), ("M-NET", 9), ("a b c d e f g h", 15), ("f g h i", 16), ("ab", 17), ("été", 18), ("ada", 19), ("the the", 20), (None, 21), ("", 22), ("sea", None), ("  ", 23)]


def plain_spans(text, surfaces, overlapping):
    words = phrases.words_of(text or "")
    named = {}
    for s, node in surfaces:
        if s is not None and node is not None and len(phrases.normal(s)) >= 3:
            named[phrases.normal(s)] = min(node, named.get(phrases.normal(s), node))
    hits = [(i, j, " ".join(w for _, _, w in words[i:j])) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
    hits = sorted((h for h in hits if h[2] in named), key=lambda h: (-len(h[2]), h[0]))
    kept = []
    for i, j, s in hits:
        if overlapping or not any(i < b and a < j for a, b, _ in kept):
            kept.append((i, j, s))
    return {(words[i][0], words[j - 1][1], s, named[s]) for i, j, s in kept}


@pytest.mark.parametrize("overlapping", [False, True])
def test_linked_spans(spark, overlapping):
    texts = spark.createDataFrame([(i, t, "x", 1, "w") for i, t in TEXTS], "id int, text string, surface string, i int, word string").repartition(3)
    surfaces = spark.createDataFrame(SURFACES, "surface string, node int")
    want = sorted((i, *h) for i, t in TEXTS for h in plain_spans(t, SURFACES, overlapping))
    assert (1, 0, 23, "the old man and the sea", 11) in want
    for sent in (1000, 0):  # as a trie that is sent, and as joined edges
        got = phrases.linked_spans(texts, ["id"], surfaces, overlapping=overlapping, most_sent=sent)
        assert got.columns == ["id", "start", "stop", "surface", "node"]
        assert sorted(map(tuple, got.collect())) == want
        assert phrases.linked_spans(texts, ["id"], surfaces.limit(0), most_sent=sent).count() == 0
        assert phrases.linked_spans(texts.limit(0), ["id"], surfaces, most_sent=sent).count() == 0


def test_linked_surfaces_are_contained(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "text")
    said = {(r[0], r[1]): f" {phrases.normal(r[2] or '')} " for r in texts.collect()}
    surfaces = [(" ".join(t.split()[k : k + n]), k) for k, t in enumerate(said.values()) for n in range(1, 9)]
    got = phrases.linked_spans(texts, ["conv_id", "turn"], spark.createDataFrame(surfaces, "surface string, node int"), overlapping=True)
    assert {(r[0], r[1], r["surface"]) for r in got.collect()} == {(*k, s) for k, t in said.items() for s, _ in surfaces if len(s) >= 3 and f" {s} " in t}


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before if x == y else 1 + min(row[j + 1], row[j])
    return row[-1]


def test_edits_and_pieces():
    draw = random.Random(4)
    for _ in range(300):
        a, b = ("".join(draw.choice("ab c") for _ in range(draw.randrange(1, 90))) for _ in range(2))
        assert fuzzy.edits(a, fuzzy.masks(a), b) == plain_edits(a, b)
    for n in range(1, 200):
        most = fuzzy.most_edits(n, 92)
        assert most == max(d for d in range(n + 1) if any(100 * (1 - d / (n + m)) >= 92 - 1e-9 for m in range(n - d if n > d else 0, n + d + 1)))
        assert len(fuzzy.even_pieces("x" * n, most + 1)) == most + 1
    assert sorted(fuzzy.word_pieces("abcdefgh ij", 3)) == ["ab", "cde", "fgh"] and sorted(fuzzy.word_pieces("abcdefgh ijkl", 3)) == ["abcd", "efgh", "ijkl"]


ALIASES = [("ORG", "acme", "Acme Holding International"), ("ORG", "acme", "acme"), ("PERSON", "jk", "Josef Karl Müller"), ("GPE", "muc", "München"), ("GPE", "x", "St. Pölten/Land"), ("ORG", "c", "C&A"), ("ORG", "plus", "++"), ("ORG", "blank", "  "), ("ORG", "long", "telekommunikationsgesellschaft"), ("PERSON", "ab", "a b"), ("ORG", "acme2", "ACME holding international")]


def changed(draw, name):
    words = name.split(" ")
    if draw.random() < 0.4:
        draw.shuffle(words)
    text = draw.choice([" ", " ", "\n", "  "]).join(words)
    for _ in range(draw.randrange(4)):
        k = draw.randrange(len(text) + 1)
        text = draw.choice([text[:k] + text[k + 1 :], text[:k] + draw.choice("xe -") + text[k:], text.upper()])
    return text


def plain_alias_hits(text, aliases, threshold=92.0):
    low, best = phrases.lowered(text), {}
    tokens = [(m.start(), m.end()) for m in phrases.TOKEN.finditer(low)]

    def put(start, stop, label, canonical, alias, score, source):
        key = (start, stop, label, canonical)
        if key not in best or (-score, alias) < (-best[key][5], best[key][4]):
            best[key] = (start, stop, label, canonical, alias, score, source)

    for label, canonical, alias in set(aliases):
        a = phrases.lowered(alias)
        if not a.strip():
            continue
        at, last = low.find(a), 0
        while at >= 0:
            edge = phrases._word(a[0]) and phrases._word(a[-1])
            free = not edge or not (at and phrases._word(low[at - 1]) or at + len(a) < len(low) and phrases._word(low[at + len(a)]))
            if free and at >= last:
                put(at, at + len(a), label, canonical, alias, 0.985, "exact")
                last = at + len(a)
            at = low.find(a, at + 1)
        size = len(phrases.TOKEN.findall(a))
        for n in {max(1, size - 1), size, size + 1} if size else ():
            for i in range(len(tokens) - n + 1):
                window = low[tokens[i][0] : tokens[i + n - 1][1]]
                if window == a:
                    continue
                b, c = " ".join(sorted(a.split())), " ".join(sorted(window.split()))
                score = max(100 * (1 - plain_edits(a, window) / (len(a) + len(window))), 95 * (1 - plain_edits(b, c) / (len(b) + len(c))))
                if score >= threshold:
                    put(tokens[i][0], tokens[i + n - 1][1], label, canonical, alias, score / 100, "fuzzy")
    return sorted(best.values())


def test_fuzzy_aliases_find_every_window(spark):
    draw = random.Random(11)
    filler = ["und", "the", "Haus", "c&a", "a", "b", "++", "land."]
    texts = [(i, " ".join(draw.choice([changed(draw, draw.choice(ALIASES)[2]), draw.choice(filler)]) for _ in range(12))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "İSTANBUL München"), (103, "acme " * 3000)]
    want = sorted((i, *h) for i, t in texts for h in plain_alias_hits(t or "", ALIASES))
    assert sum(h[-1] == "fuzzy" for h in want) > 60
    frame = spark.createDataFrame([(i, t, "l") for i, t in texts], "id int, text string, label string").repartition(3)
    aliases = spark.createDataFrame([*ALIASES, ("ORG", "null", None)], "label string, canonical string, alias string")
    for sent in (1000, 3):  # at once, and in blocks
        got = [tuple(r) for r in phrases.alias_hits(frame, ["id"], aliases, most_sent=sent).collect()]
        assert [(*h[:6], round(h[6], 9), h[7]) for h in sorted(got)] == [(*h[:6], round(h[6], 9), h[7]) for h in want]
    assert phrases.alias_hits(frame, ["id"], aliases.limit(0)).count() == 0


def test_overlapping_intervals(spark):
    draw = random.Random(2)

    def rows(n):
        return [(k % 3, a, a + draw.choice([0, 1, 5, 300]), k) for k in range(n) for a in [draw.randrange(900)]]

    left, right = rows(120), rows(90)
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2]))
    one, two = spark.createDataFrame(left, "k int, a int, b int, x int"), spark.createDataFrame(right, "k int, c int, d int, y int")
    for width in (1, 7, 256, 5000):
        assert sorted((r["x"], r["y"]) for r in intervals.overlapping(one, two, ["k"], ("a", "b"), ("c", "d"), width).collect()) == want


def test_rules_need_their_trigger_in_the_sentences(spark):
    texts = ["Anna works with Bernd. Later Clara came. She is a friend of Dieter", "Egon\nmit Frieda", "Gerda! with! Hans", "with"]
    rows = [(i, *p) for i, t in enumerate(texts) for p in intervals.placed_matches(t, [p for _, _, p in _parts()])]
    frame = spark.createDataFrame(rows, "document_id int, pattern int, number int, s_start int, s_stop int, start int, stop int")
    mentions = frame.where("pattern = 0").drop("pattern")
    triggers = frame.where("pattern > 0").selectExpr("document_id", "number", "CASE pattern WHEN 1 THEN 'with' ELSE 'is' END AS predicate", "double(0.5) AS score")
    sentences = spark.createDataFrame([(i, *s) for i, t in enumerate(texts) for s in intervals.sentences_of(t)], "document_id int, number int, s_start int, s_stop int")
    again = intervals.placed(mentions.select("document_id", "start", "stop"), sentences)  # mentions from elsewhere
    assert sorted(map(tuple, again.select(*mentions.columns).collect())) == sorted(map(tuple, mentions.collect()))
    for reach in (8, 60):
        got = sorted((r["document_id"], texts[r["document_id"]][r["a_start"] : r["a_stop"]], texts[r["document_id"]][r["b_start"] : r["b_stop"]], r["predicate"], texts[r["document_id"]][r["evidence_start"] : r["evidence_stop"]].strip()) for r in intervals.rule_relations(mentions, triggers, reach).collect())
        want = []
        for i, t in enumerate(texts):
            spans = [(m.start(), m.end()) for m in _parts()[0][2].finditer(t)]
            for x, a in enumerate(spans):
                for b in spans[x + 1 :]:
                    if abs(b[0] - a[1]) <= reach:
                        s0 = max(t.rfind(c, 0, a[0]) for c in ".!?\n") + 1
                        s1 = min([t.find(c, b[1]) for c in ".!?\n" if t.find(c, b[1]) >= 0], default=len(t)) + 1
                        want += [(i, t[slice(*a)], t[slice(*b)], name, t[s0:s1].strip()) for _, name, p in _parts()[1:] if p.search(t[s0:s1])]
        assert got == sorted(want)


def _parts():
    import re

    return [("m", "", re.compile(r"\b[A-Z][a-z]{3,}\b")), ("t", "with", re.compile(r"\b(with|mit)\b")), ("t", "is", re.compile(r"\bis a\b"))]


def test_relaxed_scores(spark):
    draw = random.Random(8)
    words = ["red", "red red", "blue red", "blue", "green blue", "green", "red green blue", "", " "]
    gold, found = ([(i % 4, draw.choice("AB"), draw.choice(words)) for i in range(40)] for _ in range(2))
    want = {}
    for key in {g[:2] for g in gold + found}:
        g, f = ({v for *k, v in rows if tuple(k) == key} for rows in (gold, found))
        exact, free, paired = g & f, set(f - g), 0
        for x in sorted(g - exact):
            sets = [y for y in sorted(free) if x.split() and y.split() and (set(x.split()) <= set(y.split()) or set(y.split()) <= set(x.split()))]
            if sets:
                free.discard(sets[0])
                paired += 1
        for label in (key[1], ""):
            want[label] = [a + b for a, b in zip(want.get(label, [0] * 4), [len(g), len(f), len(exact), len(exact) + paired], strict=True)]
    both = spark.createDataFrame([(*r, True, 1) for r in gold] + [(*r, False, 2) for r in found] + [(1, None, "x", True, 1), (1, "A", None, True, 1)], "document_id int, label string, value string, is_gold boolean, gold int").repartition(4)
    rows = {r["label"]: r for r in intervals.mention_scores(intervals.mention_lists(both, ["document_id"]), ["document_id"]).collect()}
    assert {k: [r["gold"], r["found"], r["exact"], r["relaxed"]] for k, r in rows.items()} == want
    assert abs(rows[""]["relaxed_f1"] - 2 * want[""][3] / (want[""][0] + want[""][1])) < 1e-12
    empty = intervals.mention_scores(intervals.mention_lists(both.limit(0), ["document_id"]), ["document_id"]).collect()
    assert [r["relaxed_f1"] for r in empty] == [0.0]


def test_contained(spark):
    texts = [(1, "der ring am ringen"), (2, "r"), (3, None), (4, ""), (5, "Ring ä😀b"), (5, "am ring"), (6, "ringring " * 50_000)]
    needles = ["ring", "ringen", "am ri", "r", "ä😀", "nichts", "", None, "ring"]
    rows = spark.createDataFrame(texts, "id int, text string")
    named = spark.createDataFrame([(n,) for n in needles], "needle string")
    wanted = sorted((i, n) for i, t in texts for n in set(needles) if n and t and n in t)
    for most_chars in (1 << 20, 5):  # in one pass, in several
        assert sorted(tuple(r) for r in phrases.contained(rows, ["id"], named, most_chars=most_chars).collect()) == wanted
    assert not phrases.contained(rows, ["id"], named.limit(0)).collect()
