"""Exact owners, spelling variants and centroid clusters against brute force, on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import centroids, exactdedup, spelling
from lexloom.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, child string, ref string, hash string, n string, keep_id string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "c", "r", "h", "n", "k") for i, t in rows], SCHEMA).repartition(parts)


def brute_owners(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


OWNED = [(1, "a b"), (2, "a  b"), (3, "a\t\nb"), (4, " a b"), (5, None), (6, ""), (7, " "), (8, "\n\n"), (9, "a b"), (10, "A b"), (11, "日本 \U0001f600"), (11, "日本 \U0001f600"), (None, "a b"), (None, "only"), (None, "only"), (12, "x " * 50000), (13, "x  " * 50000), (14, "ab"), (15, "a b c"), (-3, "ab")]


@pytest.mark.parametrize("trie_bytes", [1, 3000, 64 << 20])
@pytest.mark.parametrize("fan_in", [1, 32])
def test_exact_owners(spark, trie_bytes, fan_in):
    rows = OWNED + [(100 + i, f"copy {i % 3}") for i in range(300)]
    for most in (0, 100_000):
        got = exactdedup.exact_owners(frame(spark, rows, 5), trie_bytes=trie_bytes, fan_in=fan_in, most_broadcast=most)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_owners(rows)


def test_exact_owners_of_table(spark):
    docs = table(spark, SF, "documents")
    got = sorted(map(tuple, exactdedup.exact_owners(docs, trie_bytes=20_000).collect()), key=repr)
    assert got == brute_owners([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert exactdedup.exact_owners(docs.limit(0)).collect() == []


def test_equal_hashes_keep_texts_apart():
    trie = exactdedup.Trie()
    words = [b"", b"a", b"ab", b"abc", b"b", b"abd" * 1000, b"abd" * 999 + b"abe"]
    for w in [*words, *words]:
        node = trie.insert(exactdedup.head(7, -5) + w)
        node.owner = (node.owner or 0) + 1
    found = {k[exactdedup.HEAD :]: n for k, n in trie.all()}
    assert found == dict.fromkeys(words, 2) and trie.held <= 0 + trie.NODE * 8


def test_heads_sort_like_their_numbers():
    pairs = [(s, h) for s in (0, 1, 255, 256, 1 << 40) for h in (-(1 << 63), -1, 0, 1, (1 << 63) - 1)]
    assert sorted(pairs) == sorted(pairs, key=lambda x: exactdedup.head(*x))


def test_spill_keeps_what_is_under_the_bound():
    trie, rng = exactdedup.Trie(), np.random.default_rng(3)
    keys = {exactdedup.head(int(n), int(h)) + bytes(n) for n, h in zip(rng.integers(1, 500, 400), rng.integers(-(2**62), 2**62, 400), strict=True)}
    for k in keys:
        trie.insert(k).owner = 1
    upto = trie.held // 3
    spilled = {k for k, _ in trie.heaviest(upto)}
    assert trie.held <= upto and spilled and spilled | {k for k, _ in trie.all()} == keys


def brute_variants(rows, ratio=10):
    counts = Counter()
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    gaps = {}
    for w in words:
        for k in range(len(w)):
            gaps.setdefault(w[:k] + "*" + w[k + 1 :], set()).add(w)
            if w[:k] + w[k + 1 :] in words:
                gaps.setdefault(w, set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            near[w] |= gaps[w[:k] + "*" + w[k + 1 :]]
            short = w[:k] + w[k + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
        near[w].discard(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), near


def variants(docs, **more):
    got = spelling.spelling_variants(docs, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, got.collect()))


def test_spelling_variants_of_table(spark):
    docs = table(spark, SF, "documents")
    expected, near = brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(expected) > 300 and sum(map(len, near.values())) > 100
    assert variants(docs) == expected
    assert variants(docs.limit(0)) == []


def test_spelling_variants_awkward(spark):
    long, giant = "abcdefg" * 40, "lm" * 3000
    many = ["elephant " * 1200, "elephnat elephan elephants elephantss Elephant" * 2, "élephant ÉLEPHANT Éléphant " * 2, "xelephant " * 110, "xelephants " * 9, "yelephant yelephant " * 3]
    letters = " ".join(f"{a}olibrix {a}olibrix k{a}libris k{a}libris" for a in "abcdefghijklmnopqrstuvwxyzé÷×ÿ")
    texts = [*many, letters, f"{long} {long} {long}x {long}x {long[:100]}q{long[101:]} " * 2, f"{giant} {giant[1:]} {giant}m " * 2, "aaaaaaa aaaaaaaa aaaaaaaaa " * 2, "short 日本語 naïve word-word_word don't ", None, ""]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts)] + [(3, many[2]), (3, many[2])]
    expected, _ = brute_variants(rows)
    assert {"elephant", "éÉphant", giant} & {w for w, *_ in expected} and any(r[2] != r[1] and r[1] for r in expected)
    assert variants(frame(spark, rows, 4)) == expected


def test_checksums_and_runs():
    texts = ["Ab cé", "", "é", "x" * 200 + " y", "日é本ab", "ab", "cd"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    row, start, length, points = spelling.letter_runs(data, offsets)
    words = [bytes(data[s : s + n]).decode() for s, n in zip(start, length, strict=True)]
    assert list(zip(row.tolist(), words, strict=True)) == [(r, w) for r, t in enumerate(texts) for w in re.findall("[A-Za-zÀ-ÿ]+", t)]
    assert points.tolist() == [len(w) for w in words]
    seeds = np.array([zlib.crc32(b"%d:" % r) for r in row], np.uint32)
    assert spelling.checksums(data, start, length, seeds).tolist() == [zlib.crc32(f"{r}:{w}".encode()) for r, w in zip(row, words, strict=True)]


def test_light_subtrees_grow_with_the_logarithm(spark):
    words = spark.createDataFrame([(w, 2) for w in sorted({f"{a}{b}{c}tail{d}" for a in "abcd" for b in "efgh" for c in "ijkl" for d in "mnopq"})], "word string, n long")
    n = words.count()
    merged = spelling.merged_terminals(words, spelling.heavy_children(words)).where(f"kind = {spelling.REPLACED}")
    assert merged.groupBy("word").count().agg({"count": "max"}).first()[0] <= np.log2(n)


def brute_clusters(rows, k=16, rounds=3, dim=64):
    kept = [(i, [int(np.floor(np.float64(x) * 64)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 27), min(1 << 27, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]

    def assign(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centers]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [assign(v)[0] for _, v in kept]
        for c in range(len(centers)):
            own = [v for (_, v), x in zip(kept, at, strict=True) if x == c]
            if own:
                centers[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *assign(v)) for i, v in kept]
    within = Counter()
    for _, c, d in found:
        within[c] += d
    total = sum(within.values())
    return sorted(((i, c, d, within[c], total, hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def clusters(vectors, **more):
    got = centroids.clusters(vectors, **more)
    rows = got.collect()
    return sorted((tuple(r)[:6] for r in rows), key=repr), sum(r["scanned"] for r in rows), len(rows)


def test_clusters_of_table(spark):
    vectors = table(spark, SF, "embeddings")
    got, scanned, n = clusters(vectors)
    assert got == brute_clusters([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    assert scanned < n * 16 * 4  # bounds spare few distances of vectors that lie anyhow
    assert clusters(vectors.limit(0))[0] == []


def test_clusters_awkward(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 64)) * 3
    rows = [(i, [float(x) for x in base[i % 6] + rng.normal(size=64) * (0.02 if i % 2 else 0)]) for i in range(240)]
    rows += [(7, rows[8][1]), (7, rows[9][1]), (None, rows[3][1]), (300, None), (301, []), (302, [0.0] * 63), (303, [0.0] * 63 + [None]), (304, [0.0] * 63 + [float("nan")]), (305, [0.0] * 63 + [float("inf")]), (306, [0.0] * 64), (307, [1e30] * 32 + [-1e30] * 32)]
    schema = "vec_id long, embedding array<double>, cluster string, v string, upper string"
    for some in (rows, rows[:9], rows[:1], [r for r in rows if r[0] in (None, 7)]):
        given = spark.createDataFrame([(*r, "c", "v", "u") for r in some], schema).repartition(3)
        for groups in (1, 4, 16):
            assert clusters(given, groups=groups)[0] == brute_clusters(some)


def test_bounds_spare_most_scans_where_clusters_are_apart(spark):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(16, 64)) * 5
    rows = [(i, [float(x) for x in middle[i % 16] + rng.normal(size=64) * 0.1]) for i in range(2000)]
    got, scanned, n = clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == brute_clusters(rows) and scanned < 0.6 * n * 16 * 4
