"""The ten operators against brute force, round trips and held-out accuracy, on awkward rows."""

import gzip
import hashlib
import re
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import fingerprint, jaccard, mixing, packing, quality, scoring, tokens, topk, toxicity, warc
from lexloom.llm.common import Workspace
from lexloom.llm.queries import _tokenizer
from lexloom.llm.words import text_slices, word_spans

SF = "/root/testdata/sf0.001"
BASE = "the quick brown fox jumps over the lazy dog and runs away from the farm while it rains all day long in the green hills of home"
TEXTS = [(1, BASE), (2, BASE), (3, BASE.replace("hills", "fields")), (4, None), (5, ""), (6, " \t\n"), (7, "One two"), (8, "one TWO"), (9, "x " * 30000), (10, "naïve café 日本語 \U0001f600 end"), (11, BASE), (11, BASE), (12, "a b c")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, n string"


def rows_of(texts):
    return [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), "w", "k", "n") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = word_list(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_near_components(docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_components(docs).collect())
    assert got == brute_components(TEXTS)


def test_near_components_of_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_components(table).collect())
    assert got == brute_components([(r["doc_id"], r["text"]) for r in table.collect()])


@pytest.mark.parametrize("long_list", [10_000, 100])
def test_near_components_in_blocks(spark, long_list):
    """Groups of more rows than a block holds: near copies of one text with, and of another without, a row that all are near to."""
    random = np.random.default_rng(4)
    words = np.array(["".join(chr(97 + int(x)) for x in random.integers(0, 26, 6)) for _ in range(200)])
    first, second = random.choice(words, 60, replace=False), random.choice(words, 60, replace=False)
    rows = [(0, " ".join(first))]
    for i in range(1, 7001):
        text = (first if i <= 3500 else second).copy()
        text[int(random.integers(0, 60))] = f"q{i}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.labelled_components(spark.createDataFrame(rows, "doc_id long, text string"), long_list=long_list).collect()}
    assert {got[i] for i in range(3501)} == {0}
    sets = [({tuple(w[k : k + 5]) for k in range(56)}) for w in (t.split() for _, t in rows[3501:])]
    label = list(range(3500))
    places = [next(k for k in range(60) if t.split()[k].startswith("q") and t.split()[k][1:].isdigit()) for _, t in rows[3501:]]
    for k in range(60):  # rows changed at one place are near each other; so are rows changed at places near enough
        for other in range(60):
            a, b = (next((i for i, p in enumerate(places) if p == x), None) for x in (k, other))
            if a is not None and b is not None and a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(label, a), find(label, b)))
                label[high] = low
    by_place = {}
    for i, p in enumerate(places):
        by_place.setdefault(p, []).append(i)
    for members in by_place.values():
        if len(members) > 1 and 100 * len(sets[members[0]] & sets[members[1]]) >= 80 * len(sets[members[0]] | sets[members[1]]):
            for m in members[1:]:
                low, high = sorted((find(label, members[0]), find(label, m)))
                label[high] = low
    least = {}
    for i in range(3500):
        least.setdefault(find(label, i), 3501 + i)
    assert [got[3501 + i] for i in range(3500)] == [least[find(label, i)] for i in range(3500)]


def find(label, i):
    while label[i] != i:
        i = label[i]
    return i


def test_fingerprints(docs):
    got = fingerprint.edit_fingerprints(docs).collect()
    ordered = sorted(TEXTS, key=lambda x: -x[0])
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)
    want = Counter()
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        want[i, hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest(), len(text)] += 1
    assert Counter((r["doc_id"], r["edited_sha256"], r["n_chars"]) for r in got) == want
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 11)}) == 1
    near = {(r["doc_id"], r["n_chars"]): (r["near_edited"], r["near_next"]) for r in got}
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        want = (brute_likeness(text, fingerprint.edited(text, following)), brute_likeness(text, following))
        assert near[i, len(text)] == pytest.approx(want) or i == 11  # rows of one id stand in either order


def test_fingerprints_of_shared_ids(spark):
    """A third of all rows has one id, a third has none: their order is that of a hash of the text."""
    rows = [(i if i % 3 == 0 else 40 if i % 3 == 1 else None, f"text {i} " * (1 + i % 7)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = frame.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()).collect()
    want = Counter()
    for k, row in enumerate(ordered):
        want[row["doc_id"], hashlib.sha256(fingerprint.edited(row["text"], ordered[(k + 1) % len(ordered)]["text"]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprint.edit_fingerprints(frame).collect()) == want
    rows_of_segment = fingerprint.with_next(frame).groupBy("segment").count()
    assert rows_of_segment.agg(F.max("count")).first()[0] <= 60


def brute_likeness(a, b):
    """Share of paragraphs in both, from the two lists of digests."""
    a, b = (Counter(fingerprint.paragraphs([x])[1].tolist()) for x in (a, b))
    total = sum(a.values()) + sum(b.values())
    return 1 - sum(((a - b) + (b - a)).values()) / total if total else 1.0


def test_sketches_decode_large_differences():
    """Peeling, with larger sketches where it fails, gives the exact difference of sets."""
    random = np.random.default_rng(5)
    a, b = [], []
    for shared, only in ((0, 0), (50, 3), (10, 400), (0, 3000)):
        values = random.integers(1, 2**63, shared + 2 * only).astype(np.uint64)
        a.append(values[: shared + only])
        b.append(np.concatenate([values[:shared], values[shared + only :]]))
    rows = [(np.repeat(np.arange(4), [len(x) for x in side]), np.concatenate(side)) for side in (a, b)]
    row, digest, sign = fingerprint.difference(4, *rows)
    for k in range(4):
        assert set(digest[(row == k) & (sign == 1)]) == set(a[k]) - set(b[k]) and set(digest[(row == k) & (sign == -1)]) == set(b[k]) - set(a[k])
    with pytest.raises(RuntimeError):
        fingerprint.difference(4, *rows, most_cells=200)


def test_packing(docs):
    from tokenizers import Tokenizer

    path = _tokenizer("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048
    t = Tokenizer.from_file(path)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in TEXTS}
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and len(piece) == r["length"]
        assert r["ids_crc32"] == crc32(b"".join(x.to_bytes(4, "little") for x in piece))
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _ in TEXTS)


def test_packing_ids_and_padding(spark):
    """Ids of both libraries agree, added tokens too; sequences are few."""
    from tokenizers import Tokenizer

    path = _tokenizer("byte_bpe_50k.json")
    encoder, plain = packing.Encoder(path), Tokenizer.from_file(path)
    assert encoder.fast
    end = "<|endoftext|>"
    awkward = ["", end, end + "a", "a" + end, f" a  {end}  b\n", end * 3, "<|endoftext", " " * 5000, "\n" * 300 + "x", "x" * 9000, "é\u0301 日本 \U0001f600", "'s 'LL don't", "\x00\x1c\x85\u00a0\u2003a", "1" * 999]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = awkward + [r["text"] or "" for r in table.select("text").collect()]
    for text, want in zip(texts, plain.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encoder.ids(text) == np.array(want.ids, "<u4").tobytes()
    assert packing.Encoder(_tokenizer("word_bpe_49k.json")).fast is None
    got = packing.pack(table, path).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("sequences")).first()
    assert got["sequences"] <= 1.03 * -(-got["n"] // 2048) + 1


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert sum(r["size"] for r in own) == own[0]["source_size"]


def test_warc(spark):
    big = "<p>é" + "y" * 1200
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "small"), (6, "http://e/", "small")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    for i, _, html in rows:
        payload = (html or "").encode()
        assert got[i]["payload_bytes"] == len(payload) and got[i]["payload_digest"] == hashlib.sha1(payload).hexdigest()
    assert [(i, got[i]["record_type"], got[i]["refers_to"]) for i in range(1, 7)] == [(1, "revisit", 2)] + [(i, "response", None) for i in range(2, 7)]


def test_warc_members_and_index(spark):
    """Each entry of a sidecar inflates alone to its record; record ids are unique, repeated rows and all; revisits name responses that exist."""
    big = "<p>" + "z" * 2000
    rows = [(i, None if i % 5 else "bad url", big + str(i % 7)) for i in range(60)] + [(70, "http://r/", big)] * 3 + [(71, "http://s/", "small")] * 2 + [(None, None, big)]
    ws = Workspace(spark, "test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = ws.save(warc.write_monolithic(warc.page_records(pages), ws.path("monolithic"), roll=20_000), "archives")
    members = ws.save(warc.normalise(archives, ws.path("members")), "normal").collect()
    assert len(members) > 1 and sum(r["records"] for r in members) == len(rows)
    ids, refers = [], []
    for r in members:
        path = r["archive"].removeprefix("file://")
        data, end = open(path, "rb").read(), 0
        whole = gzip.decompress(data)
        for entry in warc.read_index(r["archive"]):
            assert entry["offset"] == end
            end += entry["length"]
            record = gzip.decompress(data[entry["offset"] : end])
            assert record in whole and record.startswith(b"WARC/1.1\r\n")
            head = warc.parse_headers(record[: record.index(b"\r\n\r\n")])
            assert head["warc-record-id"] == f"<{entry['id']}>" and head["warc-type"] == entry["type"]
            ids.append(head["warc-record-id"])
            refers += [head["warc-refers-to"]] if "warc-refers-to" in head else []
        assert end == len(data) == r["bytes"]
    assert len(set(ids)) == len(ids) == len(rows) and refers and set(refers) <= set(ids)


def test_exact_top_k(spark):
    import numpy as np

    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in random.normal(size=8)]) for i in range(120)] + [(120, None), (121, [float("nan")] * 8)]
    rows[7] = (7, rows[3][1])
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    q = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows[:120]}
    want = []
    for i in range(0, 120, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_exact_top_k_awkward(spark):
    """Ties at the kth place, repeated ids, an all-zero query, several dimensions, empty vectors, clashing columns, many blocks."""
    random = np.random.default_rng(2)
    rows = [(i, [float(x) for x in random.integers(-2, 3, 4)]) for i in range(300)] + [(i, [float(x) for x in random.integers(-2, 3, 3)]) for i in range(300, 340)]
    rows += [(7, [1.0] * 4), (7, [1.0] * 4), (50, [2.0] * 4), (400, [0.0] * 4), (401, []), (402, None), (None, [1.0] * 4), (450, [1.0, None, 1.0, 1.0]), (500, [1.0])]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, rank int, score long, dim int")
    got = topk.exact_top_k(frame, block=16, query_block=2, group=2).collect()
    q = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and None not in v]
    want = []
    for i in sorted({i for i, _ in q if i % 50 == 0}):
        found = [(-int(a @ b), j) for k, a in q if k == i for j, b in q if j != i and len(a) == len(b)]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:5])]
    assert sorted(tuple(r) for r in got) == want


def test_scoring(docs):
    got = scoring.score_documents(docs).collect()
    train = Counter()
    for i, text in TEXTS:
        if crc32(str(i).encode()) % 7 != 2:
            train.update([*word_list(text), None])
    total, kinds = sum(train.values()), len(train)
    want = []
    for i, text in TEXTS:
        seen = [*word_list(text), None]
        base = sum(log10((train[w] + 1) / (total + kinds + 1)) for w in seen)
        want.append((i, crc32(str(i).encode()) % 7 == 2, len(seen), sum(train[w] > 0 for w in seen), total, pytest.approx(base)))
    key = lambda r: (r[0], r[2])
    found = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert all(r["score"] < 0 for r in got)


def test_scoring_classes(spark):
    """Rare words of one ending stand in two contexts: each has the class of its own neighbours; scores follow from the classes, of words outside the head too."""
    nouns, verbs = ([a + b + "ing" for b in "bcdfghklmn"] for a in ("no", "ve"))
    texts = [f"the {n} was {v} then" for n in nouns for v in verbs] + ["the noun was verb then"] * 300 + ["the", "was then", ""]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    ws = Workspace(spark, "test")
    words, state = scoring.fit_words(train, ws, words=5, ends=4, classes=8, head=6)
    learned = ws.save(scoring.class_lines(train.withColumn("doc_id", F.monotonically_increasing_id()), words, state), "learned")
    model = scoring.fit_model(learned, words, state, classes=8)
    assert model.own
    word = lambda w: int(word_spans(*next(text_slices(pa.array([w])))[2:])[3].view("int64")[0])
    rows = {r["word"]: r for r in state.collect()}
    assert len(rows) == 26 and sum(r["n"] for r in rows.values()) == sum(len(t.split()) + 1 for t in texts)
    classes = [{rows[word(w)]["class"] for w in kind} for kind in (nouns, verbs)]
    assert [len(c) for c in classes] == [1, 1] and classes[0] != classes[1]
    docs = [(1, "the nobing was vecing then"), (2, "vecing the unseen noding"), (3, ""), (3, ""), (4, None)]

    def path(text):
        for w in (text or "").split():
            unknown = words.classes[words.items.ends.get(scoring.endings(np.array([0]), np.array([len(w)]), np.frombuffer(w.encode(), np.uint8)), words.items.size - 1)][0]
            yield (rows[word(w)]["class"], rows[word(w)]["n"]) if word(w) in rows else (unknown, 0)

    table = np.zeros((8, 8))
    for text in texts:
        line = [scoring.START, *(c for c, _ in path(text)), scoring.END]
        for a, b in zip(line, line[1:]):
            table[a, b] += 1
    overall = table.sum(0) + 1
    overall[scoring.START] = 0
    assert np.allclose(10**model.transition, (table + 5 * overall / overall.sum()) / (table.sum(1, keepdims=True) + 5))
    got = scoring.scores(scoring.class_lines(spark.createDataFrame(docs, "doc_id long, text string"), words, state), model).collect()
    want = []
    for i, text in docs:
        total, left = 0.0, scoring.START
        for of, n in path(text):
            total += model.transition[left, of] - model.emission[of] + log10(n + 1)
            left = of
        want.append((i, pytest.approx(total + model.transition[left, scoring.END])))
    assert sorted((r["doc_id"], r["score"]) for r in got) == want


def test_best_classes_by_brute_force():
    """The class that gains most is the one by which the likelihood of all class bigrams rises most, each word moved alone."""
    random = np.random.default_rng(3)
    base = 6
    table = random.integers(1, 400, (base, base)).astype(float)
    of, slot, n, now = [], [], [], np.array([2, 3, 5, 4])
    for k, c in enumerate(now):
        right, left = random.multinomial(90 * (k + 1), [1 / base] * base), random.multinomial(90 * (k + 1), [1 / base] * base)
        right[c] = left[c] = 0  # a word beside its own class counts for either side apart
        left[0] += right.sum() - left.sum()
        for s, counts in ((0, right), (base, left)):
            for d in np.flatnonzero(counts):
                of, slot, n = [*of, k], [*slot, s + d], [*n, counts[d]]
        table[c] += right
        table[:, c] += left
    of, slot, n = np.array(of), np.array(slot), np.array(n)
    total, best = scoring.best_classes(of, slot, n, now, scoring.Gains(table))
    for k, c in enumerate(now):
        right, left = (np.bincount(slot[of == k] % base * (slot[of == k] // base == side), n[of == k] * (slot[of == k] // base == side), base) for side in (0, 1))
        value = []
        for to in range(scoring.FIRST, base):
            moved = table.copy()
            moved[c] -= right
            moved[:, c] -= left
            moved[to] += right
            moved[:, to] += left
            value.append(scoring.likelihood(moved))
        assert total[k] == right.sum()
        rank = sorted(value, reverse=True)
        assert value[best[k] - scoring.FIRST] >= rank[0] - 0.05 * (rank[0] - rank[-1])  # gains of the cell (to, to) are summed apart


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = _tokenizer("piece_bpe_32k.model")
    vocabulary = tokens.rank_vocabulary(path)
    unknown = next(i for i, (p, _) in enumerate(vocabulary) if p == "<unk>")
    t = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    frame = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    column = next(c for c in tokens.token_counts(frame, path).columns if c != "doc_id" and "token" in c)
    got = sorted((r["doc_id"], r[column]) for r in tokens.token_counts(frame, path).collect())
    assert got == sorted((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in frame.collect())


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.near_components(none).count() == fingerprint.edit_fingerprints(none).count() == mixing.mix(none).count() == 0
    assert scoring.score_documents(none).count() == toxicity.toxicity(none, labels).count() == quality.quality(none, labels).count() == 0
    assert packing.pack(none, _tokenizer("byte_bpe_50k.json")).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stages_drop_what_scores_reject(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules, bags = quality.fit(table, labels), toxicity.fit(table, labels)
    good = {r["doc_id"] for r in quality.scored(table, rules).where("score >= 0.7").select("row.doc_id").collect()}
    clean = {r["doc_id"] for r in toxicity.score(table, bags).where("score < 0.5").collect()}
    for kept, want in ((quality.without_poor(table, rules), good), (toxicity.without_toxic(table, bags), clean)):
        assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == want
    assert 0 < len(good) < table.count() > len(clean) > 0
