"""Similarity join of documents on word shingles (Jaccard), with set-relation skipping.

Equal sets become one node first. Each node puts its prefix - its n - ceil(0.8 n) + 1 first shingles, those of few
documents and of rare words before others - into index lists. Two relations among sets then spare work:

* Index lists are cut into blocks of one set size and one position. Two blocks can hold similar sets only if their sizes
  and what is left behind their positions allow it; a block that fits no other block of its list is skipped as a whole.
* What remains of a list needs no pairs: one set leads, the others follow. Bitmaps of the sets, which are small, break a
  leader's group into smaller ones wherever they prove that no similar pair is lost. Then the leader's answers (its overlap with every
  follower) are computed once. A follower that is similar to the leader has the leader's component and is compared with
  no other such follower. Answers of the others come from the leader's: |Y & Z| = |L| - |L - Y| - |L - Z|
  + |(L - Y) & (L - Z)| + |(Y - L) & (Z - L)|, so only what sets lack of the leader, or have beyond it, is multiplied (of a set
  with less than half of the leader, what it has of it); an upper bound from the leader's overlaps skips pairs first.

Followers of one leader are compared in blocks of bounded size, so a group of any size is shared among tasks, and only the
links that join components leave a task. Components are found by alternating star steps over those links.

The order of shingles (see frequent) only sets how much work is done: any order gives the same result.

Defined cases: null, empty and white-space texts have an empty set, link with nothing and are their own component; texts
of fewer words than a shingle have their whole sequence as the one shingle; rows that repeat, and different rows with one
doc_id, count as documents of their own; a row whose doc_id is null links like any other, but is never the smallest id; an
empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, most_frequent, text_or_empty
from ..stars import components
from .words import mixed, runs, shingle_sets, weighed_shingle_sets

#: Similarity as a fraction of whole numbers: two sets link when NEAR[1] * intersection >= NEAR[0] * union.
NEAR = (4, 5)
#: Sizes of one class and the next cover every pair of sizes that can be similar.
_CLASSES = [1]
while _CLASSES[-1] < 1 << 40:
    _CLASSES.append(_CLASSES[-1] * NEAR[1] // NEAR[0] + 1)
CLASSES = np.array(_CLASSES, np.int64)


def needed(n, m):
    """The smallest intersection of similar sets of n and m elements."""
    return (NEAR[0] * (n + m) + NEAR[0] + NEAR[1] - 1) // (NEAR[0] + NEAR[1])


def prefix_size(n: int) -> int:
    return n - (NEAR[0] * n + NEAR[1] - 1) // NEAR[1] + 1


def frequent(docs: DataFrame, ws: Workspace, width: int = 5, local: int = 4, least: int = 64, most: int = 500_000) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(sorted hashes, counts) of the "shingles" and the "words" that stand in at least `least` documents or places, by lossy counting over all documents.

    A chunk of 4 million shingles drops what it saw less than `local` times; the `most` most frequent of each are kept. They rank prefixes only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, size = [], [], 0

        def flush(parts: list[np.ndarray], kind: str) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            good = n >= local
            return pa.RecordBatch.from_arrays([pa.array([kind] * int(good.sum()), pa.string()), pa.array(values[good].view(np.int64)), pa.array(n[good])], names=["kind", "token", "n"])

        def seen(hashed: np.ndarray) -> np.ndarray:
            words.append(hashed)
            return np.zeros(len(hashed), np.int8)

        for batch in batches:
            for _, own, _ in weighed_shingle_sets(batch.column(0), width, seen):
                held.append(own)
                size += len(own)
                if size >= 4_000_000:
                    yield flush(held, "shingles")
                    yield flush(words, "words")
                    held, size = [], 0
                    words.clear()
        if words:
            yield flush(held, "shingles")
            yield flush(words, "words")

    counts = docs.select(text_or_empty().alias("text")).mapInArrow(count, "kind string, token long, n long")
    counts = ws.save(counts.groupBy("kind", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "frequent")
    out = {}
    for kind in ("shingles", "words"):
        found = most_frequent(counts.where(F.col("kind") == kind), "token", most)
        tokens, n = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
        order = np.argsort(tokens)
        out[kind] = tokens[order], n[order]
    return out


def looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The number beside each key of a sorted table, 0 beside others."""
    tokens, n = table
    if not len(tokens):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(tokens, keys), len(tokens) - 1)
    return np.where(tokens[at] == keys, n[at], 0)


def commonness(words: tuple[np.ndarray, np.ndarray], hashed: np.ndarray) -> np.ndarray:
    """A whole number that rises with the logarithm of each word's count."""
    return np.rint(4 * np.log2(1 + looked_up(words, hashed))).astype(np.int64)


def ranked(own: np.ndarray, common: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The elements of a sorted set: those of few documents first, of rare words first among them."""
    return own[np.lexsort((common, looked_up(heavy, own)))]


def node_of(own: np.ndarray) -> int:
    """A set's 64-bit fingerprint."""
    return int(mixed(np.array([mixed(own, 3).sum(dtype=np.uint64)]), len(own))[0].view(np.int64))


def described(docs: DataFrame, known: dict, width: int) -> DataFrame:
    """doc_id, key, n_shingles, node (a fingerprint of the set; 0 elements: null), prefix, bitmap."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, node, prefix, bitmap = [], [], [], []
            for _, own, common in weighed_shingle_sets(batch.column(2), width, lambda hashed: commonness(known["words"], hashed)):
                n.append(len(own))
                node.append(node_of(own) if len(own) else None)
                bitmap.append(bitmap_of(own) if len(own) else None)
                prefix.append(ranked(own, common, known["shingles"])[: prefix_size(len(own))].view(np.int64) if len(own) else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *prefix]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), lists, pa.array(bitmap, pa.binary())], names=["doc_id", "key", "n_shingles", "node", "prefix", "bitmap"])

    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text")).mapInArrow(describe, f"doc_id {kind}, key long, n_shingles long, node long, prefix array<long>, bitmap binary")


def fitting(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """May sets of n and m elements that meet at positions i and j be similar?"""
    return (NEAR[1] * np.minimum(n, m) >= NEAR[0] * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= needed(n, m))


def unskipped(n: np.ndarray, at: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Which entries of a list are in a block (size, position) that fits another block, or itself if it has several entries."""
    blocks, block, count = np.unique(np.stack([n, at], 1), axis=0, return_inverse=True, return_counts=True)
    block, alive = block.ravel(), np.zeros(len(blocks), bool)
    for a in range(0, len(blocks), chunk):
        own = blocks[a : a + chunk]
        upto = np.searchsorted(blocks[:, 0], own[-1, 0] * NEAR[1] // NEAR[0], "right")  # blocks rise by size: others are too large
        other = blocks[a:upto]
        fits = fitting(own[:, None, 0], own[:, None, 1], other[None, :, 0], other[None, :, 1])
        one = np.arange(len(own))
        fits[one, one] &= count[a : a + len(own)] > 1
        alive[a : a + len(own)] |= fits.any(axis=1)
        alive[a:upto] |= fits.any(axis=0)
    return alive[block]


def leaders_of(token: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(leader, follower) pairs, from lists that stand together by token."""
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    start, size = edge[:-1], np.diff(edge)
    two = start[size == 2]
    two = two[fitting(n[two], at[two], n[two + 1], at[two + 1])]
    a, b = node[two], node[two + 1]
    found = [np.stack([np.minimum(a, b), np.maximum(a, b)], 1)]
    for s, k in zip(start[size > 2], size[size > 2], strict=True):
        good = s + np.flatnonzero(unskipped(n[s : s + k], at[s : s + k]))
        kind = np.searchsorted(CLASSES, n[good], "right")
        present = np.unique(kind)
        for c in present:
            if c + 1 not in present and c - 1 in present:
                continue  # the window before holds this class too
            members = node[good[(kind == c) | (kind == c + 1)]]
            if len(members) > 1:
                found.append(np.stack([np.full(len(members), members.min()), members], 1))
    pairs = np.concatenate(found)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def led(full: DataFrame, heavy: np.ndarray, ws: Workspace) -> DataFrame:
    """leader, node from sets (node, n, prefix; equal ones may repeat); heavy: tokens whose lists no task shall hold.

    Prefixes are the bulk and are shuffled once, to keep one of equal sets. Entries of heavy tokens are taken from them before that, each once, and written.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["token"], bulk=True):
            token, node, packed = (table.column(c).to_numpy() for c in ("token", "node", "at"))
            pairs = leaders_of(token, node, packed >> 32, packed & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["leader", "node"])

    def entries(sets: DataFrame) -> DataFrame:
        return sets.select("node", "n", F.posexplode("prefix").alias("i", "token"))

    spark = full.sparkSession
    listed = F.broadcast(spark.createDataFrame(pa.table({"token": pa.array(heavy.view(np.int64))})))  # at most as many as frequent() keeps: 4 MB
    light = entries(full.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    light = light.join(listed, "token", "left_anti") if len(heavy) else light
    dealt = light.select("token", "node", (F.col("n") * F.lit(1 << 32) + F.col("i")).alias("at")).repartition("token").sortWithinPartitions("token")
    found = dealt.mapInArrow(lists, "leader long, node long")
    if len(heavy):
        long_lists = ws.save(entries(full).join(listed, "token", "left_semi").dropDuplicates(["token", "node"]), "long_lists")
        found = found.unionByName(led_by_blocks(long_lists, ws))
    return found.distinct()


def block_leaders(kind: np.ndarray, low: np.ndarray, high: np.ndarray, rest: np.ndarray, least: np.ndarray, several: np.ndarray) -> list[tuple[int, int]]:
    """(block, leader) for the blocks of one list that are not skipped, in each window of sizes.

    Sizes of a block are low to high, at most `rest` elements are left behind its positions, least is its smallest node.
    """
    fits = (NEAR[1] * np.minimum(high[:, None], high) >= NEAR[0] * np.maximum(low[:, None], low)) & (np.minimum(rest[:, None], rest) >= needed(low[:, None], low))
    one = np.arange(len(kind))
    fits[one, one] &= several
    alive = fits.any(axis=1)
    out, present = [], np.unique(kind[alive])
    for c in present:
        if c + 1 not in present and c - 1 in present:
            continue  # the window before holds this class too
        blocks = np.flatnonzero(alive & ((kind == c) | (kind == c + 1)))
        if len(blocks) > 1 or several[blocks[0]]:
            out += [(int(b), int(least[blocks].min())) for b in blocks]
    return out


def led_by_blocks(entries: DataFrame, ws: Workspace, shares: int = 64) -> DataFrame:
    """As led(), for long lists: each shrinks to blocks of one class of sizes and one share of positions before a shuffle.

    Blocks skip each other by their extreme sizes and positions. A list has at most some hundred, so a task leads whole lists;
    the entries meet their block's leaders by a join of plain tables, which Spark broadcasts or splits.
    """
    key = ["token", "kind", "share"]

    @F.arrow_udf("int")
    def class_of(n: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(CLASSES, n.to_numpy(zero_copy_only=False), "right"), pa.int32())

    placed = entries.select("token", "node", "n", "i", class_of("n").alias("kind"), F.floor(F.col("i") * shares / F.col("n")).cast("int").alias("share"))
    blocks = placed.groupBy(*key).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("i")).alias("rest"), F.min("node").alias("least"), F.max("node").alias("most"))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["token"]):
            c = {name: table.column(name).to_numpy() for name in table.column_names}
            found = block_leaders(c["kind"], c["low"], c["high"], c["rest"], c["least"], c["least"] != c["most"])
            at = np.array([b for b, _ in found], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c[k][at]) for k in key] + [pa.array([x for _, x in found], pa.int64())], names=[*key, "leader"])

    leaders = blocks.repartition("token").sortWithinPartitions("token").mapInArrow(lead, "token long, kind int, share int, leader long")
    return placed.join(ws.save(leaders, "leaders"), key).where("leader <> node").select("leader", "node")


def united(parent: np.ndarray, places: np.ndarray) -> None:
    """Join the components of some places, in place; parent: of each place one at or before it, a root's its own."""
    roots = parent[places]
    while (roots != parent[roots]).any():
        roots = parent[roots]
    parent[places] = parent[roots] = roots.min()


def roots_of(parent: np.ndarray) -> np.ndarray:
    while (parent != parent[parent]).any():
        parent[:] = parent[parent]
    return parent


def differences(values: np.ndarray, row: np.ndarray, at: np.ndarray, inside: np.ndarray, overlap: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """How the sets of a group differ from their leader of `size` elements: (lacking, kept, columns, row, sign).

    values, row: the sets' elements and whose they are; inside: is it the leader's, and at which place (at). Of a set with
    more than half of the leader (lacking) the places it lacks are written down, with sign -1, of another those it has; then,
    of both, what stands outside the leader. kept: how many places of the leader are written down for each set. Entries rise
    by column; a column with one entry meets no other set and is left out. Sets with most of the leader hold at least half
    as many elements as the table of places, so memory grows with the group's elements.
    """
    lacking = 2 * overlap > size
    absent = np.ones((int(lacking.sum()), size), bool)
    known = inside & lacking[row]
    absent[(np.cumsum(lacking) - 1)[row[known]], at[known]] = False
    lack_row, lack_at = np.nonzero(absent)
    del absent
    direct, outer = inside & ~lacking[row], ~inside
    code = np.unique(values[outer], return_inverse=True)[1].ravel()
    columns = np.concatenate([lack_at, at[direct], size + code])
    rows = np.concatenate([np.flatnonzero(lacking)[lack_row], row[direct], row[outer]]).astype(np.int32)
    sign = np.ones(len(columns), np.float32)
    sign[: len(lack_at)] = -1
    times = np.bincount(columns, minlength=1)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1).astype(np.int32)[columns]
    order = np.argsort(place, kind="stable")
    order = order[np.searchsorted(place[order], 0) :]
    return lacking, np.where(lacking, size - overlap, overlap), place[order], rows[order], sign[order]


def from_leader(lacking: np.ndarray, kept: np.ndarray, other_lacking: np.ndarray, other_kept: np.ndarray, size: int) -> np.ndarray:
    """Overlaps of two rows of sets as their leader's answers give them, before the products of their differences are added.

    With Y and Z lacking: |L| - |L - Y| - |L - Z|; with Y alone: Z's own part of L; with neither: 0.
    """
    a, b = lacking[:, None], other_lacking[None, :]
    k, m = kept[:, None], other_kept[None, :]
    return np.where(a & b, size - k - m, np.where(a, m, np.where(b, k, 0))).astype(np.float32)


def group_links(nodes: np.ndarray, sets: list[np.ndarray], leader: int, tile: int = 256, width: int = 512) -> list[tuple[int, int]]:
    """Links that join all similar sets of a leader's group; sets[leader] leads.

    Sets that the leader does not answer are compared with the others a tile of rows at a time, so memory grows with the
    group's elements and with tile times its sets only.
    """
    g = len(sets)
    n = np.array([len(x) for x in sets], np.int32)
    own = sets[leader]
    values, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    at = np.minimum(np.searchsorted(own, values), len(own) - 1).astype(np.int32)
    inside = own[at] == values
    overlap = np.add.reduceat(inside.astype(np.int32), offsets[:-1])
    linked = NEAR[1] * overlap >= NEAR[0] * (n + len(own) - overlap)
    parent = np.where(linked, leader, np.arange(g))
    if linked[:leader].any():  # parents stand at or before their places
        parent[linked] = np.flatnonzero(linked)[0]
        parent[leader] = parent[linked][0]
    rest = np.flatnonzero(~linked)
    if len(rest) and g > 2:
        lacking, kept, columns, row, sign = differences(values, np.repeat(np.arange(g, dtype=np.int32), n), at, inside, overlap, len(own))
        del values, at, inside
        outside = n - overlap
        for low in range(0, len(rest), tile):
            x = rest[low : low + tile]
            small, large = np.minimum(n[x][:, None], n), np.maximum(n[x][:, None], n)
            open_ = NEAR[1] * small >= NEAR[0] * large
            open_ &= np.minimum(overlap[x][:, None], overlap) + np.minimum(outside[x][:, None], outside) >= needed(n[x][:, None], n)
            open_ &= parent[x][:, None] != roots_of(parent)  # what is joined already needs no answer
            open_[:, leader] = False  # answered
            r, c = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(r):
                continue
            at_r, at_c = np.full(g, -1, np.int32), np.full(g, -1, np.int32)
            at_r[x[r]], at_c[c] = np.arange(len(r)), np.arange(len(c))
            both = from_leader(lacking[x[r]], kept[x[r]], lacking[c], kept[c], len(own))
            for first in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
                i, j = np.searchsorted(columns, [first, first + width])
                own_r, own_c = at_r[row[i:j]], at_c[row[i:j]]
                if (own_r >= 0).any():
                    left, right = np.zeros((len(r), width), np.float32), np.zeros((len(c), width), np.float32)
                    left[own_r[own_r >= 0], columns[i:j][own_r >= 0] - first] = sign[i:j][own_r >= 0]
                    right[own_c[own_c >= 0], columns[i:j][own_c >= 0] - first] = sign[i:j][own_c >= 0]
                    both += left @ right.T
            hit = open_[np.ix_(r, c)] & (NEAR[1] * both >= NEAR[0] * (n[x[r]][:, None] + n[c][None, :] - both))
            for k in np.flatnonzero(hit.any(axis=1)):
                united(parent, np.append(c[hit[k]], x[r[k]]))
    label = roots_of(parent)
    moved = np.flatnonzero(label != np.arange(g))
    return [(int(nodes[label[i]]), int(nodes[i])) for i in moved]


def dealt(stars: DataFrame, facts: DataFrame, ws: Workspace, name: str, block_rows: int = 1500, block_elements: int = 750_000) -> DataFrame:
    """leader, p, q and facts (node, n, ...) of every leader's group, those of one (leader, p, q) together.

    A group beyond the block bounds is cut into blocks by hash; every two blocks, and each with itself, meet as one (p, q),
    and the leader is in all. The table of such groups is small and written first, so followers do not meet by leader:
    Spark broadcasts it, or splits a large group in the join.
    """
    sized = stars.join(facts.select("node", "n"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_elements)).cast("int")
    cut = ws.save(sized.groupBy("leader").agg(blocks.alias("blocks")).where("blocks > 1"), name)
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int")
    others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    rows = stars.join(cut, "leader", "left").withColumn("own", own).withColumn("other", F.explode(others))
    rows = rows.select("leader", "node", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    first = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = cut.withColumn("p", first).withColumn("q", F.explode(F.sequence(F.col("p"), F.col("blocks") - 1))).select("leader", "p", "q")
    pairs = pairs.unionByName(stars.select("leader").distinct().join(cut, "leader", "left_anti").select("leader", F.lit(0).alias("p"), F.lit(0).alias("q")))
    rows = rows.unionByName(pairs.select("leader", F.col("leader").alias("node"), "p", "q"))
    return rows.join(facts, "node").repartition("leader", "p", "q").sortWithinPartitions("leader", "p", "q")


def bitmap_of(own: np.ndarray) -> bytes:
    """One bit for each element, by its hash, among 2 to 4 times as many bits as elements (a power of two)."""
    bits = np.zeros(max(64, 1 << (2 * len(own) - 1).bit_length()), bool)
    bits[(own & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap of `size` 64-bit numbers from one of as many or more: what falls together is united."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, size), axis=0)


def plausible_stars(nodes: np.ndarray, n: np.ndarray, bitmaps: list[bytes]) -> list[tuple[int, int]]:
    """(leader, follower) pairs that cover every pair of a group that bitmaps do not rule out: two bitmaps differ in no more bits than their sets in elements."""
    g, size = len(nodes), min(len(b) for b in bitmaps) // 8
    bits = np.stack([folded(b, size) for b in bitmaps])
    step = max(1, 4_000_000 // (8 * size))  # rows that are compared at a time
    parent = np.arange(g)
    for i in range(g - 1):
        places = np.arange(i + 1, g)
        m = n[i + 1 :]
        # what is joined already covers its pairs
        places = places[(NEAR[1] * np.minimum(n[i], m) >= NEAR[0] * np.maximum(n[i], m)) & (roots_of(parent)[i] != parent[i + 1 :])]
        found = [np.array([i])]
        for low in range(0, len(places), step):
            js = places[low : low + step]
            apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
            found.append(js[apart <= n[i] + n[js] - 2 * needed(n[i], n[js])])
        united(parent, np.concatenate(found))
    label = roots_of(parent)
    return [(int(nodes[label[i]]), int(nodes[i])) for i in np.flatnonzero(label != np.arange(g))]


def pairs_table(found: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=names)


def refined(stars: DataFrame, facts: DataFrame, ws: Workspace) -> DataFrame:
    """leader, node rows that still cover every pair that may be similar, from (leader, node) rows and facts (node, n, bitmap)."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for table in runs(batches, ["leader", "p", "q"]):
            nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
            bitmaps = table.column("bitmap").to_pylist()
            found += plausible_stars(nodes, table.column("n").to_numpy()[first], [bitmaps[i] for i in first])
            if len(found) > 10_000:
                yield pairs_table(found, ["leader", "node"])
                found = []
        yield pairs_table(found, ["leader", "node"])

    return dealt(stars, facts, ws, "cut_candidates", block_rows=3000, block_elements=20_000_000).select("leader", "p", "q", "node", "n", "bitmap").mapInArrow(refine, "leader long, node long").distinct()


def grouped_links(stars: DataFrame, sets: DataFrame, ws: Workspace) -> DataFrame:
    """a, b: links that join what is similar, from (leader, node) rows and (node, elements) rows."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for table in runs(batches, ["leader", "p", "q"]):
            nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
            elements = table.column("elements").combine_chunks()
            at, values = elements.offsets.to_numpy(), elements.values.to_numpy().view(np.uint64)
            found += group_links(nodes, [values[at[i] : at[i + 1]] for i in first], int(np.searchsorted(nodes, table.column("leader")[0].as_py())))
            if len(found) > 10_000:
                yield pairs_table(found, ["a", "b"])
                found = []
        yield pairs_table(found, ["a", "b"])

    facts = sets.select("node", F.size("elements").cast("long").alias("n"), "elements")
    return dealt(stars, facts, ws, "cut_stars").select("leader", "p", "q", "node", "elements").mapInArrow(link, "a long, b long")


def elements_of(docs: DataFrame, wanted: DataFrame, width: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """node, elements for the nodes of `wanted` (node, doc_id: a row of docs that has the set)."""
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= broadcast_rows else ids  # at most 16 MB of ids; beyond, Spark joins by shuffle
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                sets = [own for _, own in shingle_sets(piece.column(0), width) if len(own)]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32), np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), lists], names=["node", "elements"])

    found = rows.select("text").mapInArrow(rebuild, "node long, elements array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def near_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for each row of docs."""
    return labelled_components(docs, width).select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null ids last), then of a hash of the text.

    Rows without words are in no component: all stay. Repeated rows, and equal texts with one id, are copies: one stays.
    """
    text = text_or_empty()
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_tie"), text.rlike(WORD).alias("worded"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("key").alias("tie"))
    found = labelled_components(docs, width).where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("best")).select("best.id", "best.tie")
    kept = keyed.where("worded").join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie")), "left_semi").dropDuplicates(["own_id", "own_tie"])
    return kept.unionByName(keyed.where("NOT worded")).select("row.*")


def labelled_components(docs: DataFrame, width: int = 5, long_list: int = 10_000) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, label (a number of the component; empty sets: null), component_id for each row of docs.

    The index list of a shingle that stands in long_list documents is led by blocks; a shingle that frequent() misses is
    less than a millionth of all. long_list only sets how the work is done.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    known = frequent(docs, ws, width)
    heavy = known["shingles"][0][known["shingles"][1] >= long_list]
    described_ = ws.save(described(docs, known, width), "sets")
    full = described_.where("node IS NOT NULL")
    nodes = ws.save(full.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    prefixes = full.select("node", F.col("n_shingles").alias("n"), "prefix")
    facts = full.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap"))
    stars = ws.save(refined(ws.save(led(prefixes, heavy, ws), "candidates"), facts, ws), "stars")
    wanted = ws.save(stars.select("node").unionByName(stars.select(F.col("leader").alias("node"))).distinct().join(nodes, "node"), "wanted")
    sets = ws.save(elements_of(docs, wanted, width), "elements")
    links = ws.save(grouped_links(stars, sets, ws), "links")
    ws.drop("elements", "stars", "candidates", "wanted", "leaders", "long_lists", "cut_candidates", "cut_stars")
    # nodes are named by their smallest doc_id (null last), so the smallest name of a component holds its smallest doc_id
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    named = nodes.select("node", name.alias("name"))
    ends = links.join(named.withColumnsRenamed({"node": "a", "name": "from"}), "a").join(named.withColumnsRenamed({"node": "b", "name": "to"}), "b")
    labels = components(ends.select(F.col("from").alias("a"), F.col("to").alias("b")), ws).select(F.col("node.node").alias("_node"), "label")
    final = nodes.join(labels, F.col("node") == F.col("_node"), "left").select(F.col("node").alias("_node"), F.coalesce("label", name).alias("label"))
    final = ws.save(final, "labels")  # a join of two plain tables: Spark splits the node of a large group of equal sets
    joined = described_.select("doc_id", "key", "n_shingles", "node").join(final, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("label.id"))
    return joined.select("doc_id", "key", "n_shingles", F.col("label.node").alias("label"), component.alias("component_id"))
