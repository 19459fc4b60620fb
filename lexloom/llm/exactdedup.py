"""Exact deduplication by Patricia tries whose terminals own their text.

A text is normalised (each run of ASCII white space is one space) and gets a key: its length in bytes, a 64-bit hash of
its content, then all its bytes. Three kinds of tasks insert keys into compressed radix tries; two texts meet in one
terminal only if all their bytes agree, whatever their hashes say. A terminal keeps the smallest (doc_id, row) and a count.

1. Every task over the documents builds a trie of its own rows. Where a trie holds more than `trie_bytes`, its heaviest
   subtrees are spilled: their terminals are written as partial owners and start anew. So a text goes on once for a
   trie, however many copies a task reads. Rows and partial owners are written to the shared folder.
2. Partial owners meet by (length, hash). Keys with more than `fan_in` partial owners are merged twice: first in the
   square root of their number of groups, then those; no task reads all partial owners of a frequent text.
3. Keys arrive sorted, so whatever lies left of the current path of the trie is complete; past `trie_bytes` such
   subtrees are spilled as owners. A task thus holds a bound and one text at a time.

Rows find their owner by the number of their partial owner, a join in which no key has more rows than one trie took.

Defined cases: null texts are empty; null ids come last, and a group without any id has keep_id null; of rows that share
the smallest id one, the first read, stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes of a key before its text: length and hash, most significant byte first.
HEAD = 16
ROWS = 4096
CHUNK_BYTES = 8 << 20
PART_FIELDS = "child long, id long, ref long, size long, hash long, text binary, first long, n long"
OWNER_FIELDS = "ref long, keep_id long, keep_row long, group_size long, text_sha256 string"


class Node:
    """A node of a radix trie: the bytes of the edge above it, its children by first byte, and what a terminal holds."""

    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.owner = None


class Trie:
    """A compressed radix trie over byte strings; held counts the bytes of its edges and a share for each node."""

    NODE = 200

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes) -> Node:
        """The terminal of key, made where there is none."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                leaf = node.children[key[at]] = Node(key[at:])
                self.held += len(leaf.label) + self.NODE
                return leaf
            if not key.startswith(child.label, at):
                shared = agreeing(child.label, key, at)
                upper = node.children[key[at]] = Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                self.held += self.NODE
                child = upper
            node, at = child, at + len(child.label)
        return node

    def taken(self, node: Node, path: bytes) -> Iterator[tuple[bytes, object]]:
        """(key, owner) of all terminals at and below a node that no longer belongs to the trie; path: the bytes above it."""
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            path += node.label
            self.held -= len(node.label) + self.NODE
            if node.owner is not None:
                yield path, node.owner
            stack.extend((x, path) for x in node.children.values())

    def weights(self) -> dict[int, int]:
        """Bytes at and below each node, by the node's identity."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children.values())
        weights: dict[int, int] = {}
        for node in reversed(order):
            weights[id(node)] = len(node.label) + self.NODE + sum(weights[id(x)] for x in node.children.values())
        return weights

    def heaviest(self, upto: int) -> Iterator[tuple[bytes, object]]:
        """Spill subtrees, heaviest first and none of more than half of `upto` but single terminals, until no more than `upto` are held."""
        weights, heap = self.weights(), []

        def add(parent: Node, path: bytes) -> None:
            for first, child in parent.children.items():
                heapq.heappush(heap, (-weights[id(child)], path, first, parent, child))

        add(self.root, b"")
        while self.held > upto and heap:
            weight, path, first, parent, child = heapq.heappop(heap)
            if -weight > upto // 2 and child.children:
                add(child, path + child.label)
            else:
                yield from self.taken(parent.children.pop(first), path)

    def before(self, key: bytes) -> Iterator[tuple[bytes, object]]:
        """Spill all subtrees left of the path of key: where keys come sorted, no later key belongs to them."""
        node, path, at = self.root, b"", 0
        while at < len(key):
            for first in sorted(x for x in node.children if x < key[at]):
                yield from self.taken(node.children.pop(first), path)
            node = node.children[key[at]]
            path, at = path + node.label, at + len(node.label)

    def all(self) -> Iterator[tuple[bytes, object]]:
        for first in sorted(self.root.children):
            yield from self.taken(self.root.children.pop(first), b"")


def agreeing(label: bytes, key: bytes, at: int) -> int:
    """How many leading bytes of label stand in key from `at`."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if label[low:middle] == key[at + low : at + middle] else (low, middle - 1)
    return low


def head(size: int, hashed: int) -> bytes:
    """Length and signed hash as bytes whose order is the order of (length, hash)."""
    return size.to_bytes(8, "big") + (hashed + (1 << 63)).to_bytes(8, "big")


def smaller(a: tuple, b: tuple) -> tuple:
    """The smaller of two (id, row): null ids last."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _bulk(rows: Iterator[tuple], weigh, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of at most ROWS rows and about CHUNK_BYTES bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if len(held) >= ROWS or size >= CHUNK_BYTES:
            yield _table(held, names, types)
            held, size = [], 0
    if held:
        yield _table(held, names, types)


def _partial(trie_bytes: int, sign: int):
    """Task of the first two levels: (id, hash, text[, child, first, n]) to rows with their partial owner, and the partial owners."""
    names = [x.split()[0] for x in PART_FIELDS.split(", ")]
    types = [pa.binary() if x.endswith("binary") else pa.int64() for x in PART_FIELDS.split(", ")]

    def owners(spilled: Iterator[tuple[bytes, list]]) -> Iterator[tuple]:
        for key, (ref, (least, first), n) in spilled:
            yield None, least, ref, int.from_bytes(key[:8], "big"), int.from_bytes(key[8:HEAD], "big") - (1 << 63), key[HEAD:], first, n

    def rows(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[tuple]:
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        refs = serial
        for batch in batches:
            ids, hashes, texts = (batch.column(k).to_pylist() for k in ("id", "hash", "text"))
            given = [batch.column(k).to_pylist() for k in ("child", "first", "n")] if sign < 0 else None
            for i, (key, hashed, text) in enumerate(zip(ids, hashes, texts, strict=True)):
                if given:
                    child, first, n = (c[i] for c in given)
                else:
                    child, first, n = serial, serial, 1
                    serial += 1
                node = trie.insert(head(len(text), hashed) + text)
                if node.owner is None:
                    node.owner = [refs if sign > 0 else -1 - refs, (key, first), n]
                    refs += 1
                else:
                    node.owner[1] = smaller(node.owner[1], (key, first))
                    node.owner[2] += n
                yield child, key, node.owner[0], None, None, None, None, None
                if trie.held > trie_bytes:
                    yield from owners(trie.heaviest(trie_bytes // 2))
        yield from owners(trie.all())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _bulk(rows(batches, Trie()), lambda r: len(r[5]) if r[5] else 0, names, types)

    return task


def _whole(trie_bytes: int):
    """Task of the last level: partial owners sorted by (size, hash) to (ref of a partial owner, its owner)."""
    names = [x.split()[0] for x in OWNER_FIELDS.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in OWNER_FIELDS.split(", ")]

    def owners(spilled: Iterator[tuple[bytes, list]]) -> Iterator[tuple]:
        for key, (refs, (least, first), n) in spilled:
            digest = hashlib.sha256(key[HEAD:]).hexdigest()
            for ref in refs:
                yield ref, least, first, n, digest

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie, last = Trie(), None
        for batch in batches:
            for ref, size, hashed, text, key, first, n in zip(*(batch.column(k).to_pylist() for k in ("ref", "size", "hash", "text", "id", "first", "n")), strict=True):
                if trie.held > trie_bytes and (size, hashed) != last:
                    yield from owners(trie.all())  # all keys so far are smaller
                last, whole = (size, hashed), head(size, hashed) + text
                node = trie.insert(whole)
                if node.owner is None:
                    node.owner = [[ref], (key, first), n]
                else:
                    node.owner[0].append(ref)
                    node.owner[1:] = smaller(node.owner[1], (key, first)), node.owner[2] + n
                if trie.held > 2 * trie_bytes:  # many texts of one length and hash, or one very long text
                    yield from owners(trie.before(head(size, hashed)))
        yield from owners(trie.all())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _bulk(rows(batches), lambda r: 0, names, types)

    return task


def exact_owners(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", trie_bytes: int = 64 << 20, fan_in: int = 32, most_broadcast: int = 100_000) -> DataFrame:
    """For each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    trie_bytes: what a trie may hold before subtrees are spilled; fan_in: partial owners of one key that a task merges
    at once; most_broadcast: up to so many keys with more are broadcast, beyond it they are joined by a shuffle.
    """
    ws = Workspace(docs.sparkSession, "exactdedup")
    # runs that are one space already stay
    text = F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    plain = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("t"))
    keyed = plain.select("id", F.xxhash64("t").alias("hash"), F.col("t").cast("binary").alias("text"))
    parts = ws.save(keyed.mapInArrow(_partial(trie_bytes, 1), PART_FIELDS), "parts")
    rows, texts = parts.where("child IS NOT NULL"), parts.where("child IS NULL")
    frequent = ws.save(texts.groupBy("size", "hash").agg(F.count("*").alias("copies")).where(F.col("copies") > fan_in), "frequent")
    n = frequent.count()
    merged = None
    if n:
        keys = F.broadcast(frequent) if n <= most_broadcast else frequent
        often = texts.join(keys, ["size", "hash"]).withColumn("salt", F.pmod(F.xxhash64("ref"), F.ceil(F.sqrt("copies"))))
        often = often.repartition("size", "hash", "salt").select(F.col("ref").alias("child"), "id", "hash", "text", "first", "n")
        merged = ws.save(often.mapInArrow(_partial(trie_bytes, -1), PART_FIELDS), "merged")
        texts = texts.join(keys, ["size", "hash"], "left_anti").unionByName(merged.where("child IS NULL"))
    fields = ["ref", "size", "hash", "text", "id", "first", "n"]
    met = texts.select(*fields).repartition("size", "hash").sortWithinPartitions("size", "hash")
    owners = met.mapInArrow(_whole(trie_bytes), OWNER_FIELDS)
    if merged is not None:
        owners = ws.save(owners, "owners")
        above = owners.withColumnRenamed("ref", "upper")
        owners = owners.unionByName(merged.where("child IS NOT NULL").select(F.col("child").alias("ref"), F.col("ref").alias("upper")).join(above, "upper").drop("upper"))
    found = rows.select("child", "id", "ref").join(owners, "ref")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("child") == F.col("keep_row")).alias("kept"), "text_sha256")


#: DuckDB SQL for op11_exact_owners.
ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
