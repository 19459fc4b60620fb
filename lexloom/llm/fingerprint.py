"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A paragraph is a line; a long line is also cut after every word whose hash is divisible by 8, so an edit moves no cut
behind it. Each paragraph's digest (the k-th copy of one paragraph has a digest of its own) goes to three cells of a
sketch; a cell keeps a count, the XOR of its digests and the XOR of their checks. Sketches of two versions subtract cell by
cell, what they share vanishes, and peeling cells that hold one digest recovers the digests that differ. When that fails
the difference was too large for the sketch, and sketches of four times as many cells, with other hashes, are built and
subtracted, until one is decoded. Likeness is the share of paragraphs that do not differ: 1 - differing / (all of both).

Digests know words, A-Z lower-cased, and line breaks between them: texts that differ in other white space or in case have
equal fingerprints, as have equal texts.

Defined cases: null and empty texts have no paragraph; two texts without paragraphs are alike (1.0); rows are ordered by
doc_id, null ids last, and by a hash of the text among rows with one id; the only row of a table is its own next; an
empty table gives an empty result.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .words import mixed, powers, text_slices, word_spans

CELLS = 24
TABLES = 3
SUB_BYTES = 1 << 20


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of every paragraph of the texts, in order."""
    rows, digests = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for low, _, data, offsets in text_slices(pa.array(texts, pa.large_string())):
        row, start, length, hashed, data = word_spans(data, offsets)
        if not len(row):
            continue
        lines = np.cumsum(data == 10)[start]
        cut = np.ones(len(row), bool)
        cut[1:] = (row[1:] != row[:-1]) | (lines[1:] != lines[:-1]) | (hashed[:-1] % np.uint64(8) == 0)
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(row)))
        at = np.arange(len(row)) - np.repeat(begin, size)
        digest = mixed(np.add.reduceat(hashed * powers(int(at.max()) + 1)[at], begin), 4)
        rows.append(row[begin] + low)
        digests.append(digest)
    row, digest = np.concatenate(rows), np.concatenate(digests)
    order = np.lexsort((digest, row))  # copies within a row stand together: number them
    r, d = row[order], digest[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    copy = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return r, np.where(copy > 0, mixed(d + copy.astype(np.uint64), 5), d)


class Sketches:
    """One sketch of `cells` cells for each of `rows` rows; insert with sign -1 subtracts."""

    def __init__(self, rows: int, cells: int):
        self.rows, self.cells, self.part = rows, cells, cells // TABLES
        self.count = np.zeros(rows * cells, np.int32)
        self.key = np.zeros(rows * cells, np.uint64)
        self.check = np.zeros(rows * cells, np.uint32)

    def _check(self, digest: np.ndarray) -> np.ndarray:
        return (mixed(digest, 20 + self.cells) >> np.uint64(32)).astype(np.uint32)

    def place(self, row: np.ndarray, digest: np.ndarray, table: int) -> np.ndarray:
        return row * self.cells + table * self.part + (mixed(digest, 1000 * table + self.cells) % np.uint64(self.part)).astype(np.int64)

    def insert(self, row: np.ndarray, digest: np.ndarray, sign) -> None:
        check = self._check(digest)
        for table in range(TABLES):
            at = self.place(row, digest, table)
            np.add.at(self.count, at, np.broadcast_to(np.asarray(sign, np.int32), at.shape))
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign of what differs; which rows decoded). Empties the sketches as far as it comes."""
        found = []
        while True:
            before = len(found)
            for table in range(TABLES):
                view = self.count.reshape(self.rows, TABLES, self.part)[:, table]
                r, c = np.nonzero(np.abs(view) == 1)
                at = r * self.cells + table * self.part + c
                digest = self.key[at]
                pure = (self._check(digest) == self.check[at]) & (self.place(r, digest, table) == at)
                r, digest, sign = r[pure], digest[pure], self.count[at[pure]]
                if len(r):
                    self.insert(r, digest, -sign)
                    found.append((r, digest, sign))
            if len(found) == before:
                break
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = ~left.reshape(self.rows, self.cells).any(axis=1)
        if not found:
            none = np.empty(0, np.int64)
            return none, np.empty(0, np.uint64), none, done
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), done)

    def encoded(self, sizes: np.ndarray) -> list[str]:
        """A printable fingerprint for each row: its number of paragraphs, then its cells."""
        parts = [sizes.astype("<u4")[:, None].view(np.uint8)]
        parts += [x.reshape(self.rows, self.cells).astype(kind).view(np.uint8) for x, kind in ((self.count, "<i4"), (self.key, "<u8"), (self.check, "<u4"))]
        return [base64.b64encode(x.tobytes()).decode() for x in np.concatenate(parts, axis=1)]


def difference(rows: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS, budget: int = 4_000_000, most_cells: int = CELLS * 4**13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, sign: 1 only in a, -1 only in b) of what differs; a, b: (row, digest) of the paragraphs of rows 0 .. rows - 1."""
    found = []
    open_ = np.arange(rows)
    while len(open_):
        if cells > most_cells:  # two digests that share all cells at every size, or a difference beyond any text's
            raise RuntimeError(f"difference: {len(open_)} rows do not decode in {most_cells} cells")
        failed = []
        step = max(1, budget // cells)
        for low in range(0, len(open_), step):
            own = open_[low : low + step]
            number = np.full(rows, -1)
            number[own] = np.arange(len(own))
            sketch = Sketches(len(own), cells)
            for (row, digest), sign in ((a, 1), (b, -1)):
                mine = number[row]
                sketch.insert(mine[mine >= 0], digest[mine >= 0], sign)
            r, digest, sign, done = sketch.peel()
            found.append((own[r[done[r]]], digest[done[r]], sign[done[r]]))
            failed.append(own[~done])
        open_, cells = np.concatenate(failed), cells * 4
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def likeness(rows: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 - differing paragraphs / paragraphs of both, for each row."""
    differing = np.bincount(difference(rows, a, b)[0], minlength=rows)
    total = np.bincount(a[0], minlength=rows) + np.bincount(b[0], minlength=rows)
    return np.where(total > 0, 1 - differing / np.maximum(total, 1), 1.0)


def edited(text: str, following: str) -> str:
    """text, its last half replaced by as many first code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def described(texts: list[str], following: list[str]) -> dict[str, list]:
    """The result columns beside doc_id; following: the next text of each."""
    k = len(texts)
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    row, digest = paragraphs([*texts, *changed, *following])
    parts = [(row[m] - base, digest[m]) for base, m in ((base, (row >= base) & (row < base + k)) for base in (0, k, 2 * k))]
    codes = []
    for r, d in parts[:2]:
        sketch = Sketches(k, CELLS)
        sketch.insert(r, d, 1)
        codes.append(sketch.encoded(np.bincount(r, minlength=k)))
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": codes[0],
        "edited_fingerprint": codes[1],
        "near_edited": likeness(k, parts[0], parts[1]),
        "near_next": likeness(k, parts[0], parts[2]),
    }


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and segment, guest: each segment in one partition, by falling doc_id, closed by a guest: the row that follows its last.

    Segments are ranges of ids of about equal size, several a partition; rows without an id, and those of an id that is
    a segment or more by itself, are cut on by ranges of the text's hash. The whole table is shuffled once.
    """
    spark = docs.sparkSession
    segments = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    found = rows.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / segments for i in range(1, segments)], 0.25 / segments)
    value, times = np.unique(np.array(found, np.float64), return_counts=True)
    many = (times > 1) & (np.abs(value) < 2**53)  # beyond, several ids are one double
    cuts = np.union1d(value, np.nextafter(value[many], -np.inf))
    parts = np.ones(len(cuts) + 1, np.int64)
    parts[np.searchsorted(cuts, value[many])] = times[many] + 1
    base = np.concatenate([[segments], segments + np.cumsum(parts)])  # the first numbers are those of null ids

    @F.arrow_udf("long")
    def segment_of(ids: pa.Array, ties: pa.Array) -> pa.Array:
        place = np.searchsorted(cuts, ids.cast(pa.float64(), safe=False).fill_null(0).to_numpy(zero_copy_only=False), "left")
        none = ids.is_null().to_numpy(zero_copy_only=False)
        share = np.where(none, segments, parts[place])
        tie = (ties.to_numpy(zero_copy_only=False) >> 32) + (1 << 31)  # rises with the hash, 0 to 2**32
        return pa.array(np.where(none, 0, base[place]) + (tie * share >> 32), pa.int64())

    ids = rows.select("doc_id", F.xxhash64("text").alias("tie")).withColumn("segment", segment_of("doc_id", "tie"))
    order = F.struct(F.col("doc_id"), F.col("tie"))
    first = {r["segment"]: r["first"] for r in ids.groupBy("segment").agg(F.max(order).alias("first")).collect()}  # a row a segment
    falling = sorted(first, reverse=True)
    heads = [(first[falling[(i + 1) % len(falling)]]["doc_id"], first[falling[(i + 1) % len(falling)]]["tie"], s) for i, s in enumerate(falling)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = F.broadcast(spark.createDataFrame(heads, f"_id {kind}, _tie long, segment long"))
    guests = rows.join(heads, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tie")))
    guests = guests.dropDuplicates(["segment"]).select("doc_id", "text", "segment", F.lit(1).alias("guest"))
    all_ = rows.select("doc_id", "text", segment_of("doc_id", F.xxhash64("text")).alias("segment"), F.lit(0).alias("guest")).unionByName(guests)
    return all_.repartition("segment").sortWithinPartitions("segment", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The next document is the next by falling doc_id, after the last the first; see edited() for the edited text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (id, text); the last waits for its next
        for batch in batches:
            size = 0
            for id_, text, guest in zip(batch.column(0), batch.column(1), batch.column(3).to_pylist(), strict=True):
                held.append((id_, text.as_py()))
                size += len(held[-1][1])
                if guest or size > SUB_BYTES and len(held) > 1:
                    yield made(held)
                    held, size = [] if guest else held[-1:], 0

    def made(held: list[tuple]) -> pa.RecordBatch:
        columns = described([t for _, t in held[:-1]], [t for _, t in held[1:]])
        ids = pa.array([i.as_py() for i, _ in held[:-1]], held[0][0].type)
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, columns.values())], names=["doc_id", *columns])

    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).select("doc_id", "text", "segment", "guest").mapInArrow(describe, result)
