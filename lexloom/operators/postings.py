"""A persisted inverted index over chunks: postings in blocks by term, searched with bounds of blocks.

Chunks are taken in buckets of consecutive rows. For each term and bucket one row is written: how many of the bucket's
chunks hold the term, the largest frequency, the shortest of those chunks, and as packed whole numbers the chunks' places
in the bucket with their frequencies, and all positions. A row without a term lists the bucket's chunks. A bucket is made where its
chunks are read, so no term, however common, is gathered: its rows lie in as many tasks and files as it has buckets. Rows
are dealt into folders by a hash of the term, Spark splits folders that are large, and files are sorted by term, so a
search opens the folders of its terms and skips the pages of others.

A search first reads the numbers of its terms' rows alone. They bound every score that a bucket can hold. The buckets
with the highest bounds are scored; the kth score found there excludes all buckets with a lower bound, whose postings are
never read. Results equal those of scoring everything, ties included.
"""

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .phrases import lowered

ROW = "bucket long, term string, n int, most int, shortest int, hits binary, positions binary"
TYPES = [(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in ROW.split(", ")]
LISTED = -1  # the folder of the lists of chunks
#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: A term is a run of letters and digits, in lower case.
TERMS = r"[^\W_]+"


def _packed(arrays: list[np.ndarray], cuts: np.ndarray) -> pa.Array:
    """What stands between cuts in whole numbers of each array, as bytes: a width each, then little-endian numbers, one array after another."""
    size, row = np.diff(cuts), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    most = [np.maximum.reduceat(a, cuts[:-1]) for a in arrays]
    widths = [np.where(m < 1 << 8, 1, np.where(m < 1 << 16, 2, 4)) for m in most]
    ends = np.cumsum(len(arrays) + size * sum(widths))
    at = np.concatenate([[0], ends[:-1]])
    out = np.empty(int(ends[-1]), np.uint8)
    for k, width in enumerate(widths):
        out[at + k] = width
    at = at + len(arrays)
    for values, width in zip(arrays, widths, strict=True):
        place = at[row] + (np.arange(cuts[-1]) - cuts[:-1][row]) * width[row]
        for byte in range(int(width.max())):
            wide = slice(None) if not byte else np.flatnonzero(width[row] > byte)
            out[place[wide] + byte] = values[wide] >> 8 * byte & 255
        at = at + size * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(out)])


def unpacked(data: bytes, arrays: int) -> list[np.ndarray]:
    widths, at = data[:arrays], arrays
    n = (len(data) - arrays) // max(sum(widths), 1)
    found = []
    for w in widths:
        found.append(np.frombuffer(data, f"<u{w}", n, at).astype(np.int64))
        at += n * w
    return found


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[name] if name in columns else pa.nulls(n, kind) for name, kind in TYPES], names=[name for name, _ in TYPES])


def _bucket(number: int, ids: list[str], documents: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    words = [re.findall(TERMS, lowered(t)) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    n, total = len(ids), int(lengths.sum())
    listed = json.dumps([ids, documents, lengths.tolist()]).encode()
    yield _batch({"bucket": pa.array([number]), "n": pa.array([n], pa.int32()), "most": pa.array([0], pa.int32()), "shortest": pa.array([total], pa.int32()), "hits": pa.array([listed])}, 1)
    if not total:
        return
    coded = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
    code = coded.indices.to_numpy()
    slot = np.repeat(np.arange(n), lengths)
    position = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(code, kind="stable")
    code, slot, position = code[order], slot[order], position[order]
    posting = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (slot[1:] != slot[:-1])]))  # where a posting begins
    counts = np.diff(np.append(posting, total))
    block = np.flatnonzero(np.concatenate([[True], code[posting][1:] != code[posting][:-1]]))  # where a term begins, in postings
    cuts = np.append(block, len(posting))
    rows = len(block)
    columns = {
        "bucket": pa.array(np.full(rows, number)), "term": coded.dictionary.take(pa.array(code[posting][block])), "n": pa.array(np.diff(cuts), pa.int32()),
        "most": pa.array(np.maximum.reduceat(counts, block), pa.int32()), "shortest": pa.array(np.minimum.reduceat(lengths[slot[posting]], block), pa.int32()),
        "hits": _packed([slot[posting], counts], cuts), "positions": _packed([position], np.append(posting[block], total)),
    }
    yield _batch(columns, rows)


def _buckets(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == size:
                    yield from _bucket(number, *map(list, zip(*held, strict=True)))
                    number, held = number + 1, []
        if held:
            yield from _bucket(number, *map(list, zip(*held, strict=True)))

    return task


class Index:
    """An index that was written to a folder."""

    def __init__(self, spark: SparkSession, folder: str, shards: int):
        self.spark, self.folder, self.shards = spark, folder, shards
        self.rows = spark.read.schema(f"{ROW}, shard int").parquet(folder)
        self._sizes = None

    def sizes(self) -> tuple[int, float]:
        """(number of chunks, their mean length in words)."""
        if self._sizes is None:
            n, total = self.lists().agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("shortest"), F.lit(0))).first()
            self._sizes = (n, total / n if n else 0.0)
        return self._sizes

    def of(self, terms: list[str]) -> DataFrame:
        """The rows of some terms."""
        shards = [r["s"] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_shard(F.col("t"), self.shards).alias("s")).distinct().collect()]
        return self.rows.where(F.col("shard").isin(shards) & F.col("term").isin(terms))

    def lists(self) -> DataFrame:
        """A row for each bucket, with its chunks."""
        return self.rows.where(F.col("shard") == LISTED)


def _shard(term: Column, shards: int) -> Column:
    return F.when(term.isNotNull(), F.pmod(F.xxhash64(term), F.lit(shards)).cast("int"))


def build(chunks: DataFrame, folder: str, size: int = 8192, shards: int = 32) -> Index:
    """Index chunks (chunk_id, document_id, text) into folder. Null texts have no terms."""
    rows = chunks.select("chunk_id", F.col("document_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.sortWithinPartitions("document_id", "chunk_id")  # a task that runs again makes the same buckets
    made = rows.mapInArrow(_buckets(size), ROW).withColumn("shard", F.coalesce(_shard(F.col("term"), shards), F.lit(LISTED)))
    made.hint("rebalance", "shard").sortWithinPartitions("shard", "term", "bucket").write.mode("overwrite").partitionBy("shard").parquet(folder)
    return Index(chunks.sparkSession, folder, shards)


def _part(by: str, count, length, mean: float):
    """What occurrences of a term add to a chunk's score, but for the term's weight: columns or arrays."""
    return count * 1.0 if by == "hits" else count * (K1 + 1) / (count + K1 * (1 - B + B * length / (mean or 1.0)))


def _best(weights: dict[str, float], by: str, mean: float, wanted: int, k: int):
    """The rows of one bucket, the list of its chunks among them, to its k best chunks."""

    def best(table: pa.Table) -> pa.Table:
        held = dict(zip(table["term"].to_pylist(), table["hits"].to_pylist(), strict=True))
        ids, documents, lengths = json.loads(held.pop(None))
        lengths, score, met = np.array(lengths, np.int64), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for term in sorted(held):
            at, counts = unpacked(held[term], 2)
            score[at] += weights[term] * _part(by, counts.astype(np.float64), lengths[at], mean)
            met[at] += 1
        rows = [(-s, c, d) for s, c, d, m in zip(np.round(score, 9).tolist(), ids, documents, met.tolist(), strict=True) if m >= wanted]
        rows = sorted(rows, key=lambda r: r[:2])[:k]
        columns = [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([-r[0] for r in rows], pa.float64())]
        return pa.Table.from_arrays(columns, names=["chunk_id", "document_id", "score"])

    return best


def search(index: Index, terms: list[str], k: int, by: str = "bm25", all_terms: bool = True) -> DataFrame:
    """chunk_id, document_id, score: the k best chunks that hold all terms (or any), ties to the smaller chunk_id.

    by: "bm25", or "hits" for the number of occurrences. Terms are compared in lower case; repeated ones count once.
    """
    terms = sorted({lowered(t) for t in terms if t})
    rows, listed = index.of(terms), index.lists()
    wanted, weights, mean = len(terms) if all_terms else 1, dict.fromkeys(terms, 1.0), 1.0
    if by == "bm25":
        n, mean = index.sizes()
        held = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term
        weights = {t: float(np.log(1 + (n - held.get(t, 0) + 0.5) / (held.get(t, 0) + 0.5))) for t in terms}
    weight = F.lit(0.0)
    for t, w in weights.items():
        weight = F.when(F.col("term") == t, w).otherwise(weight)
    bounds = rows.groupBy("bucket").agg(F.sum(weight * _part(by, F.col("most"), F.col("shortest"), mean)).alias("bound"), F.count("*").alias("terms"))
    bounds = bounds.where(F.col("terms") >= wanted).select("bucket", (F.col("bound") * (1 + 1e-9)).alias("bound"))
    fields = ["bucket", "term", "hits"]

    def scored(chosen) -> DataFrame:
        """The k best of the chosen buckets."""
        # grouped, not dealt by repartition(): Spark may drop that over a union of joins by bucket and then coalesce the sides apart
        each = chosen(rows.select(*fields).unionByName(listed.select(*fields))).groupBy("bucket")
        return each.applyInArrow(_best(weights, by, mean, wanted, k), "chunk_id string, document_id long, score double").orderBy(F.desc("score"), "chunk_id").limit(k)

    best = [r["bucket"] for r in bounds.orderBy(F.desc("bound"), "bucket").limit(k).collect()]  # at most k numbers
    first = scored(lambda r: r.where(F.col("bucket").isin(best))).collect()
    top = index.spark.createDataFrame([tuple(r) for r in first], "chunk_id string, document_id long, score double")
    least = first[-1]["score"] - 1e-8 if len(first) == k else None
    more = bounds.where(~F.col("bucket").isin(best) & (F.lit(True) if least is None else F.col("bound") >= least)).select("bucket")
    rest = scored(lambda r: r.join(more, "bucket", "left_semi"))
    return top.unionByName(rest).orderBy(F.desc("score"), "chunk_id").limit(k)


def open_buckets(index: Index, terms: list[str], least: float) -> int:
    """How many buckets hold all terms and may hold as many occurrences as `least`: what a search for hits reads."""
    bounds = index.of(terms).groupBy("bucket").agg(F.sum("most").alias("bound"), F.count("*").alias("terms"))
    return bounds.where((F.col("terms") == len(terms)) & (F.col("bound") >= least)).count()
