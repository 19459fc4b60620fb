"""Packing documents into training sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one rest. Lengths are counted in a histogram of at most
capacity / grid classes, which is all that reaches the driver. A linear program over patterns (how many pieces of each
class share a sequence) is solved by column generation: the simplex prices new patterns with a knapsack dynamic program.
The patterns' uses are rounded down, what is left is packed first-fit-decreasing, and the pieces of a class, ranked by a
hash and their document, go to the places that the patterns offer. Ranks come from counts per (class, bucket), so no
class meets in one task, whatever its share of the rows.

Defined cases: null and empty texts are one piece, the end id alone; a text of any length is cut into full sequences;
rows that repeat are packed one by one (they may swap places); an empty table gives an empty result.
"""

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

#: How a byte-level tokenizer parts a text before it joins bytes (fixed values: the published pattern, and the bytes that stand for themselves).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def written_bytes() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones are themselves, the others count on from 256."""
    others = [b for b in range(256) if b not in set(PLAIN)]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked_encoding(tokenizer_file: str):
    """The same encoding by tiktoken, or None where the file is more than ranks of byte strings: other merges, other pre-tokens, a normalizer."""
    import tiktoken

    with open(tokenizer_file, encoding="utf-8") as f:
        file = json.load(f)
    model, parts, added = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
    if model.get("type", "BPE") != "BPE" or file["normalizer"] or parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or not parts.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
        return None
    special = {x["content"]: x["id"] for x in added}
    vocab = {w: i for w, i in model["vocab"].items() if w not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [vocab.get(w) for w in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None  # ids are no ranks
    value = written_bytes()
    ranks = {bytes(value[c] for c in w): i for w, i in vocab.items()}
    return tiktoken.Encoding(tokenizer_file, pat_str=PARTS, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of texts, as little-endian uint32 bytes, by a file of the tokenizers library; strings of added tokens in a text are those tokens.

    A byte-level BPE file whose ids rise with its merges is read as ranks for tiktoken, which gives the same ids in a
    quarter of the time; other files go to the tokenizers library itself.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.fast = ranked_encoding(tokenizer_file)
        self.plain = None if self.fast else Tokenizer.from_file(tokenizer_file)

    def ids(self, text: str) -> bytes:
        if self.fast:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; with_ids adds the ids themselves (binary, little-endian uint32)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _ENCODERS:
            _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
        encoder = _ENCODERS[tokenizer_file]
        for batch in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                data = encoder.ids(text.as_py()) + end if text.as_py() else end
                n = len(data) // 4
                for at in range(0, n, capacity):
                    piece = data[4 * at : 4 * (at + capacity)]
                    rows.append(row)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(piece)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, f"doc_id {kind}, {PIECES}" + ", ids binary" * with_ids)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity: its value, and how often each size is in it."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = sizes <= room
        gains = best[room - sizes[fits]] + values[fits]
        if gains.size and gains.max() > best[room] + 1e-12:
            i = int(gains.argmax())
            best[room], chosen[room] = gains[i], np.flatnonzero(fits)[i]
    uses, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            uses[chosen[room]] += 1
            room -= sizes[chosen[room]]
    return float(best[capacity]), uses


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in the linear program that covers demand with the fewest sequences.

    Revised simplex from one pattern per size; it ends within `gap` of the optimum (Farley's bound) or after `most` columns.
    """
    m = len(sizes)
    patterns = np.diag(np.floor(capacity / sizes))
    inverse = np.diag(1 / np.diag(patterns))
    level = inverse @ demand
    for step in range(most):
        prices = inverse.sum(axis=0)
        value, column = knapsack(sizes, prices, capacity)
        if value <= 1 + gap:
            break
        move = inverse @ column
        ratios = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratios.argmin())
        level = np.maximum(level - ratios[out] * move, 0)
        level[out] = ratios[out]
        patterns[:, out] = column
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
        if step % 200 == 199:  # against rounding errors
            inverse = np.linalg.inv(patterns)
            level = np.maximum(inverse @ demand, 0)
    return [(patterns[:, i].astype(np.int64), float(level[i])) for i in range(m)]


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern: {size: count}, sequences of it): room for every piece of the histogram {size: pieces}, sizes in grid steps."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
    if not sizes.size:
        return []
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    plan: dict[tuple[int, ...], int] = {}
    for pattern, level in column_generation(sizes, left.astype(float), capacity):
        fits = min((int(left[i] // pattern[i]) for i in np.flatnonzero(pattern)), default=0)
        if (uses := min(int(level + 1e-6), fits)) > 0:
            plan[tuple(pattern)] = plan.get(tuple(pattern), 0) + uses
            left -= uses * pattern
    while left.any():  # rounding leaves less than a sequence a pattern: first-fit-decreasing, equal sequences together
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= int(pattern[i] * sizes[i])
        uses = min(int(left[i] // pattern[i]) for i in np.flatnonzero(pattern))
        plan[tuple(pattern)] = plan.get(tuple(pattern), 0) + uses
        left -= uses * pattern
    return [({int(sizes[i]): int(p[i]) for i in np.flatnonzero(p)}, n) for p, n in ((np.array(p), n) for p, n in plan.items())]


def assign(pieces: DataFrame, capacity: int = 2048, grid: int = 8, bucket_rows: int = 20_000) -> DataFrame:
    """pieces (with doc_id, start, length) -> also sequence_id, offset. pieces is read more than once: pass a written table."""
    spark = pieces.sparkSession
    size = F.ceil(F.col("length") / grid).cast("int")
    counts = pieces.groupBy(size.alias("size")).count().collect()  # at most capacity / grid rows
    histogram = {r["size"]: r["count"] for r in counts}
    plan = plan_sequences(histogram, capacity // grid)
    places, first, offered = [], 0, dict.fromkeys(histogram, 0)
    for pattern, sequences in plan:
        slot = 0
        for s in sorted(pattern, reverse=True):
            places.append((s, offered[s], offered[s] + pattern[s] * sequences, pattern[s], first, slot))
            offered[s] += pattern[s] * sequences
            slot += pattern[s]
        first += sequences
    # one row a (pattern, size): the ranks of that size that go there. Bounded by the square of capacity / grid.
    table = spark.createDataFrame(places, "size int, low long, high long, per int, first long, slot int")
    buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    ranked = pieces.withColumn("size", size).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = ranked.groupBy("size", "bucket").count().withColumn("before", F.sum("count").over(W.partitionBy("size").orderBy("bucket")) - F.col("count")).drop("count")
    inside = W.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = ranked.withColumn("rank", F.row_number().over(inside) - 1).join(sums, ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = F.col("rank") - F.col("low")
    r, t = ranked.alias("r"), F.broadcast(table).alias("t")
    placed = r.join(t, (F.col("r.size") == F.col("t.size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.select("r.*", (F.col("first") + F.floor(at / F.col("per"))).alias("sequence_id"), (F.col("slot") + at % F.col("per")).alias("place"))
    before = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.withColumn("offset", F.sum("length").over(before) - F.col("length")).drop("size", "bucket", "rank", "before", "place")


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, grid: int = 8, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (with_ids: also ids) of each piece of docs.

    Pieces of up to `grid` different lengths share a class; a sequence wastes less than grid tokens a piece on that.
    """
    ws = Workspace(docs.sparkSession, "pack")
    return assign(ws.save(token_pieces(docs, tokenizer_file, capacity, end_id, with_ids), "pieces"), capacity, grid)
