"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie.

Words are the nodes and terminals of a trie that is never in one place: its nodes are rows, known by a hash of their
prefix, and the words below each child are counted by key. Heavy-path decomposition: of each node's children, the one
with most words is heavy, all others are light, and so is a word that ends at the node. Each light subtree is merged
into its heavy sibling with one character changed: the first one replaced by the heavy character, skipped, or, for a word
that lacks one, with the heavy character put before it. A word lies in at most log2(words) light subtrees, so it is
written down again that often at most, small into large. Where terminals coincide, a word with a changed one, or two that
had the same place replaced, the words are one edit apart. Each pair of near words is met once, at the node where the two
part: the one below the light child (or both, where both are light) brings the other's path. Which child counts as heavy
sets the work, not the result.

Merged terminals meet by their text in one shuffle. A text can be met by no more than three changes for each place and
letter, so no key is hot, however many words there are. The nodes of the top three levels, which all words pass, are
broadcast: 90 letters make at most 8,191 of them.

Defined cases: null texts have no words, null ids are written as nothing; equal rows count one by one; very long runs are
words like others, at a cost linear in their length for each light subtree; an empty table gives an empty result.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .words import LOWER, mixed, powers, runs, text_slices

SLICE_BYTES = 4 << 20
LEAD = 0xC3  # first UTF-8 byte of U+00C0 to U+00FF
INSIDE = np.zeros(256, bool)
INSIDE[[*range(65, 91), *range(97, 123), LEAD]] = True
SHORT = 64
LONG = 200  # words of more code points are named by their SHA-256 until their light subtrees are known
TOP = 3
REPLACED, SKIPPED, ADDED, WHOLE = 0, 1, 2, 3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """zlib.crc32(data[start : start + length], seed) of all spans, a byte of all at a time."""
    order = np.argsort(-length, kind="stable")
    start, length, state = start[order], length[order], seeds[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    longer = int(np.searchsorted(-length, -SHORT))  # those of more bytes than SHORT
    for i in range(longer):
        state[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(length[longer]) if longer < len(length) else 0):
        end = int(np.searchsorted(-length, -j))
        now = state[longer:end]
        state[longer:end] = CRC[(now ^ data[start[longer:end] + j]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty(len(state), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, bytes, code points) of the maximal runs of letters in UTF-8 texts."""
    lead = data == LEAD
    inside = INSIDE[data]
    inside[1:] |= lead[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return np.searchsorted(offsets, start, "right") - 1, start, end - start, end - start - (leads[end] - leads[start])


def strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The spans of UTF-8 bytes as strings."""
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    taken = data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(taken)))


def _count(modulus: int, least_length: int):
    def counted(ids: list, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
        row, start, length, points = letter_runs(data, offsets)
        long = points >= least_length
        row, start, length, points = row[long], start[long], length[long], points[long]
        if not len(start):
            return None
        data = LOWER[data]
        seeds = np.zeros(len(ids), np.uint32)
        for r in np.unique(row):
            seeds[r] = zlib.crc32(f"{'' if ids[r] is None else ids[r]}:".encode())
        h = checksums(data, start, length, seeds[row])
        cut = h % modulus == 0
        changed = []
        for s, n, points_, x in zip(start[cut], length[cut], points[cut], h[cut], strict=True):
            if points_ > least_length:
                word, at = data[s : s + n].tobytes().decode(), int(x) % int(points_)
                changed.append(word[:at] + word[at + 1 :])
        words = pa.concat_arrays([strings(data, start[~cut], length[~cut]), pa.array(changed, pa.large_string())])
        found = pc.value_counts(words)
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                found = counted(ids[low:high], data, offsets)
                if found is not None:
                    yield found

    return task


def word_counts(docs: DataFrame, modulus: int = 31, least_length: int = 7, least: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased, some with a code point deleted.

    Where `modulus` divides the crc32 of id, colon and run, the run loses its code point number crc32 % length. Words have at least `least_length` code points and `least` occurrences.
    """
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(_count(modulus, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def steps(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word and each depth from 0 to its length: (word's place, depth, node: hash of the prefix, code point that follows, 0 at the end)."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)  # a zero ends each
    place = np.repeat(np.arange(len(words)), length + 1)
    begin = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    depth = np.arange(len(points)) - begin[place]
    value = mixed(points, 3) * powers(int(depth.max(initial=0)) + 1)[depth]
    before = np.cumsum(value) - value
    return place, depth, mixed(before - before[begin][place], 4).view(np.int64), points.astype(np.int32)


def _words(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches (word, ...) whose words have about most_bytes bytes."""
    for batch in batches:
        for low, high, _, _ in text_slices(batch.column(0), most_bytes):
            yield batch.slice(low, high - low)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _words(batches):
        _, depth, node, following = steps(batch.column(0).to_pylist())
        rows = pa.table({"node": node, "next": following, "top": depth < TOP})
        yield from rows.group_by(["node", "next", "top"]).aggregate([([], "count_all")]).rename_columns(["node", "next", "top", "below"]).to_batches()


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _words(batches):
        place, depth, node, following = steps(batch.column(0).to_pylist())
        for low in range(0, len(place), 1 << 16):
            at = slice(low, low + (1 << 16))
            chosen = batch.take(pa.array(place[at]))
            yield pa.RecordBatch.from_arrays([chosen.column(1), chosen.column(2), pa.array(node[at]), pa.array(depth[at].astype(np.int32)), pa.array(following[at])], names=["name", "n", "node", "depth", "next"])


def light_rows(words: DataFrame, name, heavy: DataFrame) -> DataFrame:
    """name, n, depth, next, heavy: the light subtrees that each word lies in; name: what stands for a word on the way."""
    paths = words.select("word", name.alias("name"), "n").mapInArrow(_paths, "name string, n long, node long, depth int, next int")
    top = paths.where(F.col("depth") < TOP).join(F.broadcast(heavy.where("top").drop("top")), "node")  # at most 8,191 nodes
    deep = paths.where(F.col("depth") >= TOP).join(heavy.where("NOT top").drop("top"), "node")
    return top.unionByName(deep).where("next <> heavy").drop("node")


def heavy_children(words: DataFrame) -> DataFrame:
    """node, top, heavy: the heavy character of each node that has light children or words that end there; top: within the top levels."""
    counts = words.select("word").mapInArrow(_children, "node long, next int, top boolean, below long").groupBy("node", "next", "top").agg(F.sum("below").alias("below"))
    heaviest = F.max_by(F.when(F.col("next") > 0, F.col("next")), F.struct(F.col("next") > 0, "below", "next"))
    return counts.groupBy("node").agg(F.bool_or("top").alias("top"), heaviest.alias("heavy"), F.count("*").alias("kids")).where("kids > 1").drop("kids")


def merged_terminals(words: DataFrame, heavy: DataFrame) -> DataFrame:
    """target, kind, depth, word, n: each word of a light subtree with one character replaced, skipped or added before it, and each word as it is."""
    short, long = words.where(F.length("word") <= LONG), words.where(F.length("word") > LONG)
    light = light_rows(short, F.col("word"), heavy).withColumnRenamed("name", "word")
    names = long.select(F.sha2("word", 256).alias("name"), "word")
    light = light.unionByName(light_rows(long, F.sha2("word", 256), heavy).join(names, "name").drop("name"))
    before, h, rest = F.substring("word", F.lit(1), F.col("depth")), F.expr("chr(heavy)"), F.substring("word", F.col("depth") + 2, F.length("word"))
    changed = F.array(
        F.when(F.col("next") > 0, F.struct(F.lit(REPLACED).alias("kind"), F.concat(before, h, rest).alias("target"))),
        F.when((F.col("next") > 0) & (F.substring("word", F.col("depth") + 2, F.lit(1)) != F.expr("chr(next)")), F.struct(F.lit(SKIPPED).alias("kind"), F.concat(before, rest).alias("target"))),
        F.struct(F.lit(ADDED).alias("kind"), F.concat(before, h, F.substring("word", F.col("depth") + 1, F.length("word"))).alias("target")),
    )
    moved = light.select("word", "n", "depth", F.explode(changed).alias("c")).where("c IS NOT NULL").select("c.target", "c.kind", "depth", "word", "n")
    return moved.unionByName(words.select(F.col("word").alias("target"), F.lit(WHOLE).alias("kind"), F.lit(-1).alias("depth"), "word", "n"))


def _coinciding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by target to (word, near, near_n), both ways, of terminals that coincide."""
    for table in runs(batches, ["target"], bulk=True):
        targets = table.column("target").combine_chunks()
        same = pc.equal(targets[1:], targets[:-1]).to_numpy(zero_copy_only=False) if len(targets) > 1 else np.zeros(0, bool)
        several = np.zeros(len(targets), bool)
        several[1:] |= same
        several[:-1] |= same
        if not several.any():
            continue
        group = np.cumsum(np.concatenate([[True], ~same]))[several]
        rows = table.filter(pa.array(several))
        kind, depth = rows.column("kind").to_numpy(), rows.column("depth").to_numpy()
        bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        left, right = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = [i for i in range(a, b) if kind[i] == WHOLE]
            by_depth: dict[int, list[int]] = {}
            for i in range(a, b):
                if kind[i] == WHOLE:
                    continue
                for j in own:
                    left += i, j
                    right += j, i
                if kind[i] == REPLACED:
                    others = by_depth.setdefault(depth[i], [])
                    for j in others:
                        left += i, j
                        right += j, i
                    others.append(i)
        if left:
            words = rows.select(["word", "n"])
            near = words.take(pa.array(right))
            yield from pa.table({"word": words.column("word").take(pa.array(left)), "near": near.column("word"), "near_n": near.column("n")}).to_batches()


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: for distinct words (word, n), all that are one inserted, deleted or replaced code point away, one row each."""
    ws = Workspace(words.sparkSession, "spelling")
    terminals = merged_terminals(words, ws.save(heavy_children(words), "heavy"))
    return terminals.repartition("target").sortWithinPartitions("target").mapInArrow(_coinciding, "word string, near string, near_n long")


def roots(forms: DataFrame, ws: Workspace) -> DataFrame:
    """word, root: the end of the chain of forms that starts at each word with a form. Each round joins chains to chains, so rounds grow with the logarithm of their length."""
    chains = forms.select("word", F.col("form").alias("root"))
    turn = 0
    while True:
        chains = ws.save(chains, f"chains-{turn}")
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if turn:
            ws.drop(f"chains-{turn - 1}")
        if chains.join(onward, "root", "left_semi").isEmpty():
            return chains
        chains = chains.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
        turn += 1


def spelling_variants(docs: DataFrame, ratio: int = 10, modulus: int = 31, least_length: int = 7, least: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n. A word's form is its near word of largest n (ties: the smallest), if that is at least ratio times the word's own."""
    ws = Workspace(docs.sparkSession, "variants")
    words = ws.save(word_counts(docs, modulus, least_length, least, id_column, text_column), "words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    usual = -F.col("best.n") >= F.col("n") * ratio
    known = ws.save(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.word")).alias("form"), F.when(usual, -F.col("best.n")).alias("form_n")),
        "known",
    )
    ends = roots(known.where("form IS NOT NULL"), ws)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
