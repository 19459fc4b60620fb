"""Words and word shingles of Arrow text columns, hashed in numpy, a slice of rows at a time.

A word is a run of anything but the six ASCII white-space characters, A-Z lower-cased. Words and shingles are known by
64-bit hashes: n different ones share a hash with a chance of about n * n / 2**65.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well spread 64-bit value of each 64-bit value."""
    x = np.asarray(x).astype(np.uint64) + np.uint64((salt * 0xD6E8FEB86659FD93 + _FACTOR) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mixed(np.arange(256), 1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd factor, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 256)
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _FACTOR, np.uint64))])
    return _POWERS[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about `limit` bytes; a longer text is a slice of its own. Binary columns too."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, hash of each word; lower-cased bytes)."""
    data = LOWER[data]
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), data
    space = SPACE[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    begins = first.copy()
    begins[0] = True
    begins[1:] |= space[:-1]
    begins &= ~space
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), data
    word = np.cumsum(begins) - 1
    at = np.arange(n) - start[np.maximum(word, 0)]
    at[: start[0]] = 0
    solid = ~space
    value = BYTE_VALUE[data] * powers(int(at.max()) + 1)[at]
    value[space] = 0
    hashed = mixed(np.add.reduceat(value, start))
    length = np.add.reduceat(solid.astype(np.int64), start)
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, length, hashed, data


def shingles(row: np.ndarray, hashed: np.ndarray, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets of the rows in them): runs of `width` words; a row of fewer words has its whole sequence as one."""
    counts = np.bincount(row, minlength=rows)
    n = len(hashed)
    factor = powers(width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        if k < n:
            total[: n - k] += hashed[k:] * factor[k]
    begin = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(n) - begin[row]
    whole = place + width <= counts[row]
    short = np.flatnonzero((counts > 0) & (counts < width))
    for r in short:
        total[begin[r]] = (hashed[begin[r] : begin[r + 1]] * factor[: counts[r]]).sum(dtype=np.uint64)
        whole[begin[r]] = True
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    return mixed(total[whole], 2), np.concatenate([[0], np.cumsum(sizes)])


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for row, own, _ in weighed_shingle_sets(column, width):
        yield row, own


def weighed_shingle_sets(column: pa.Array, width: int = 5, weigh=None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(row, sorted distinct shingle hashes, sums of what weigh(word hashes) says of their words) of every row."""
    for low, high, data, offsets in text_slices(column):
        row, _, _, hashed, _ = word_spans(data, offsets)
        values, at = shingles(row, hashed, high - low, width)
        total = None
        if weigh is not None and len(hashed):
            weight = weigh(hashed)
            padded = np.concatenate([weight, np.zeros(width, weight.dtype)])
            total = sum(padded[k : k + len(weight)] for k in range(width))
            counts = np.bincount(row, minlength=high - low)
            begin = np.concatenate([[0], np.cumsum(counts)])
            whole = np.arange(len(row)) - begin[row] + width <= counts[row]
            for r in np.flatnonzero((counts > 0) & (counts < width)):
                total[begin[r]] = weight[begin[r] : begin[r + 1]].sum()
                whole[begin[r]] = True
            total = total[whole]
        for r in range(high - low):
            own = values[at[r] : at[r + 1]]
            if total is None:
                own = np.sort(own)
                yield low + r, own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own, None
            else:
                order = np.argsort(own)
                own = own[order]
                keep = np.ones(len(own), bool)
                keep[1:] = own[1:] != own[:-1]
                yield low + r, own[keep], total[at[r] : at[r + 1]][order][keep]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], bulk: bool = False) -> Iterator[pa.Table]:
    """Tables of the rows of one key (bulk: of some whole keys), from batches in which equal keys stand together."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != x for c, x in zip(columns, last, strict=True))
        cuts = np.flatnonzero(change)
        last = [c[-1] for c in columns]
        if not len(cuts):
            kept.append(batch)
            continue
        if cuts[0] or kept:
            kept.append(batch.slice(0, cuts[0]))
            yield pa.Table.from_batches(kept)
        if bulk:
            if cuts[-1] > cuts[0]:
                yield pa.Table.from_batches([batch.slice(cuts[0], cuts[-1] - cuts[0])])
        else:
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.Table.from_batches([batch.slice(a, b - a)])
        kept = [batch.slice(cuts[-1])]
    if kept:
        yield pa.Table.from_batches(kept)
