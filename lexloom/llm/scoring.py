"""Language-model scores by Brown's class-based bigrams.

Every word belongs to a class; a text's probability is the product of class-transition and word-emission probabilities,
from a start mark to an end mark. The most frequent words are items of their own, all others share the item of their
ending (the last three bytes; rare endings share one item), so the class of any word, unknown ones too, is known from the
word alone. The exchange algorithm moves items between classes while the likelihood of the training bigrams rises; it
works on item bigrams, a table whose size is bounded by the number of items. Then every other training word is exchanged
too: a pass over all training texts counts the classes beside each of its places, and the word takes the class by which the
likelihood gains most against the class bigrams as they stand. Texts become lines of classes, once by item and once by
each word's own class; class bigrams are counted from the training lines, and the own classes are kept if they make those
likelier. Only item and class bigrams reach the driver. Words that training lacks have the class of their ending. Counts
of words, endings and bigrams cover all training texts.

A class emits its words by add-one counts, with one place for words that training lacks if it holds endings, so
probabilities sum to one. Words are known by 64-bit hashes of their lower-cased bytes. The most frequent words' counts and
classes go to every task (a table of at most `head` rows); those of all others come by a join on the word.

Defined cases: null and empty texts are the end token alone; rows with a null doc_id train and are not held out; rows that
repeat count, and are returned, one by one; without training texts all counts are 0; an empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, most_frequent, remainder, text_or_empty
from .words import mixed, text_slices, word_spans

CHUNK = 2_000_000
START, END, FIRST = 0, 1, 2  # items
END_WORD = int(mixed(np.array([0]), 99)[0].view(np.int64))


def endings(start: np.ndarray, length: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A number for the last three bytes of each word and how many it has of them."""
    last = start + length - 1
    code = np.minimum(length, 3) << 24
    for k in range(3):
        code = code | np.where(length > k, data[np.maximum(last - k, 0)].astype(np.int64) << (8 * k), 0)
    return code


def summed(values: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values, one of each further column, counts."""
    order = np.argsort(values)
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else order
    return values[first], *(x[order[first]] for x in more), np.diff(np.append(first, len(values)))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, ending, n over all texts (a column text), the end mark included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            word, ending, n = summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(ending), pa.array(n)], names=["word", "ending", "n"])

        for batch in batches:
            held.append((np.full(batch.num_rows, END_WORD), np.zeros(batch.num_rows, np.int64)))
            size += batch.num_rows
            for _, _, data, offsets in text_slices(batch.column(0)):
                _, start, length, hashed, data = word_spans(data, offsets)
                held.append((hashed.view(np.int64), endings(start, length, data)))
                size += len(start)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.select("text").mapInArrow(count, "word long, ending long, n long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Lookup:
    """Numbers by sorted keys."""

    keys: np.ndarray
    values: np.ndarray
    some: np.ndarray | None = None
    mask: int = 0

    @classmethod
    def of(cls, keys, values) -> "Lookup":
        keys = np.asarray(keys, np.int64)
        order = np.argsort(keys)
        return cls(keys[order], np.asarray(values)[order])

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        out = np.full(keys.shape, default, self.values.dtype if len(self.keys) else np.int64)
        if len(self.keys):
            if self.some is None:  # which low bits occur: most keys that are not here need no search
                self.mask = (1 << (16 * len(self.keys)).bit_length()) - 1
                self.some = np.zeros(self.mask + 1, bool)
                self.some[self.keys & self.mask] = True
            near = np.flatnonzero(self.some[keys & self.mask])
            at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
            hit = self.keys[at] == keys[near]
            out[near[hit]] = self.values[at[hit]]
        return out


@dataclass
class Items:
    """The item of any word: its own, or that of its ending."""

    words: Lookup
    ends: Lookup
    size: int

    def of(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        own = self.words.get(word, -1)
        rest = np.flatnonzero(own < 0)
        own[rest] = self.ends.get(ending[rest], self.size - 1)
        return own


def sequence(row: np.ndarray, item: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) items of the bigrams of each row, start and end marks included; the first len(item) stand with the words, then one end a row."""
    left = np.empty(len(item), np.int64)
    left[1:] = item[:-1]
    first = np.ones(len(item), bool)
    first[1:] = row[1:] != row[:-1]
    left[first] = START
    last = np.full(rows, START)
    last[row] = item  # the last of a row's words stays
    return np.concatenate([left, last]), np.concatenate([item, np.full(rows, END)])


def item_bigrams(texts: DataFrame, items: Items) -> np.ndarray:
    """Counts of all item bigrams of all texts: items.size squared numbers at most."""
    shared = texts.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, its = [], 0, shared.value

        def flush():
            code, n = summed(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(0)):
                row, start, length, hashed, data = word_spans(data, offsets)
                left, right = sequence(row, its.of(hashed.view(np.int64), endings(start, length, data)), high - low)
                held.append(left * its.size + right)
                size += len(left)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = texts.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(items.size * items.size)
    out[found["code"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out.reshape(items.size, items.size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, passes: int = 12) -> np.ndarray:
    """The class of each item, by the exchange algorithm; the start and end marks keep classes 0 and 1 for themselves."""
    size = len(bigrams)
    own = np.empty(size, np.int64)
    own[:FIRST] = [START, END]
    by_weight = FIRST + np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[FIRST:], kind="stable")
    own[by_weight] = FIRST + np.arange(size - FIRST) % (classes - FIRST)
    member = np.zeros((size, classes))
    member[np.arange(size), own] = 1
    after, before = bigrams @ member, bigrams.T @ member  # of each item: counts of the classes to its right, to its left
    table = member.T @ after
    free = np.arange(classes) >= FIRST
    diagonal = np.arange(classes)
    for _ in range(passes):
        moved = 0
        for w in by_weight:
            a, s = own[w], bigrams[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[a] -= s
            left[a] -= s
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= s
            x = _xlogx(table)
            rows, columns = _xlogx(table + right), _xlogx(table + left[:, None])
            gain = rows.sum(1) - x.sum(1) + columns.sum(0) - x.sum(0)
            d = table[diagonal, diagonal]
            gain += _xlogx(d + right + left + s) - rows[diagonal, diagonal] - columns[diagonal, diagonal] + x[diagonal, diagonal]
            for margin, more in ((table.sum(1), right.sum() + s), (table.sum(0), left.sum() + s)):
                gain -= _xlogx(margin + more) - _xlogx(margin)
            gain[~free] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += right
            table[:, b] += left
            table[b, b] += s
            if b != a:
                own[w], moved = b, moved + 1
                after[:, a] -= bigrams[:, w]
                after[:, b] += bigrams[:, w]
                before[:, a] -= bigrams[w]
                before[:, b] += bigrams[w]
        if moved <= size // 200:
            break
    return own


def neighbours(texts: DataFrame, items: Items, classes: np.ndarray) -> DataFrame:
    """word, places: of each word that is no item, its places of about CHUNK tokens; a place is its own class, the class to its left and that to its right, packed by number of classes in four bytes."""
    shared = texts.sparkSession.sparkContext.broadcast((items, classes))
    base = int(classes.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, (its, of) = [], 0, shared.value

        def flush():
            word, places = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(word)
            word = word[order]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            for low in range(0, len(first), 50_000):  # rows of some ten bytes
                part = np.append(first, len(word))[low : low + 50_001]
                data = places[order[part[0] : part[-1]]]
                lists = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer((4 * (part - part[0])).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(word[part[:-1]]), lists], names=["word", "places"])

        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(0)):
                row, start, length, hashed, data = word_spans(data, offsets)
                word = hashed.view(np.int64)
                item = its.of(word, endings(start, length, data))
                own = of[item].astype(np.int32)
                left, right = np.full(len(own), START, np.int32), np.full(len(own), END, np.int32)
                same = row[1:] == row[:-1]
                left[1:][same], right[:-1][same] = own[:-1][same], own[1:][same]
                rest = item >= FIRST + len(its.words.keys)  # known by their endings
                held.append((word[rest], ((own * base + left) * base + right)[rest]))
                size += int(rest.sum())
                if size >= CHUNK:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return texts.select("text").mapInArrow(count, "word long, places binary")


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, but for what does not depend on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


class Gains:
    """What class bigrams gain in likelihood where n places are added to them: kept by n up to `most`, worked out beyond."""

    def __init__(self, table: np.ndarray, most: int = 64):
        self.classes, self.most = len(table), most
        #: by slot: counts of each class before that class, of each class behind it, and the margins
        self.counts = np.concatenate([table.T, table, [table.sum(1)], [table.sum(0)]])
        self.kept = np.stack([self._gain(self.counts, np.float64(n)) for n in range(most + 1)])

    @staticmethod
    def _gain(x: np.ndarray, n) -> np.ndarray:
        return _xlogx(x + n) - _xlogx(x)

    def of(self, slot: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of each row, by class; the class that the word has now is counted without the word."""
        out = self.kept[np.minimum(n, self.most), slot]
        many = np.flatnonzero(n > self.most)
        out[many] = self._gain(self.counts[slot[many]], n[many][:, None])
        out[np.arange(len(n)), own] = self._gain(np.maximum(self.counts[slot, own] - n, 0), n)
        return out


def best_classes(of: np.ndarray, slot: np.ndarray, n: np.ndarray, now: np.ndarray, gains: Gains) -> tuple[np.ndarray, np.ndarray]:
    """(count, class by which the likelihood gains most) of each word, from rows (of: its number, slot: a class to the right, or to the left if it is beyond the classes, n), by word; now: its class."""
    base, first = gains.classes, np.searchsorted(of, np.arange(len(now)))
    total = np.add.reduceat(np.where(slot < base, n, 0), first)
    gain = np.add.reduceat(gains.of(slot, n, now[of]), first, axis=0)
    for margin in (2 * base, 2 * base + 1):
        gain -= gains.of(np.full(len(now), margin), total, now)
    gain[:, :FIRST] = -np.inf
    row = np.arange(len(now))
    top = gain.argmax(1)
    return total, np.where(gain[row, top] > gain[row, now] + 1e-9, top, now)


def word_classes(found: DataFrame, table: np.ndarray) -> DataFrame:
    """word, n, before (the class of its item), class (the best by its neighbours) of each word of neighbours(); table: class bigrams by item."""
    shared, base = found.sparkSession.sparkContext.broadcast(table), len(table)
    names = ["word", "n", "before", "class"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, last = Gains(shared.value), None  # the last word may go on in the next batch: its number, class and counts by slot

        def chosen(words, now, of, slot, n) -> pa.RecordBatch:
            total, best = best_classes(of, slot, n, now, gains)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(total), pa.array(now.astype(np.int32)), pa.array(best.astype(np.int32))], names=names)

        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1)):
                word, places = batch.column(0).to_numpy()[low:high], data.view(np.int32)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                words, now = word[first], places[offsets[first] // 4] // (base * base)
                number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
                number = np.repeat(number, np.diff(offsets) // 4)
                of, slot, n = np.concatenate([number, number]), np.concatenate([places % base, base + places // base % base]), np.ones(2 * len(places), np.int64)
                if last is not None:
                    if last[0] != words[0]:
                        words, now, of = np.append(last[0], words), np.append(last[1], now), of + 1
                    of, slot, n = np.append(np.zeros(len(last[2]), np.int64), of), np.append(last[2], slot), np.append(last[3], n)
                code = of * (2 * base) + slot
                order = np.argsort(code)
                code, n = code[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                of, slot, n = code[first] // (2 * base), code[first] % (2 * base), np.add.reduceat(n, first)
                end = int(np.searchsorted(of, len(words) - 1))
                last = words[-1], now[-1], slot[end:], n[end:]
                if end:
                    yield chosen(words[:-1], now[:-1], of[:end], slot[:end], n[:end])
        if last is not None:
            yield chosen(np.array([last[0]]), np.array([last[1]]), np.zeros(len(last[2]), np.int64), last[2], last[3])

    # a word has a row a chunk of texts, which are folded as they come: no word's places are gathered
    return found.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word long, n long, before int, class int")


@dataclass
class Words:
    """What is known of words without a join."""

    items: Items
    classes: np.ndarray  # of each item
    head: Lookup  # counts of the most frequent words
    head_classes: Lookup  # their own classes
    ends: int  # training texts
    tokens: int
    base: float  # log10 of the unigram divisor


@dataclass
class Model:
    transition: np.ndarray  # log10 by class
    emission: np.ndarray  # log10 of each class's divisor
    own: bool  # by words' own classes, or else by those of their items


def fit_words(train: DataFrame, ws: Workspace, words: int = 768, ends: int = 480, classes: int = 40, head: int = 250_000) -> tuple[Words, DataFrame]:
    """Classes of all training words: the frequent ones, and the table word, n, before, class of all."""
    spark = train.sparkSession
    vocabulary = ws.save(word_counts(train), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(vocabulary, "word", head)
    documents = int(top.loc[top["word"] == END_WORD, "n"].sum())
    top = top[top["word"] != END_WORD]
    own = top["word"].to_numpy(np.int64)[:words]
    own_rows = spark.createDataFrame([(int(w),) for w in [*own, END_WORD]], "word long")  # at most words + 1 rows
    rest = vocabulary.join(F.broadcast(own_rows), "word", "left_anti")
    common = [r["ending"] for r in rest.groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "ending").limit(ends).collect()]
    size = FIRST + len(own) + len(common) + 1
    items = Items(Lookup.of(own, FIRST + np.arange(len(own))), Lookup.of(common, FIRST + len(own) + np.arange(len(common))), size)
    bigrams = item_bigrams(train, items)
    of_item = exchange(bigrams, classes)
    member = np.zeros((size, classes))
    member[np.arange(size), of_item] = 1
    found = neighbours(train, items, np.append(of_item, classes - 1))
    fixed = [(int(w), int(c), int(k), int(k)) for w, c, k in zip(own, top["n"][:words], of_item[FIRST:], strict=False)] + [(END_WORD, documents, END, END)] * (documents > 0)
    fixed = spark.createDataFrame(fixed, "word long, n long, before int, class int")
    state = ws.save(word_classes(found, member.T @ bigrams @ member).unionByName(fixed), "classes")
    ws.drop("vocabulary")
    spark.sparkContext._jvm.System.gc()  # else the shuffle files of these passes stay
    least = int(top["n"].min()) if len(top) else 1
    rows = state.where(F.col("n") >= least).select("word", "class").toPandas()  # as many as `top`
    known = Lookup.of(top["word"], top["n"].to_numpy(np.int64))
    return Words(items, of_item, known, Lookup.of(rows["word"], rows["class"].to_numpy(np.int64)), documents, int(n), float(np.log10(n + v + 1))), state


def class_lines(docs: DataFrame, words: Words, state: DataFrame) -> DataFrame:
    """doc_id, copies, n_tokens, n_known, base_score, total (log10 of word counts), before, line: each text as a line of classes, a byte a word.

    before holds the classes of items, line those of the words themselves. Rows with one doc_id and text are one row, counted by copies.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(2)):
                rows = high - low
                row, start, length, hashed, data = word_spans(data, offsets)
                word = hashed.view(np.int64)
                count = m.head.get(word, 0)
                head = count > 0
                counted = np.bincount(row, np.log10(count + 1), rows)
                tokens = np.bincount(row, minlength=rows) + 1
                known = np.bincount(row, head, rows).astype(np.int64) + (m.ends > 0)
                base = counted + np.log10(m.ends + 1) - tokens * m.base
                # one row a document with the classes of its words, and one for each of its words that is not in the head
                by_item = m.classes[m.items.of(word, endings(start, length, data))]
                own = np.where(head, m.head_classes.get(word, 0), by_item)
                first = np.concatenate([[0], np.cumsum(tokens - 1)])
                lines = [pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(x.astype(np.uint8))]) for x in (by_item, own)]
                tail_row, tail_word = row[~head], word[~head]
                t = len(tail_row)
                zero, none = np.zeros(t, np.int64), np.zeros(t)
                at = pa.array(np.concatenate([np.arange(rows), tail_row]) + low)
                spread = batch.column(3).to_numpy()[low:high]
                columns = [np.concatenate(x) for x in ((spread, tail_word), (np.ones(rows, np.int64), zero), (tokens, zero), (known, zero), (base, none), (counted, none))]
                place = np.concatenate([np.zeros(rows, np.int32), (np.flatnonzero(~head) - first[tail_row]).astype(np.int32)])
                lines = [pa.concat_arrays([x, pa.nulls(t, pa.binary())]) for x in lines]
                names = ["doc_id", "key", "word", "copies", "n_tokens", "n_known", "base", "total", "place", "before", "line"]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, columns), pa.array(place), *lines], names=names)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Puts the classes of words outside the head at their places in the line."""
        for batch in batches:
            line, tails = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for low, high, data, first in text_slices(line):
                part, own = tails.slice(low, high - low), data.copy()
                rows = part.flatten()
                own[np.repeat(first[:-1], np.diff(part.offsets.to_numpy())) + rows.field(0).to_numpy()] = rows.field(1).to_numpy()
                whole = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low) for i in range(batch.num_columns - 2)), whole], names=LINE)

    text = text_or_empty()
    # a document's own row goes to a place of its own, however many documents have its text
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"), F.xxhash64(F.lit("a document"), "doc_id", text).alias("spread"))
    parts = rows.mapInArrow(read, f"doc_id {kind}, key long, word long, copies long, n_tokens long, n_known long, base double, total double, place int, before binary, line binary")
    joined = parts.join(state.select("word", "n", "class"), "word", "left")
    tail = F.when((F.col("copies") == 0) & F.col("n").isNotNull(), F.col("n"))
    more = F.log10(F.coalesce(tail, F.lit(0)) + 1)
    sums = joined.groupBy("doc_id", "key").agg(
        F.sum("copies").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + tail.isNotNull().cast("long")).alias("n_known"),
        F.sum(F.col("base") + more).alias("base_score"),
        F.sum(F.col("total") + more).alias("total"),
        F.first("before", ignorenulls=True).alias("before"),
        F.first("line", ignorenulls=True).alias("line"),
        F.collect_list(F.when(tail.isNotNull(), F.struct("place", "class"))).alias("tails"),
    )
    # rows with the same id and text were summed together; their words, at the same places, have the same classes
    each = [(F.col(c) / F.col("copies")).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("total", "double"))]
    return sums.select("doc_id", "copies", *each, "before", "line", "tails").mapInArrow(placed, f"doc_id {kind}, copies long, n_tokens long, n_known long, base_score double, total double, before binary, line binary")


LINE = ["doc_id", "copies", "n_tokens", "n_known", "base_score", "total", "before", "line"]


def steps(lines: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first line, end line, line, left class, right class) of every step of some lines, from the start mark to the end mark, a slice of lines at a time."""
    for low, high, data, offsets in text_slices(lines):
        row = np.repeat(np.arange(high - low), np.diff(offsets))
        left, right = sequence(row, data.astype(np.int64), high - low)
        yield low, high, np.concatenate([row, np.arange(high - low)]) + low, left, right


def class_bigrams(lines: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of class bigrams of all lines: by items, and by the words themselves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, classes * classes), np.int64)
        for batch in batches:
            copies = batch.column(0).to_numpy()
            for k in range(2):
                for _, _, row, left, right in steps(batch.column(1 + k)):
                    total[k] += np.bincount(left * classes + right, copies[row], classes * classes).astype(np.int64)
        kind, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(code), pa.array(total[kind, code])], names=["kind", "code", "n"])

    out = np.zeros((2, classes * classes))
    for r in lines.select("copies", "before", "line").mapInArrow(count, "kind long, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")).collect():
        out[r["kind"], r["code"]] = r["n"]
    return out[0].reshape(classes, classes), out[1].reshape(classes, classes)


def fit_model(lines: DataFrame, words: Words, state: DataFrame, classes: int = 40, back_off: float = 5.0, own: bool | None = None) -> Model:
    """Probabilities of classes and of their words, from the lines of the training texts; own: which classes, None for the likelier."""
    by_item, by_word = class_bigrams(lines, classes)
    own = likelihood(by_word) >= likelihood(by_item) if own is None else own
    table = by_word if own else by_item
    overall = table.sum(0) + 1
    overall[START] = 0
    overall /= overall.sum()
    with np.errstate(divide="ignore"):
        transition = np.log10((table + back_off * overall) / (table.sum(1, keepdims=True) + back_off))
    divisor = np.zeros(classes)
    for r in state.groupBy((F.col("class") if own else F.col("before")).alias("class")).agg((F.sum("n") + F.count("*")).alias("d")).collect():
        divisor[r["class"]] = r["d"]
    divisor[np.unique(words.classes[FIRST + len(words.items.words.keys) :])] += 1  # the place of unknown words
    divisor[END] = 0
    return Model(transition, np.log10(np.maximum(divisor, 1)), bool(own))


def scores(lines: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each document of lines."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "copies", "n_tokens", "n_known", "base_score"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            more = np.zeros(batch.num_rows)
            for low, high, row, left, right in steps(batch.column(6)):
                more[low:high] = np.bincount(row - low, m.transition[left, right] - m.emission[right], high - low)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(batch.column(5).to_numpy() + more)], names=[*names, "score"])

    kind = lines.schema["doc_id"].dataType.simpleString()
    found = lines.select(*names, "total", "line" if model.own else "before").mapInArrow(follow, f"doc_id {kind}, copies long, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def score_documents(docs: DataFrame, modulus: int = 7, kept_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    held_out: the rows whose crc32(doc_id as text) leaves kept_out; the model learns from all others.
    """
    ws = Workspace(docs.sparkSession, "scoring")
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == kept_out, F.lit(False))
    words, state = fit_words(docs.where(~out).select(text_or_empty().alias("text")), ws)
    lines = ws.save(class_lines(docs, words, state), "lines")
    found = scores(lines, fit_model(lines.where(~out), words, state))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
