"""Names found in whole texts: a trie of their words, aliases by an automaton, windows that are similar to one.

A dictionary is sent to the tasks only after its size is checked. Beyond that size the word trie becomes a table of edges
that is joined one word further at a time, and aliases are sent in blocks, one pass over the texts for each block.
Offsets are in characters, ends exclusive. Null texts hold nothing. Rows of equal keys are one text to the joined trie, so
keys must name a text.
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..workspace import Workspace

WORD = re.compile(r"[^\W_]+")
#: Fixed value: what counts as a token of an alias window.
TOKEN = re.compile(r"[\w][\w&.'/-]*")
#: Scores of exact hits, and the least ratio of fuzzy ones.
EXACT_SCORE, LEAST_RATIO = 0.985, 92.0
ROWS = 8192
CLASSES = 16  # characters are counted by this remainder of their code point, white space by itself
SPACE = CLASSES
SECTION, HITS = 1 << 18, 1 << 17  # characters and hits that are looked at together


def lowered(text: str) -> str:
    """text in lower case, each character by one, so offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, word in lower case) of the runs of letters and digits."""
    low = lowered(text)
    return [(m.start(), m.end(), m.group()) for m in WORD.finditer(low)]


def normal(text: str) -> str:
    """A surface as its words with one space between."""
    return " ".join(w for _, _, w in words_of(text))


def keyed_rows(texts: DataFrame, keys: list[str], find, fields: str, text_column: str = "text", together: int = 0) -> DataFrame:
    """For each row of texts its keys and what find(text) yields: tuples of `fields`, such as "start int, value string".

    together: find gets lists of texts of about so many characters and yields each text's place in the list before the fields.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    named = [f.split() for f in fields.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], [[] for _ in named]

            def full() -> pa.RecordBatch:
                at = pa.array(rows, pa.int32())
                made = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)]
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *made], names=[*keys, *(n for n, _ in named)])

            for i, found in _found(batch.column("_text"), find, together):
                rows.append(i)
                for c, v in zip(columns, found, strict=True):
                    c.append(v)
                if len(rows) >= ROWS:
                    yield full()
                    rows, columns = [], [[] for _ in named]
            if rows:
                yield full()

    schema = ", ".join([*(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys), fields])
    return texts.select(*keys, F.col(text_column).alias("_text")).mapInArrow(task, schema)


def _found(column: pa.Array, find, together: int) -> Iterator[tuple[int, tuple]]:
    held, places, chars = [], [], 0
    for i in range(len(column)):
        text = column[i].as_py()
        if not text:
            continue
        if not together:
            yield from ((i, found) for found in find(text))
            continue
        held.append(text)
        places.append(i)
        chars += len(text)
        if chars >= together:
            yield from ((places[place], found) for place, *found in find(held))
            held, places, chars = [], [], 0
    if held:
        yield from ((places[place], found) for place, *found in find(held))


def matches(texts: DataFrame, keys: list[str], pattern: str, text_column: str = "text") -> DataFrame:
    """keys, start, stop, value of all matches of a regular expression in whole texts."""
    compiled = re.compile(pattern)
    return keyed_rows(texts, keys, lambda text: ((m.start(), m.end(), m.group()) for m in compiled.finditer(text)), "start int, stop int, value string", text_column)


def contained(texts: DataFrame, keys: list[str], needles: DataFrame, text_column: str = "text", most_chars: int = 4 << 20) -> DataFrame:
    """keys, needle: which needles (needle) stand anywhere in a row's text, as written; once a row and needle.

    One automaton finds all needles in one walk over a text. Needles of more than most_chars characters in all are sent
    in blocks of about so many, each in a pass of its own over the texts. Null and empty needles and texts are in no row.
    """
    spark = texts.sparkSession
    known = Workspace(spark, "needles").save(needles.where("needle <> ''").select("needle").distinct(), "needles")
    blocks = max(1, -(-known.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()[0] // most_chars))
    block = F.pmod(F.xxhash64("needle"), F.lit(blocks))
    found = None
    for b in range(blocks):
        sent = spark.sparkContext.broadcast([r["needle"] for r in known.where(block == b).collect()])
        hits = keyed_rows(texts, keys, _substrings(sent), "needle string", text_column)
        found = hits if found is None else found.unionByName(hits)
    return found


def _substrings(sent):
    made: list[ahocorasick.Automaton] = []  # once a task

    def find(text: str):
        if not made:
            made.append(ahocorasick.Automaton())
            for needle in sent.value:
                made[0].add_word(needle, needle)
            made[0].make_automaton()
        return [(n,) for n in {n for _, n in made[0].iter(text)}] if len(made[0]) else []

    return find


# surfaces by their words


def word_trie(surfaces: list[tuple[str, object]]) -> dict:
    """Nested dictionaries by word; None holds (surface, node). Surfaces are normal; of one surface's nodes the smallest stays."""
    trie: dict = {}
    for surface, node in surfaces:
        at = trie
        for word in surface.split(" "):
            at = at.setdefault(word, {})
        at[None] = (surface, node if None not in at else min(node, at[None][1]))
    return trie


def trie_spans(words: list[tuple[int, int, str]], trie: dict) -> list[tuple[int, int, tuple]]:
    """(first word, word behind the last, (surface, node)) of all surfaces in a list of words."""
    found = []
    for i in range(len(words)):
        at, j = trie.get(words[i][2]), i + 1
        while at is not None:
            if None in at:
                found.append((i, j, at[None]))
            at = at.get(words[j][2]) if j < len(words) else None
            j += 1
    return found


def longest_first(spans: list[tuple[int, int, tuple]], width: int) -> list[tuple[int, int, tuple]]:
    """Spans without those that overlap one taken before: longest surface first, then the earliest."""
    taken, kept = bytearray(width), []
    for i, j, hit in sorted(spans, key=lambda s: (-len(s[2][0]), s[0])):
        if not any(taken[i:j]):
            taken[i:j] = b"\1" * (j - i)
            kept.append((i, j, hit))
    return sorted(kept, key=lambda s: s[:2])


def linked_spans(texts: DataFrame, keys: list[str], surfaces: DataFrame, min_chars: int = 3, overlapping: bool = False, most_sent: int = 200_000, most_chars: int = 8 << 20, text_column: str = "text") -> DataFrame:
    """keys, start, stop, surface, node: the surfaces (surface, node) that texts hold as whole words, of any number of words.

    Longest surfaces win, then earlier ones, and spans do not overlap; overlapping: all are returned. Surfaces and texts
    are compared by their words in lower case; a surface needs min_chars characters; of nodes with one surface the
    smallest counts. Up to most_sent surfaces of most_chars characters go to the tasks as a trie; more are a table of the
    trie's edges, joined with the texts' words, and only words that continue a surface go on to the next join.
    """
    spark = texts.sparkSession
    ws = Workspace(spark, "phrases")
    named = keyed_rows(surfaces.where("surface IS NOT NULL AND node IS NOT NULL"), ["node"], lambda s: [(normal(s),)], "surface string", "surface")
    named = ws.save(named.where(F.length("surface") >= min_chars).groupBy("surface").agg(F.min("node").alias("node")), "surfaces")
    kind = named.schema["node"].dataType.simpleString()
    n, chars = named.agg(F.count("*"), F.coalesce(F.sum(F.length("surface")), F.lit(0))).first()
    if n <= most_sent and chars <= most_chars:
        sent = spark.sparkContext.broadcast(word_trie([tuple(r) for r in named.select("surface", "node").collect()]))

        def find(text: str):
            words = words_of(text)
            spans = trie_spans(words, sent.value)
            for i, j, (surface, node) in spans if overlapping else longest_first(spans, len(words)):
                yield words[i][0], words[j - 1][1], surface, node

        return keyed_rows(texts, keys, find, f"start int, stop int, surface string, node {'long' if kind in ('bigint', 'int') else kind}", text_column)
    return _joined_spans(ws, texts, keys, named, overlapping, text_column)


def _joined_spans(ws: Workspace, texts: DataFrame, keys: list[str], named: DataFrame, overlapping: bool, text_column: str) -> DataFrame:
    place = "i int, start int, stop int, word string"
    words = ws.save(keyed_rows(texts, keys, lambda t: ((i, *w) for i, w in enumerate(words_of(t))), place, text_column), "words")
    parts = F.split("surface", " ")
    steps = named.select(F.posexplode(parts).alias("depth", "word"), parts.alias("parts"))
    path = F.array_join(F.slice("parts", 1, F.col("depth") + 1), " ")
    edges = ws.save(steps.select("depth", F.array_join(F.slice("parts", 1, F.col("depth")), " ").alias("path"), "word", path.alias("onward")).distinct(), "edges")
    ends = named.withColumnRenamed("surface", "path")
    deepest = edges.agg(F.max("depth")).first()[0]
    ahead = words.select(*keys, F.col("i").alias("next"), "word", F.col("stop").alias("to"))
    found, front = None, None
    for depth in range((deepest if deepest is not None else -1) + 1):
        level = edges.where(F.col("depth") == depth).drop("depth")
        if depth == 0:
            front = words.join(level.drop("path"), "word").select(*keys, "i", "start", "stop", F.col("onward").alias("path"), (F.col("i") + 1).alias("next"))
        else:
            front = front.join(ahead, [*keys, "next"]).join(level, ["path", "word"])
            front = front.select(*keys, "i", "start", F.col("to").alias("stop"), F.col("onward").alias("path"), (F.col("next") + 1).alias("next"))
        front = ws.save(front, f"front-{depth}")
        hits = front.join(ends, "path")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return texts.select(*keys).join(named, F.lit(False)).select(*keys, F.lit(0).alias("start"), F.lit(0).alias("stop"), "surface", "node").limit(0)
    found = found.select(*keys, "i", F.col("next").alias("j"), "start", "stop", F.col("path").alias("surface"), "node")
    if overlapping:
        return found.drop("i", "j")
    names = [*keys, "start", "stop", "surface", "node"]

    def resolve(rows: pa.Table) -> pa.Table:
        i, j, surface = (rows.column(c).to_pylist() for c in ("i", "j", "surface"))
        kept = longest_first([(a, b, (s, r)) for r, (a, b, s) in enumerate(zip(i, j, surface, strict=True))], max(j))
        return rows.take(pa.array([hit[1] for _, _, hit in kept])).select(names)

    return found.groupBy(*keys).applyInArrow(resolve, found.select(*names).schema)  # a group is the hits in one text


# aliases, exact and similar


class Aliases:
    """Aliases (label, canonical, alias) and automata over them and over the pieces that a similar window keeps."""

    def __init__(self, rows: list[tuple[str, str, str]], fuzzy_hits: bool, threshold: float = LEAST_RATIO):
        self.rows = [(label, canonical, alias, lowered(alias)) for label, canonical, alias in sorted(set(rows)) if alias and alias.strip()]
        self.threshold = threshold
        by_name: dict[str, list[int]] = {}
        for r, row in enumerate(self.rows):
            by_name.setdefault(row[3], []).append(r)
        self.exact = self._automaton({name: (name, rows) for name, rows in by_name.items()})
        self.names: list[tuple[fuzzy.Name, list[int], int, int, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}  # piece: (number of the name, its place there; -1 where words may be in any order)
        for name, rows in by_name.items() if fuzzy_hits else ():
            tokens = len(TOKEN.findall(name))
            if not tokens:
                continue
            k, reach, loose = len(self.names), fuzzy.most_edits(len(name), threshold), fuzzy.most_edits(len(fuzzy.ordered(name)), threshold / fuzzy.WORDS_WEIGHT)
            self.names.append((fuzzy.Name(name), rows, tokens, reach, loose))
            if reach:
                for at, piece in fuzzy.even_pieces(name, reach + 1):
                    pieces.setdefault(piece, []).append((k, at))
            for piece in fuzzy.word_pieces(fuzzy.ordered(name), loose + 1) if loose or " " in fuzzy.ordered(name) else ():
                pieces.setdefault(piece, []).append((k, -1))
        self.pieces = self._automaton({p: i for i, p in enumerate(pieces)})
        self.piece_sizes = np.array([len(p) for p in pieces], np.int64)
        self.uses = np.array([len(u) for u in pieces.values()], np.int64)
        self.first_use = np.cumsum(self.uses) - self.uses
        self.used = np.array([u for all_uses in pieces.values() for u in all_uses], np.int64).reshape(-1, 2)
        self.lengths = np.array([len(n[0].name) for n in self.names], np.int64)
        self.tokens, self.reaches, self.looses = np.array([n[2:] for n in self.names], np.int64).reshape(-1, 3).T
        self.bags = np.array([np.bincount(classes(n[0].name), minlength=SPACE + 1) for n in self.names], np.int32).reshape(-1, SPACE + 1)
        self.solid = self.bags[:, :SPACE].sum(1)

    @staticmethod
    def _automaton(entries: dict):
        made = ahocorasick.Automaton()
        for word, value in entries.items():
            made.add_word(word, value)
        if entries:
            made.make_automaton()
        return made

    def exact_hits(self, low: str) -> Iterator[tuple]:
        """(start, stop, label, canonical, alias, score, source) of aliases that stand in the text as whole words; an alias does not overlap itself."""
        if not len(self.exact):
            return
        last: dict[str, int] = {}
        for end, (name, rows) in self.exact.iter(low):
            start, stop = end + 1 - len(name), end + 1
            if start < last.get(name, 0):
                continue
            if _word(name[0]) and _word(name[-1]) and (start and _word(low[start - 1]) or stop < len(low) and _word(low[stop])):
                continue
            last[name] = stop
            for r in rows:
                label, canonical, alias, _ = self.rows[r]
                yield start, stop, label, canonical, alias, EXACT_SCORE, "exact"

    def seeds(self, low: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(start of a piece, its end, number of a name, the piece's place there) of all pieces that stand in a text."""
        found = list(self.pieces.iter(low)) if len(self.pieces) else []
        for at in range(0, len(found), HITS):
            hits = np.array(found[at : at + HITS], np.int64)
            uses = self.uses[hits[:, 1]]
            piece, behind = np.repeat(hits[:, 1], uses), np.repeat(hits[:, 0], uses) + 1
            turn = np.arange(len(piece)) - np.repeat(np.cumsum(uses) - uses, uses)
            k, place = self.used[self.first_use[piece] + turn].T
            yield behind - self.piece_sizes[piece], behind, k, place

    def windows(self, low: str) -> Iterator[tuple[int, int, int]]:
        """(start, stop, number of a name) of each window that keeps a piece of the name where a similar one must.

        A piece with a place: both ends of a window with d edits lie as far from where the piece puts them as their sides
        have edits, so the stretch where the name would lie without edits has no more than 2 d characters other than the
        name's, and the window no more than d. A piece of a word: any window of the name's tokens around it, one more or
        fewer, with no more than d characters other than the name's, but for white space.
        """
        counts, starts, stops, kept = Counts(low), None, None, []
        for p, behind, k, at in self.seeds(low):
            tight = np.flatnonzero(at >= 0)
            first = p[tight] - at[tight]
            tight = tight[counts.differ(first, first + self.lengths[k[tight]], self.bags[k[tight]]) <= 2 * self.reaches[k[tight]]]
            loose = np.flatnonzero(at < 0)
            if not len(tight) and not len(loose):
                continue
            if starts is None:
                spans = np.array([m.span() for m in TOKEN.finditer(low)], np.int64).reshape(-1, 2)
                starts, stops = np.ascontiguousarray(spans[:, 0]), np.ascontiguousarray(spans[:, 1])
            kept.append(self._around(counts, starts, stops, p[loose], behind[loose], k[loose]))
            kept.append(self._placed(counts, starts, stops, p[tight], behind[tight], k[tight], at[tight]))
        if kept:
            for i, j, k in np.unique(np.concatenate(kept), axis=0).tolist():
                yield int(starts[i]), int(stops[j]), k

    def _around(self, counts: "Counts", starts: np.ndarray, stops: np.ndarray, p: np.ndarray, behind: np.ndarray, k: np.ndarray) -> np.ndarray:
        last, first, tokens = np.searchsorted(starts, p, "right") - 1, np.searchsorted(stops, behind, "left"), self.tokens[k]
        found = [np.empty((0, 3), np.int64)]
        for back in range(int(tokens.max(initial=-1)) + 1):
            i = first - back  # a window of up to tokens + 1 begins here
            for more in (-1, 0, 1):
                j = i + np.maximum(tokens + more, 1) - 1
                good = np.flatnonzero((i >= 0) & (i <= last) & (j >= first) & (j < len(stops)) & (back <= tokens))
                good = good[np.abs(counts.solid(starts[i[good]], stops[j[good]]) - self.solid[k[good]]) <= self.looses[k[good]]]
                found.append(np.stack([i[good], j[good], k[good]], axis=1))
        found = np.unique(np.concatenate(found), axis=0)
        i, j, k = found.T
        return found[counts.differ(starts[i], stops[j], self.bags[k], SPACE) <= self.looses[k]]

    def _placed(self, counts: "Counts", starts: np.ndarray, stops: np.ndarray, p: np.ndarray, behind: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        reach, length, tokens = self.reaches[k], self.lengths[k], self.tokens[k]
        i0, i1 = np.searchsorted(starts, p - at - reach), np.searchsorted(starts, np.minimum(p - at + reach, p), "right")
        j0, j1 = np.searchsorted(stops, np.maximum(p - at + length - reach, behind)), np.searchsorted(stops, p - at + length + reach, "right")
        found = [np.empty((0, 3), np.int64)]
        for x in range(int((i1 - i0).max(initial=0))):
            for y in range(int((j1 - j0).max(initial=0))):
                i, j = i0 + x, j0 + y
                size = j - i + 1
                good = (i < i1) & (j < j1) & (size >= np.maximum(tokens - 1, 1)) & (size <= tokens + 1)
                found.append(np.stack([i, j, k], axis=1)[good])
        found = np.unique(np.concatenate(found), axis=0)
        i, j, k = found.T
        return found[counts.differ(starts[i], stops[j], self.bags[k]) <= self.reaches[k]]

    def fuzzy_hits(self, low: str) -> Iterator[tuple]:
        for start, stop, k in self.windows(low):
            name, rows, *_ = self.names[k]
            window = low[start:stop]
            if window == name.name:
                continue  # the exact hit
            score = name.ratio(window)
            if score >= self.threshold:
                for r in rows:
                    label, canonical, alias, _ = self.rows[r]
                    yield start, stop, label, canonical, alias, score / 100, "fuzzy"

    def hits(self, texts: list[str]) -> Iterator[tuple]:
        """(place of a text, start, stop, ...) of all hits, one for each span, label and canonical name: the best score stays.

        Texts are looked at as one, a zero between; what reaches from one into the next is no hit.
        """
        low, best = "\0".join(map(lowered, texts)), {}
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for hit in (*self.exact_hits(low), *self.fuzzy_hits(low)):
            key = hit[:4]
            if key not in best or (-hit[5], hit[4]) < (-best[key][5], best[key][4]):
                best[key] = hit
        for start, stop, *hit in sorted(best.values()):
            row = int(np.searchsorted(begin, start, "right")) - 1
            if stop < begin[row + 1]:
                yield row, start - int(begin[row]), stop - int(begin[row]), *hit


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = points % CLASSES
    found[(points >= 9) & (points <= 13) | (points >= 28) & (points <= 32)] = SPACE
    for i in np.flatnonzero((points == 0x85) | (points == 0xA0) | (points >= 0x1680) & (points <= 0x3000)):
        if text[i].isspace():
            found[i] = SPACE
    return found


class Counts:
    """How many characters of each class stretches of a text have, a section of the text at a time."""

    def __init__(self, text: str):
        self.classes = classes(text)
        self.before = np.concatenate([[0], np.cumsum(self.classes != SPACE)])
        self.low, self.high, self.sums = 0, -1, None

    def solid(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Characters of stretches without white space."""
        return self.before[stop] - self.before[start]

    def differ(self, start: np.ndarray, stop: np.ndarray, bags: np.ndarray, upto: int = SPACE + 1) -> np.ndarray:
        """By how many characters of the first `upto` classes the stretches differ from bags; they are cut where the text ends."""
        start, stop = np.clip(start, 0, len(self.classes)), np.clip(stop, 0, len(self.classes))
        out = np.empty(len(start), np.int64)
        order = np.argsort(start, kind="stable")
        whole = len(self.classes) <= SECTION
        at = 0
        while at < len(order):
            low = int(start[order[at]])
            rows = order[at:] if whole else order[at : int(np.searchsorted(start[order], low + SECTION, "right"))]
            rows = rows[: SECTION // 4]
            self._section(0 if whole else low, len(self.classes) if whole else int(stop[rows].max()))
            out[rows] = np.abs(self.sums[stop[rows] - self.low, :upto] - self.sums[start[rows] - self.low, :upto] - bags[rows, :upto]).sum(1)
            at += len(rows)
        return out

    def _section(self, low: int, high: int) -> None:
        if self.sums is not None and self.low <= low and high <= self.high:
            return
        self.low, self.high = low, high
        part = self.classes[low:high]
        each = np.zeros((len(part) + 1, SPACE + 1), np.int32)
        each[np.arange(1, len(part) + 1), part] = 1
        self.sums = np.cumsum(each, axis=0, out=each)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def alias_hits(texts: DataFrame, keys: list[str], aliases: DataFrame, fuzzy_hits: bool = True, threshold: float = LEAST_RATIO, most_sent: int = 20_000, text_column: str = "text") -> DataFrame:
    """keys, start, stop, label, canonical, alias, score, source: aliases (label, canonical, alias) in whole texts.

    Exact hits are whole words in any case, with a fixed score; fuzzy ones are windows of as many tokens as the alias, one
    fewer or one more, whose weighted ratio to it is at least `threshold`, scored by it. Every such window is found: an
    alias is cut into one piece more than the edits that the threshold allows, so one of them stands in the window, and
    one automaton finds all pieces. More than most_sent aliases are sent in blocks, each in a pass of its own.
    """
    spark = texts.sparkSession
    ws = Workspace(spark, "aliases")
    known = ws.save(aliases.where("alias IS NOT NULL").select(*(F.col(c).cast("string") for c in ("label", "canonical", "alias"))).distinct(), "aliases")
    blocks = max(1, -(-known.count() // most_sent))
    block = F.pmod(F.xxhash64("label", "canonical"), F.lit(blocks))
    found = None
    for b in range(blocks):
        rows = spark.sparkContext.broadcast([tuple(r) for r in known.where(block == b).collect()])
        hits = keyed_rows(texts, keys, _finder(rows, fuzzy_hits, threshold), "start int, stop int, label string, canonical string, alias string, score double, source string", text_column, SECTION // 2)
        found = hits if found is None else found.unionByName(hits)
    return found


def _finder(rows, fuzzy_hits: bool, threshold: float):
    ready: list[Aliases] = []  # made once a task

    def find(texts: list[str]):
        if not ready:
            ready.append(Aliases(rows.value, fuzzy_hits, threshold))
        return ready[0].hits(texts)

    return find
