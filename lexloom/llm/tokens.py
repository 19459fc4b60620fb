"""Token counts of a unigram tokenizer, without building tokens.

A text is cut before every space, as the tokenizers library's Metaspace does, so each word counts by itself. Within a
word, an Aho-Corasick automaton finds every vocabulary piece in one pass, and dynamic programming keeps, for each end, the
best score and the number of pieces on its path: no back pointers, no pieces. Ties go as in the tokenizer: of equal
scores, the path whose last piece starts first stays. A character that no piece covers costs the unknown penalty and
counts as its UTF-8 bytes (byte fallback).

Words repeat, so each Python worker keeps the counts of words in a bounded table.

Defined cases: null and empty texts have 0 tokens; rows are counted one by one, so repeats and ties need no rule.
"""

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

#: The unknown penalty that the tokenizers library sets below the lowest score. A fixed value.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


def rank_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file's vocabulary, with log-probabilities by Zipf's law over its ranks.

    The public vocabularies at hand carry merge ranks, no unigram probabilities; this turns ranks into some.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    total = math.log(sum(1 / (i + 1) for i in range(size)))
    return [(model.id_to_piece(i), -math.log(i + 1) - total) for i in range(size)]


class Counter:
    """Counts the pieces of words by Viterbi over a unigram vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]], most_kept: int = 500_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.kept: dict[str, int] = {}
        self.most_kept = most_kept

    def pieces(self, word: str) -> int:
        """Pieces of one pre-token (with its leading space mark)."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown, at, found, single = self.unknown, 0, False, False
        for end, (length, score) in self.automaton.iter(word):
            end += 1
            if end != at:
                if at and not single:
                    self._unknown(word, at, best, count, found, unknown)
                for gap in range(at + 1, end):
                    self._unknown(word, gap, best, count, False, unknown)
                at, found, single = end, False, False
            start = end - length
            candidate = best[start] + score  # pieces of one end come longest first
            if not found or candidate > best[end]:
                best[end], count[end], found = candidate, count[start] + 1, True
            single = single or length == 1
        if at and not single:
            self._unknown(word, at, best, count, found, unknown)
        for gap in range(at + 1, n + 1):
            self._unknown(word, gap, best, count, False, unknown)
        return count[n]

    @staticmethod
    def _unknown(word: str, end: int, best: list, count: list, found: bool, unknown: float) -> None:
        candidate = best[end - 1] + unknown
        if not found or candidate > best[end]:
            best[end], count[end] = candidate, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if text[0] in (" ", SPACE):
            del words[0]  # the text brings its own mark
        kept = self.kept
        try:
            return sum(map(kept.__getitem__, words))
        except KeyError:
            pass
        total = 0
        for word in words:
            n = kept.get(word)
            if n is None:
                n = self.pieces(SPACE + word)
                if len(word) <= 64:
                    if len(kept) >= self.most_kept:
                        kept.clear()
                    kept[word] = n
            total += n
        return total


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens for each row of docs, by the unigram vocabulary of the file model_file (see rank_vocabulary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _COUNTERS:
            _COUNTERS[model_file] = Counter(rank_vocabulary(model_file))
        counter = _COUNTERS[model_file]
        for batch in batches:
            counts = pa.array([counter.tokens(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(count, f"doc_id {kind}, n_tokens long")
