"""A weighted edit ratio of short strings, and which pieces of a name must survive in whatever is similar to it.

The ratio of a and b is 100 * (1 - d / (len(a) + len(b))), d: inserted and deleted characters. The weighted ratio is the
larger of that and 0.95 times the ratio of both strings with their words sorted.
"""

WORDS_WEIGHT = 0.95


def masks(name: str) -> dict[str, int]:
    """For each character the places that it stands at, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(name):
        found[c] = found.get(c, 0) | 1 << i
    return found


def edits(name: str, places: dict[str, int], other: str) -> int:
    """Characters to insert and delete between name, of which places are the masks, and other: by the longest common subsequence, a row of bits at a time."""
    state = full = (1 << len(name)) - 1
    for c in other:
        met = state & places.get(c, 0)
        state = ((state + met) | (state - met)) & full
    return len(name) + len(other) - 2 * (len(name) - state.bit_count())


def ordered(text: str) -> str:
    return " ".join(sorted(text.split()))


def most_edits(length: int, threshold: float) -> int:
    """How many edits a string may be away from one of this length at a ratio of at least threshold."""
    share = 1 - threshold / 100
    return int(2 * share * length / (1 - share) + 1e-9)


def even_pieces(text: str, n: int) -> list[tuple[int, str]]:
    """text cut into n pieces of about one length, with their places: n - 1 edits leave one whole."""
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def word_pieces(text: str, n: int) -> list[str]:
    """n pieces of words of text, the shortest as long as can be: n - 1 edits leave one whole, however words are ordered."""
    words = text.split()
    cuts = [0] * len(words)
    for _ in range(n if words else 0):
        most = max(range(len(words)), key=lambda i: len(words[i]) / (cuts[i] + 1))
        cuts[most] += 1
    return [piece for word, c in zip(words, cuts, strict=True) if c for _, piece in even_pieces(word, c)]


class Name:
    """A name, lower-cased, ready to be compared."""

    def __init__(self, name: str):
        self.name, self.sorted = name, ordered(name)
        self.places, self.sorted_places = masks(name), masks(self.sorted)

    def ratio(self, other: str) -> float:
        """The weighted ratio to other, which is lower-cased."""
        whole = 100 * (1 - edits(self.name, self.places, other) / max(len(self.name) + len(other), 1))
        words = ordered(other)
        if words == other and self.sorted == self.name:
            return whole
        return max(whole, WORDS_WEIGHT * 100 * (1 - edits(self.sorted, self.sorted_places, words) / max(len(self.sorted) + len(words), 1)))
