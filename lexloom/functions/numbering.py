"""Telephone numbers by numbering plans: a trie of country codes and leading digits, each with the lengths it allows.

The longest prefix that the plans name decides how many digits a number has after its country code. The trie is written
down as one pattern without backtracking, so a number is judged in a single pass within generated code.
"""

import re
from functools import cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country code, leading digits (single digits and classes), lengths behind the code. No two lines share a prefix.
PLANS = """
1 [2-9][0-8] 10
7 [3489] 10
20 [2-9] 8-9
20 1[0125] 10
27 [1-8] 9
30 2 10
30 69 10
30 800 10
31 [1-8] 9
31 800 7-10
31 900 7-10
32 [1-9] 8
32 4[5-9] 9
33 [1-9] 9
34 [5-9] 9
36 [1-9] 8
36 [237]0 9
39 0 6-11
39 3 9-10
39 800 6-9
40 [2378] 9
41 [2-9] 9
43 [1-7] 4-13
43 6[5-9] 7-13
43 800 9-10
44 1 9-10
44 [237] 10
44 8 9-10
45 [2-9] 8
46 [1-9] 7-9
46 7[02369] 9
47 [2-9] 8
48 [1-9] 9
49 [2-9] 6-11
49 15 11
49 1[67] 10-11
49 137 10
49 180 7-11
49 32 11
49 700 11
49 800 10-12
49 900 10
52 [1-9] 10
54 [1-8] 10
54 9 11
55 [1-9][1-9] 10-11
56 [2-9] 9
60 [2-9] 8-9
60 1 9-10
61 [23478] 9
63 [2-9] 8-10
64 [2-9] 8-10
65 [3689] 8
66 [2-57] 8
66 [689] 9
81 [1-9] 9
81 [5789]0 10
82 [1-7] 8-10
86 [2-9] 9-11
86 10 10
86 1[3-9] 11
90 [2-58] 10
91 [1-9] 10
351 [2-9] 9
352 [2-9] 4-11
353 [1-9] 7-9
354 [4-9] 7
358 [1-9] 5-11
359 [2-9] 7-9
370 [3-9] 8
371 [2-9] 8
372 [3-9] 7-8
380 [3-9] 9
385 [1-9] 8-9
386 [1-8] 8
420 [2-9] 9
421 [2-9] 9
852 [2-9] 8
886 [2-9] 8-9
966 [1-9] 8-9
971 [2-9] 8-9
972 [2-9] 8-9
"""
#: Country codes that are assigned; those without a line above allow 6 digits to 15 with the code.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
TRIPLES = "21[1-368] 22[0-9] 23[0-9] 24[0-9] 25[0-8] 26[0-9] 29[01789] 35[0-9] 37[0-8] 38[0-35-79] 42[013] 50[0-9] 59[0-9] 67[02-9] 68[0-35-9] 69[0-2] 85[02356] 88[06] 96[0-8] 97[0-7] 99[2-68]"
#: Fixed value: what a candidate looks like: an international prefix or one leading zero, then digits and separators.
CANDIDATE = r"(?<![\w#])(?<!\d )(?:\+[1-9]|00[1-9]|\(?0)[0-9 ()/.\-]{5,18}[0-9]\b"


def spelled(lead: str) -> list[str]:
    """The digit strings that a pattern of digits and classes stands for."""
    parts = re.findall(r"\[([0-9-]+)\]|([0-9])", lead)
    return ["".join(p) for p in product(*([d for d in "0123456789" if re.match(f"[{inner}]", d)] if inner else [one] for inner, one in parts))]


def _lengths(text: str) -> range:
    low, _, high = text.partition("-")
    return range(int(low), int(high or low) + 1)


def lines() -> list[tuple[str, str, range]]:
    """(country code, leading digits as a pattern, lengths behind the code) of all assigned codes."""
    named = [(code, lead, _lengths(n)) for code, lead, n in (line.split() for line in PLANS.strip().splitlines())]
    known = {code for code, _, _ in named}
    codes = CODES.split() + [c for lead in TRIPLES.split() for c in spelled(lead)]
    return named + [(c, "", range(6, 16 - len(c))) for c in codes if c not in known]


@cache
def trie() -> dict:
    """Nodes by digit; the key "lengths" holds how many digits a whole number has, code included, that goes no deeper."""
    root: dict = {}
    for code, lead, lengths in lines():
        for prefix in spelled(code + lead):
            node = root
            for digit in prefix:
                node = node.setdefault(digit, {})
            node["lengths"] = [len(code) + n for n in lengths]
    return root


def _written(node: dict, depth: int, lengths: list[int]) -> str | None:
    """The node as a pattern of what may follow it; lengths come from the nearest node above that has some."""
    lengths = node.get("lengths", lengths)
    branches: dict[str, str] = {}  # what follows -> digits that lead there
    below = "|".join(rf"\d{{{n - depth - 1}}}" for n in lengths if n > depth)
    for digit in "0123456789":
        follows = _written(node[digit], depth + 1, lengths) if digit in node else f"(?:{below})" if below else None
        if follows is not None:
            branches[follows] = branches.get(follows, "") + digit
    ends = [""] if depth in lengths else []
    ways = [f"[{digits}]{follows}" for follows, digits in branches.items()] + ends
    return f"(?:{'|'.join(ways)})" if ways else None


@cache
def pattern() -> str:
    """The whole trie: matches exactly the digits of numbers whose longest known prefix allows their length."""
    return f"^{_written(trie(), 0, [])}$"


def planned(digits: Column) -> Column:
    """Whether digits, country code first, are a number of its plan."""
    return digits.rlike(pattern())


def international(raw: Column, country: str = "49") -> Column:
    """The digits of a number as written, country code first; one with a single leading 0 is the country's own. A (0) behind a country code is not dialled. Null for others."""
    bare = F.regexp_replace(raw, r"^\(", "")
    digits = F.regexp_replace(F.when(bare.rlike(r"^(?:\+|00)"), F.regexp_replace(bare, r"\(0\)", "")).otherwise(bare), "[^0-9]", "")
    return F.when(bare.startswith("+"), digits).when(bare.startswith("00"), F.substr(digits, F.lit(3))).when(bare.startswith("0"), F.concat(F.lit(country), F.substr(digits, F.lit(2))))


def e164(raw: Column, country: str = "49") -> Column:
    """+ and the digits of a number of its plan; null for others."""
    digits = international(raw, country)
    return F.when(planned(digits), F.concat(F.lit("+"), digits))


def shortened(raw: Column, country: str = "49") -> Column:
    """A candidate up to the last group with which it is a number of its plan, at most up to a dash between spaces; what is left of it where there is none."""
    first = F.regexp_replace(raw, r" +- .*$", "")
    groups = F.sequence(F.lit(1), F.lit(10))  # a candidate has at most ten groups
    return F.aggregate(groups, first, lambda kept, _: F.when(planned(international(kept, country)), kept).otherwise(F.regexp_replace(kept, r"[ ()/.\-]+[0-9]+$", "")))
