"""Spans of a text as expressions: where a pattern matches, what stands before, which spans keep clear of others.

A span is a struct of start, end (character offsets, end exclusive) and value. All of it stays within a row.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"
SPAN = "struct<start:int,end:int,value:string>"
KIND = "struct<kind:string,start:int,end:int,value:string>"


def spans(text: Column, pattern: str) -> Column:
    """Array of the spans that the pattern (without capturing groups) matches, in order."""
    pieces = F.split(F.regexp_replace(F.translate(text, _MARK, " "), f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    # matches are every other piece; where one begins is the length of all before it
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(so_far: Column, piece: Column) -> Column:
        end = so_far["at"] + F.length(piece)
        span = F.struct(so_far["at"].alias("start"), end.alias("end"), piece.alias("value"))
        return F.struct(end.alias("at"), (~so_far["inside"]).alias("inside"), F.when(so_far["inside"], F.array_append(so_far["found"], span)).otherwise(so_far["found"]).alias("found"))

    return F.aggregate(pieces, start, step, lambda x: x["found"])


def preceded(text: Column, start: Column, cue: str, window: int) -> Column:
    """Whether the cue matches in the `window` characters before a place."""
    return F.substr(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window))).rlike(cue)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def unclaimed(found: Column, kind: str = KIND) -> Column:
    """Of an array of spans, those that overlap none kept before them."""
    return F.aggregate(found, F.array().cast(f"array<{kind}>"), lambda kept, s: F.when(F.exists(kept, lambda t: overlap(s, t)), kept).otherwise(F.array_append(kept, s)))


def sentence(text: Column, start: Column, end: Column) -> Column:
    """The sentence around a span: from behind the last of . ! ? and line breaks before it to the first behind it, that mark included."""
    before = F.regexp_replace(F.substr(text, F.lit(1), start), r"(?s)^.*[.!?\n]", "")
    behind = F.regexp_extract(F.substr(text, end + 1), r"(?s)^[^.!?\n]*[.!?]?", 0)
    return F.trim(F.concat(before, F.substr(text, start + 1, end - start), behind))
