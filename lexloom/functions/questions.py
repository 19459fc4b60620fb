"""What a question asks for: counts, totals, relations; and what an answer cites."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counting verbs, document nouns, words that name nothing, words of totals, nouns for any document.
COUNT_VERB = r"(?i)\b(how many|number of|count of|count the|how much|list all|list every|enumerate)\b"
DOCUMENT_NOUN = r"(?i)\b(documents?|files?|invoices?|bills?|letters?|statements?|contracts?|receipts?|reports?|emails?|scans?|pdfs?|pages?)\b"
FILLER = r"(?i)\b(in|the|system|are|there|is|was|were|do|does|did|i|ive|i've|have|has|of|from|for|by|with|my|our|all|any|please|me|we|us|on|at|to|stored|saved|kept|currently|total|so|far|about)\b"
TOTAL = r"(?i)\b(how much|how many|total|totals|sum|spent|spend|spending|paid|count)\b"
ANY_DOCUMENT = ["document", "file", "pdf", "scan", "page"]


def asks_count(question: Column) -> Column:
    return question.rlike(COUNT_VERB) & question.rlike(DOCUMENT_NOUN)


def asks_total(question: Column) -> Column:
    return question.rlike(TOTAL)


def count_intent(question: Column) -> Column:
    """struct(entity, doc_type) of a question that counts documents; null for others. entity is null for the whole corpus."""
    noun = F.lower(F.regexp_extract(question, DOCUMENT_NOUN, 1))
    kind = F.when((F.length(noun) > 3) & noun.endswith("s"), F.substr(noun, F.lit(1), F.length(noun) - 1)).otherwise(noun)
    rest = question
    for words in (COUNT_VERB, DOCUMENT_NOUN, FILLER):
        rest = F.regexp_replace(rest, words, " ")
    rest = F.trim(F.regexp_replace(F.regexp_replace(rest, r"[^\p{L}\p{N}_\s.\-@&]", " "), r"\s+", " "))
    return F.when(asks_count(question), F.struct(F.nullif(rest, F.lit("")).alias("entity"), kind.alias("doc_type")))


def count_answer(entity: Column, doc_type: Column, titled: Column, mentioned: Column, total: Column) -> Column:
    """The sentence that states counts under each lens; null where nothing was found."""
    note = F.when(doc_type.isin(ANY_DOCUMENT), F.lit("")).otherwise(F.concat(F.lit(" Filtering to only "), doc_type, F.lit("s is not available yet, so this counts all matching documents.")))
    named = F.concat(F.lit("For “"), entity, F.lit("” I found "), titled.cast("string"), F.lit(" with it in the title or name; "), mentioned.cast("string"), F.lit(" that mention it."), note)
    return F.when(entity.isNotNull() & (titled + mentioned > 0), named).when(entity.isNull() & (total > 0), F.concat(F.lit("There are "), total.cast("string"), F.lit(" in the system."), note))


def money(minor: Column) -> Column:
    return F.format_string("%.2f", minor / 100)


def cited(answer: Column, hits: Column) -> Column:
    """The sorted numbers [n] of an answer that are from 1 to hits; all of them where it names none."""
    named = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
    good = F.array_sort(F.array_distinct(F.filter(named, lambda n: (n >= 1) & (n <= hits))))
    return F.when(F.size(good) > 0, good).when(hits > 0, F.sequence(F.lit(1), hits)).otherwise(F.array().cast("array<int>"))


def neutralised(text: Column) -> Column:
    """Text of a source, in which nothing looks like a citation."""
    return F.regexp_replace(text, r"\[(\d+)\]", r"($1)")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole words of a text in a row; both in lower case with single spaces."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text, or null; braces in strings count too."""
    start = F.instr(text, "{")
    chars = F.split(F.substr(text, start), "")
    # depth after each character; the object ends where it is 0 again
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), F.when((s["end"] == 0) & (depth == 0), s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(chars, zero, step, lambda s: s["end"])
    return F.when((start > 0) & (end > 0), F.substr(text, start, end))
