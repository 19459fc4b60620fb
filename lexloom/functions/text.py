"""Text quality, tokens, chunks and windows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def text_quality(text: Column) -> Column:
    """0.6 times the share of word-like tokens plus 0.4 times the density of letters, to four places; 0 for blank text."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    words = F.size(F.filter(tokens, lambda w: w.rlike(r"^[\p{L}]{2,}[.,;:!?]?$")))
    solid = F.regexp_replace(text, r"\s+", "")
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]", ""))
    return F.when(F.size(tokens) > 0, F.round(0.6 * words / F.size(tokens) + 0.4 * letters / F.greatest(F.length(solid), F.lit(1)), 4)).otherwise(0.0)


def unidentifiable(text: Column, least: int = 40, threshold: float = 0.35) -> Column:
    """Null for texts too short to tell, else whether the quality is below the threshold."""
    return F.when(F.length(F.trim(text)) >= least, text_quality(text) < threshold)


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """id, ordinal, start, text, tokens: windows of `size` characters that step by size - overlap; blank ones are left out."""
    step = size - overlap
    clean = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\u0000"), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length("t") - overlap - 1, F.lit(0)), F.lit(step))
    rows = docs.select("id", clean.alias("t")).select("id", "t", F.posexplode(starts).alias("ordinal", "start"))
    rows = rows.select("id", "ordinal", "start", F.substr("t", F.col("start") + 1, F.lit(size)).alias("text"))
    return rows.where(F.trim("text") != "").withColumn("tokens", token_estimate(F.col("text")))


#: Frequent short words of four languages.
STOPWORDS = {
    "en": "the of and to in is that for it with as was on be by this are from or an".split(),
    "fr": "le la les de des et un une du en est que dans pour sur au qui par ne pas".split(),
    "de": "der die das und ist nicht den von mit ein eine zu im dem auf für des sich als auch".split(),
    "es": "el los las y una del que en es por con para se su al lo como más pero o".split(),
}
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ"


def language(text: Column) -> Column:
    """The language whose frequent words stand most often in a text, the first of equals; unknown without any, and below 20 characters."""
    low = F.lower(text)
    hits = {name: F.regexp_count(low, F.lit(f"(?<![a-zà-öø-ÿß])(?:{'|'.join(known)})(?![a-zà-öø-ÿß])")) for name, known in STOPWORDS.items()}

    def most_hit(n: Column) -> Column:
        most = F.greatest(*(n[name] for name in STOPWORDS))
        out = F.when(most == 0, "unknown")
        for name in STOPWORDS:
            out = out.when(n[name] == most, name)
        return out

    counted = F.array(F.struct(*(n.alias(name) for name, n in hits.items())))  # in an array of one, so each is counted once
    return F.when(F.length(F.trim(text)) < 20, "unknown").otherwise(F.get(F.transform(counted, most_hit), F.lit(0)))


def plausible(term: Column, script: str = "latin") -> Column:
    """Three letters or more, no character four times in a row, letters of the script (or of none of the known ones), and in Latin enough vowels."""
    letters = F.length(F.regexp_replace(term, r"[^\p{L}]", ""))
    vowels = F.length(F.regexp_replace(F.lower(term), f"[^{VOWELS}]", ""))
    scripts = {"cjk": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", "cyrillic": r"\p{IsCyrillic}", "latin": r"\p{IsLatin}"}
    foreign = F.lit(False)
    for name, pattern in scripts.items():
        if name != script:
            foreign = foreign | term.rlike(pattern)
    good = (letters >= 3) & ~term.rlike(r"(.)\1{3}") & ~foreign
    return good & (vowels > 0) & (vowels >= 0.15 * letters) if script == "latin" else good
