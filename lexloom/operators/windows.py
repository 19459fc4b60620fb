"""Texts in overlapping windows, and the records of windows put together again."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOUNDS = "array<struct<start:int,end:int>>"


def _windows(docs: DataFrame, cut) -> DataFrame:
    bounds = F.pandas_udf(lambda texts: texts.map(lambda t: [{"start": int(a), "end": int(b)} for a, b in cut(t or "")]), BOUNDS)
    rows = docs.select("id", "text", F.posexplode(bounds("text")).alias("ordinal", "b"))
    return rows.select("id", "ordinal", F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.substr("text", F.col("b.start") + 1, F.col("b.end") - F.col("b.start")).alias("text"))


def line_windows(docs: DataFrame, size: int = 16_000, overlap: int = 12) -> DataFrame:
    """id, ordinal, start, end, text: whole lines up to `size` characters, the last `overlap` lines again in the next window.

    A longer line is a window of its own; every window goes on by a line at least. Empty and null texts have none.
    """

    def cut(text: str):
        ends = np.cumsum([len(line) for line in text.split("\n")]) + np.arange(1, text.count("\n") + 2)
        ends[-1] -= 1
        ends = ends[np.diff(ends, prepend=0) > 0]
        begins, first = np.append(0, ends), 0
        while first < len(ends):
            last = max(int(np.searchsorted(ends, begins[first] + size, "right")), first + 1)
            yield begins[first], ends[last - 1]
            if last == len(ends):
                return
            first = max(last - overlap, first + 1)

    return _windows(docs, cut)


def break_windows(docs: DataFrame, size: int = 1500) -> DataFrame:
    """id, ordinal, start, end, text: windows of up to `size` characters that end before the last space or line break of their second half, if it has one."""

    def cut(text: str):
        at = 0
        while at < len(text) or not at:
            end = at + size
            if end < len(text):
                half = text[at + size // 2 : end]
                place = max(half.rfind(" "), half.rfind("\n"))
                end = at + size // 2 + place if place >= 0 else end
            yield at, min(end, len(text))
            at = end

    return _windows(docs, cut)


def stitched(records: DataFrame, keys: list[str]) -> DataFrame:
    """records (document_id, window, position, ...) without what a window repeats of the one before: its longest head that is the other's tail, by keys.

    Arrays hold a window's records, which its size bounds.
    """
    others = [c for c in records.columns if c not in ("document_id", "window", "position")]
    held = records.select("document_id", "window", F.struct("position", F.struct(*keys).alias("key"), F.struct(*others).alias("row")).alias("r"))
    held = held.groupBy("document_id", "window").agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0)).alias("rows"))
    held = held.withColumn("keys", F.transform("rows", lambda r: r["key"]))
    before = F.lag("keys").over(W.partitionBy("document_id").orderBy("window"))
    held = held.withColumn("last", before)
    most = F.least(F.size("last"), F.size("keys"))
    fits = F.filter(F.sequence(F.lit(0), most), lambda k: F.when(k == 0, True).otherwise(F.slice("last", F.size("last") - k + 1, k) == F.slice("keys", F.lit(1), k)))
    dropped = F.when(F.col("last").isNull(), 0).otherwise(F.array_max(fits))
    rows = held.select("document_id", "window", dropped.alias("dropped"), F.posexplode("rows").alias("at", "r"))
    return rows.where("at >= dropped").select("document_id", "window", "r.position", "r.row.*")


def normalised_records(raw: DataFrame) -> DataFrame:
    """raw rows (document_id, window, position, date, amount, currency, direction, merchant, description) as typed records.

    An amount without a currency code is no amount; rows with neither amount nor merchant nor description are left out.
    """
    from ..functions.money import amount_minor, currency_code, iso_date
    from ..functions.names import merchant_key

    code = currency_code(F.col("currency"))
    minor = F.when(code.isNotNull(), amount_minor(F.col("amount")))
    named = F.coalesce(F.nullif(F.trim("merchant"), F.lit("")), F.nullif(F.trim("description"), F.lit("")))
    way = F.lower(F.trim("direction"))
    rows = raw.select("document_id", "window", "position", iso_date(F.col("date")).alias("occurred_on"), minor.alias("amount_minor"), F.when(minor.isNotNull(), code).alias("currency"), F.when(way.isin("debit", "credit"), way).alias("direction"), merchant_key(named).alias("merchant"), F.nullif(F.trim("description"), F.lit("")).alias("description"))
    return rows.where("amount_minor IS NOT NULL OR merchant IS NOT NULL")
