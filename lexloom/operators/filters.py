"""Composable document filters: every predicate is optional, every EXISTS is a semi join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tri_state(df: DataFrame, column: str, flag: bool | None) -> DataFrame:
    """True: rows that are true; False: all that are not (null stays); None: all rows."""
    if flag is None:
        return df
    truth = F.col(column).eqNullSafe(True)
    return df.where(truth if flag else ~truth)


def with_tokens(df: DataFrame, entities: DataFrame, tokens: list[str], every: bool, id_column: str = "id") -> DataFrame:
    """Rows whose document has one (every: each) of the tokens, compared by case. No tokens: all rows."""
    wanted = sorted(set(tokens))
    if not wanted:
        return df
    hits = entities.where(F.col("value").isin(wanted)).select(F.col("document_id").alias("_doc"), "value")
    hits = hits.groupBy("_doc").agg(F.countDistinct("value").alias("n")).where(F.col("n") == (len(wanted) if every else F.col("n")))
    return df.join(hits, F.col(id_column) == F.col("_doc"), "left_semi")


def document_filter(docs: DataFrame, *, status: str | None = None, title: str | None = None, unidentifiable: bool | None = None, since=None, until=None, entities: DataFrame | None = None, any_tokens: list[str] = (), all_tokens: list[str] = (), links: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """The conjunction of the predicates given; title is contained literally, whatever the case."""
    out = docs
    if status is not None:
        out = out.where(F.col("status") == status)
    if title is not None:
        out = out.where(F.contains(F.lower("title"), F.lit(title.lower())))
    if since is not None:
        out = out.where(F.col("document_date") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("document_date") <= F.lit(until))
    if unidentifiable is not None:
        out = tri_state(out, "unidentifiable", unidentifiable)
    if entities is not None:
        out = with_tokens(with_tokens(out, entities, list(any_tokens), False), entities, list(all_tokens), True)
    if links is not None and category is not None:
        out = out.join(links.where(F.col("category") == category).select(F.col("document_id").alias("_link")), F.col("id") == F.col("_link"), "left_semi")
    return out
