"""Keyset pages: total orders with nulls last, resumed behind the last row of a page."""

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INT64 = 2**63


def encode_cursor(sort: str, descending: bool, value, id_: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([1, sort, descending, value, id_]).encode()).decode()


def decode_cursor(cursor: str, sort: str, descending: bool) -> tuple:
    """(value, id) of a cursor; ValueError if it is damaged or belongs to another order."""
    try:
        version, own_sort, own_descending, value, id_ = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except Exception as e:
        raise ValueError("damaged cursor") from e
    if (version, own_sort, own_descending) != (1, sort, descending) or not isinstance(id_, int) or not -INT64 <= id_ < INT64:
        raise ValueError("the cursor belongs to another order")
    return value, id_


def page(rows: DataFrame, sort: str, limit: int, descending: bool = True, after: tuple | None = None) -> DataFrame:
    """The next `limit` rows by (sort, nulls last; id), both in one direction; after: (value, id) of the last row seen."""
    if after is not None:
        value, last = after
        later = (F.col("id") < last) if descending else (F.col("id") > last)
        if value is None:
            rows = rows.where(F.col(sort).isNull() & later)
        else:
            beyond = (F.col(sort) < F.lit(value)) if descending else (F.col(sort) > F.lit(value))
            rows = rows.where(beyond | ((F.col(sort) == F.lit(value)) & later) | F.col(sort).isNull())
    order = (F.col(sort).desc_nulls_last(), F.desc("id")) if descending else (F.col(sort).asc_nulls_last(), F.asc("id"))
    return rows.orderBy(*order).limit(limit)
