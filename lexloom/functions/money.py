"""Amounts, dates and identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount_minor(raw: Column) -> Column:
    """Minor units of an amount as written; null where there is no number.

    The rightmost of comma and point is the decimal mark; a lone comma only before exactly two final digits.
    """
    s = F.regexp_replace(raw, r"[^0-9,.\-]", "")
    negative = s.startswith("-")
    s = F.replace(s, F.lit("-"), F.lit(""))
    comma, point = F.length(s) - F.instr(F.reverse(s), ","), F.length(s) - F.instr(F.reverse(s), ".")
    has_comma, has_point = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    comma_decimal = F.when(has_comma & has_point, comma > point).otherwise(has_comma & s.rlike(r"^[0-9]*,[0-9]{2}$"))
    plain = F.when(comma_decimal, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    number = F.when(plain.rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$"), plain.try_cast("double"))
    minor = F.bround(number * 100).cast("long")
    return F.when(negative, -minor).otherwise(minor)


def iso_date(raw: Column) -> Column:
    """A date from YYYY-MM-DD and nothing else."""
    return F.when(F.trim(raw).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(raw).try_cast("date"))


def currency_code(raw: Column) -> Column:
    up = F.upper(F.trim(raw))
    return F.when(up.rlike("^[A-Z]{3}$"), up)


def iban_valid(raw: Column) -> Column:
    """The mod-97 rule, with 15 to 34 characters. Digits are folded one by one, so any length fits."""
    s = F.upper(F.regexp_replace(raw, r"\s", ""))
    turned = F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), "")
    value = F.transform(F.filter(turned, lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(value, F.lit(0), lambda r, v: F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97).cast("int"))
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)
