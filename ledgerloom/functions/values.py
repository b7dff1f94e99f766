"""Amounts, dates and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may stand about an amount, and date formats in order of preference.
CURRENCY_SIGNS = r"(?i)[$€£¥₩₹₽₺₫]|CHF|R\$|kr\b|SEK|NOK|DKK"
DATE_FORMATS = ("MM/dd/yyyy", "yyyy-MM-dd", "MM/dd/yy", "MM-dd-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "dd-MMMM-yyyy", "MMM dd, yyyy")


def parse_amount(c: Column, style: str = "us") -> Column:
    """NUM03: a text as decimal(18,2); brackets, a minus sign and DR make it negative, CR positive."""
    s = F.trim(c)
    brackets = s.startswith("(") & s.endswith(")")
    s = F.when(brackets, F.trim(F.regexp_replace(s, r"^\(|\)$", ""))).otherwise(s)
    minus = s.startswith("-")
    s = F.trim(F.regexp_replace(s, "^-", ""))
    debit, credit = s.rlike("(?i) DR$"), s.rlike("(?i) CR$")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "(?i) (DR|CR)$", ""), CURRENCY_SIGNS, ""))
    if style == "european":
        s = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    elif style == "swiss_french":
        s = F.replace(F.replace(s, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    else:
        s = F.replace(s, F.lit(","), F.lit(""))
    x = s.try_cast("decimal(18,2)")
    return F.when(credit, x).when(brackets | minus | debit, -x).otherwise(x)


def number_votes(df: DataFrame, column: str) -> DataFrame:
    """NUM04: how many values speak for each style of numbers; one aggregation."""
    c = F.trim(F.col(column))
    return df.agg(
        F.count_if(c.rlike(r"\d{1,3}(\.\d{3})+,\d{2}$") | c.rlike(r"^\D*\d+,\d{2}$")).alias("european"),
        F.count_if(c.rlike(r"\d{1,3}(,\d{3})+(\.\d{2})?$") | c.rlike(r"^\D*\d+\.\d{2}$")).alias("us"),
        F.count_if(c.rlike(r"\d{1,3}( \d{3})+,\d{2}$")).alias("swiss_french"),
        F.count_if(c.rlike(r"^\D*\d{1,3}(,\d{3})+$")).alias("zero_decimal"),
    )


def date_votes(df: DataFrame, column: str, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """DAT06: the share of values that each format reads, one column each; one pass."""
    c = F.nullif(F.trim(F.col(column)), F.lit(""))
    return df.agg(*[(F.count(F.try_to_timestamp(c, F.lit(f))) / F.nullif(F.count(c), F.lit(0))).alias(f) for f in formats])


def detect_date_format(df: DataFrame, column: str, least: float = 0.9) -> str | None:
    """The first format that reads at least that share of the values."""
    row = date_votes(df, column).first().asDict()
    found = [(share, f) for f, share in row.items() if share is not None and share >= least]
    return max(found, key=lambda x: (x[0], -DATE_FORMATS.index(x[1])))[1] if found else None


def last_publication_day(d: Column) -> Column:
    """DAT09: Saturdays and Sundays roll back to Friday."""
    return F.date_sub(d, F.greatest(F.lit(0), F.weekday(d) - 4))


def is_long_term(acquired: Column, disposed: Column) -> Column:
    """DAT08: disposed later than a year after; a 29 February's year ends on the 28th."""
    return disposed > F.add_months(acquired, 12)
