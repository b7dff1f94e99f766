"""Text functions as Column expressions, and the few that need Python in batches."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Patterns of the description normaliser, in the order in which they apply.
POS_PREFIX = r"(?i)^(SQ\s*\*|TST\s*\*|PP\s*\*|PAYPAL\s*\*|VENMO\s*\*|ZELLE\s*\*|CKE\s*\*)"
TRAILING_LOCATION = r"\s+(?:[A-Z]{2}\s+\d{5}(?:-\d{4})?$|[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*,?\s+[A-Z]{2}$|\d{5}(?:-\d{4})?$)"
TRAILING_NUMBER = r"\s+#?\d{3,}$"
# State codes.
STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
# What redaction takes out, in order, with what stays in its place.
REDACTIONS = (
    (r"(?i)\b((?:PAYMENT|ZELLE|VENMO|CASHAPP)\s+(?:TO|FROM))\s+.*$", "$1"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", ""),
    (r"\(?\b\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|\b\d{3}[-.\s]\d{4}\b", ""),
    (rf"\b[A-Z][A-Z0-9]+(?:\s+[A-Z][A-Z0-9]+)*\s+(?:{STATES})\b", ""),
    (rf"\b(?:{STATES})\b", ""),
    (r"\b\d{1,2}/\d{2}\b", ""),
    (r"#\d+", ""),
    (r"(?i)\b\w[\w.-]*\.(?:COM|NET|ORG|IO|US|CA)\b(?:/\S*)?", ""),
    (r"\*\w+|\w+\*\w*", ""),
    (r"\b\d{3,5}\b", ""),
)


def normalize_description(c: Column) -> Column:
    """STR09: without point-of-sale prefix, trailing place and trailing number, blanks collapsed."""
    x = F.trim(F.coalesce(c, F.lit("")))
    for p in (POS_PREFIX, TRAILING_LOCATION, TRAILING_NUMBER):
        x = F.regexp_replace(x, p, "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def redact(c: Column) -> Column:
    """STR10: the normalised description without what may name a person or place."""
    x = normalize_description(c)
    for p, keep in REDACTIONS:
        x = F.regexp_replace(x, p, keep)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def match_text(description: Column, memo: Column) -> Column:
    """STR11: both sides normalised, empty ones left out, a line break between."""
    blank = lambda x: F.nullif(normalize_description(x), F.lit(""))
    return F.concat_ws("\n", blank(description), blank(memo))


def alias_key(c: Column) -> Column:
    """STR12: lower case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def label_parts(c: Column) -> Column:
    """STR13: an account label's name and, where it ends in four digits, these."""
    last = F.regexp_extract(c, r"(\d{4})\)?\s*$", 1)
    name = F.trim(F.regexp_replace(c, r"[\s(.*x#-]*\d{4}\)?\s*$", ""))
    return F.struct(name.alias("name"), F.nullif(last, F.lit("")).alias("last_four"))


def sha16(*parts: Column) -> Column:
    """STR14: the first 16 hex digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def canonical(c: Column) -> Column:
    """DOM01: upper case, all but letters and digits as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", " "), r"\s+", " "))


@lru_cache(1 << 16)
def _jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left, places = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                places.append(j)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in sorted(places)]
    t = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if jaro <= 0.7:
        return jaro
    head = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        head += 1
    return jaro + 0.1 * head * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR07: 0 where a side is empty or null."""
    return pd.Series([_jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)])


#: The same for plans in which filters on the result follow: none is pushed below it, so it is worked out once a row.
jaro_winkler_once = F.pandas_udf(jaro_winkler.func, DoubleType()).asNondeterministic()


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR08: Ratcliff and Obershelp's ratio of two texts, for small dimension tables."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])
