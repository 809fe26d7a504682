"""Prices, ratings, counts, flags and currencies from messy feed text.

Every function maps a string column to a typed column and gives null, never an error, for
text it cannot read, so one bad cell cannot fail a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency tokens and their ISO codes.
CURRENCY_TOKENS = {
    "₹": "INR", "rs.": "INR", "rs": "INR", "inr": "INR",
    "us$": "USD", "usd": "USD", "$": "USD",
    "£": "GBP", "gbp": "GBP",
    "€": "EUR", "eur": "EUR",
    "¥": "JPY", "jpy": "JPY",
    "aed": "AED",
}

# Price patterns and boolean words.
NOT_A_PRICE = (
    r"(?i)^\s*(?:n/?a|nil|none|null|-+|price\s*not\s*available|out\s*of\s*stock|tbd|\?+)\s*$"
)
PRICE_NOISE = (
    r"(?i)\(.*?\)|\b(?:onwards?|only|approx\.?|starting(?:\s+at)?|mrp|incl\.?|excl\.?)\b|/-"
)
NUMBER = r"-?\d[\d\s\x1c-\x1f\x85\p{Z}.,']*\d|-?\d"
TRUE_WORDS = ["1", "true", "t", "yes", "y", "in stock", "instock", "available", "in_stock"]
FALSE_WORDS = ["0", "false", "f", "no", "n", "out of stock", "outofstock", "unavailable", "sold out"]

FLOAT = r"(?i)^[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity)$"
LONE_THOUSANDS = r"^([^.,]*)[.,]([^.,]{3})$"
COMMA_BEFORE_LAST_DOT = r",(?=.*\.[^.,]*$)"
DOT_BEFORE_LAST_COMMA = r"\.(?=.*,[^.,]*$)"
BELOW_ZERO = r"^-(?=.*[1-9]).*$"


def detect_currency(raw: Column) -> Column:
    """ISO code of the longest currency token found anywhere in the text."""
    text = F.lower(raw)
    found = F.lit(None).cast("string")
    # Built from the shortest token outwards, so the longest is tested first.
    for token in sorted(CURRENCY_TOKENS, key=len):
        found = F.when(F.contains(text, F.lit(token)), CURRENCY_TOKENS[token]).otherwise(found)
    return found


def normalise_number(text: Column) -> Column:
    """Plain decimal text: the last separator is the decimal point, unless it is the only
    one and exactly three characters follow it."""
    digits = F.translate(text, "\u00a0 '", "")
    whole = F.regexp_replace(digits, LONE_THOUSANDS, "$1$2")
    dotted = F.regexp_replace(whole, COMMA_BEFORE_LAST_DOT, "")
    return F.translate(F.regexp_replace(dotted, DOT_BEFORE_LAST_COMMA, ""), ",", ".")


def first_number(raw: Column) -> Column:
    """Plain decimal text of the first number, sign kept."""
    return normalise_number(F.nullif(F.regexp_extract(raw, NUMBER, 0), F.lit("")))


def parse_price(raw: Column) -> Column:
    """First price in the text as decimal(18,4); negatives and non-prices give null."""
    number = first_number(F.regexp_replace(raw, PRICE_NOISE, " "))
    value = F.regexp_replace(number, BELOW_ZERO, "").try_cast("decimal(18,4)")
    return F.when(~raw.rlike(NOT_A_PRICE), value)


def parse_int(raw: Column) -> Column:
    """First number, truncated towards zero."""
    return first_number(raw).try_cast("decimal(38,6)").try_cast("long")


def parse_bool(cleaned: Column, default: bool | None = None) -> Column:
    """Flag from cleaned text; unknown words give the default."""
    word = F.lower(cleaned)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).otherwise(
        F.lit(default).cast("boolean"))


def parse_rating(raw: Column, source_scale: float = 5.0) -> Column:
    """Rating on a 0-5 scale; ``x/y`` brings its own scale when y is above zero."""
    def number(text: Column) -> Column:
        plain = F.translate(F.trim(text), ",", ".")
        return F.regexp_extract(plain, FLOAT, 0).try_cast("double")

    slash = F.instr(raw, "/")
    below = number(F.substring(raw, slash + 1, F.length(raw)))
    over = number(F.when(slash > 0, F.substring(raw, F.lit(1), slash - 1)).otherwise(raw))
    # A denominator of zero or less leaves the whole text, which is then no number.
    readable = (slash == 0) | below.isNull() | (below > 0)
    scale = F.when((slash > 0) & (below > 0), below).otherwise(F.lit(float(source_scale)))
    clamped = F.greatest(F.lit(0.0), F.least(over, scale))
    return F.when(readable & over.isNotNull() & (scale > 0),
                  F.bround(clamped * 5.0 / scale, 3))


def upper_currency(code: Column) -> Column:
    return F.upper(code)
