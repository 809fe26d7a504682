"""Result shapes both engines print alike, and small SQL builders for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(field: T.StructField) -> Column:
    c, t = F.col(f"`{field.name}`"), field.dataType
    if isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
        c = F.round(c.cast("double"), 6)
    elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
        c = c.cast("long")
    elif isinstance(t, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(t, T.ArrayType):
        c = F.array_join(c.cast("array<string>"), "|")
    elif isinstance(t, (T.MapType, T.StructType)):
        c = F.to_json(c)
    return c.alias(field.name)


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, times as microseconds, lists joined by a bar."""
    return df.select(*[_plain(field) for field in df.schema.fields])


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_number(x: str) -> str:
    """Plain decimal text of a matched number, by position of the separators."""
    d = f"translate({x}, ' ''', '')"
    comma = f"(length({d}) + 1 - nullif(strpos(reverse({d}), ','), 0))"
    dot = f"(length({d}) + 1 - nullif(strpos(reverse({d}), '.'), 0))"
    single = f"(length({d}) - length(translate({d}, '.,', ''))) = 1"
    return f"""CASE WHEN {comma} IS NULL AND {dot} IS NULL THEN {d}
      WHEN {single} AND length({d}) - coalesce({comma}, {dot}) = 3 THEN translate({d}, '.,', '')
      WHEN coalesce({comma}, 0) > coalesce({dot}, 0)
        THEN replace(replace({d}, '.', ''), ',', '.')
      ELSE replace({d}, ',', '') END"""


NUMBER_SQL = r"-?\d[\d\s.,'' ]*\d|-?\d"


def sql_first_number(x: str) -> str:
    found = f"nullif(regexp_extract({x}, '{NUMBER_SQL}'), '')"
    return sql_number(found)


def sql_price(x: str) -> str:
    noise = (r"(?i)\(.*?\)|\b(?:onwards?|only|approx\.?|starting(?:\s+at)?|mrp|incl\.?|excl\.?)\b"
             r"|/-")
    not_price = (r"(?i)^\s*(?:n/?a|nil|none|null|-+|price\s*not\s*available|out\s*of\s*stock|tbd"
                 r"|\?+)\s*$")
    text = f"regexp_replace({x}, '{noise}', ' ', 'g')"
    value = f"try_cast({sql_first_number(text)} AS DECIMAL(18,4))"
    return (f"CASE WHEN NOT regexp_matches({x}, '{not_price}') AND {value} >= 0 "
            f"THEN CAST({value} AS DOUBLE) END")


def sql_currency(x: str) -> str:
    ordered = [("rs.", "INR"), ("inr", "INR"), ("us$", "USD"), ("usd", "USD"), ("gbp", "GBP"),
               ("eur", "EUR"), ("jpy", "JPY"), ("aed", "AED"), ("rs", "INR"), ("₹", "INR"),
               ("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("¥", "JPY")]
    cases = " ".join(f"WHEN contains(lower({x}), '{token}') THEN '{code}'"
                     for token, code in ordered)
    return f"CASE {cases} END"


def sql_rating(x: str) -> str:
    """A rating on a scale of 5; ``a/b`` brings its own scale, which must be above zero."""
    def number(text: str) -> str:
        return f"try_cast(nullif(regexp_extract(replace({text}, ',', '.'), '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE)"

    over, below = number(f"split_part({x}, '/', 1)"), number(f"split_part({x}, '/', 2)")
    scale = f"CASE WHEN contains({x}, '/') THEN {below} ELSE 5.0 END"
    return (f"CASE WHEN {scale} > 0 THEN round_even(greatest(0.0, least({over}, {scale})) * 5.0 / {scale}, 3)"
            f"::DOUBLE END")


def sql_bool(x: str, default: str = "NULL") -> str:
    word = f"lower({sql_clean(x)})"
    return f"""CASE WHEN {word} IN ('1', 'true', 't', 'yes', 'y', 'in stock', 'instock',
        'available', 'in_stock') THEN true
      WHEN {word} IN ('0', 'false', 'f', 'no', 'n', 'out of stock', 'outofstock',
        'unavailable', 'sold out') THEN false ELSE {default} END"""


def sql_categories(x: str) -> str:
    c = sql_clean(x)
    cases = " ".join(
        f"WHEN contains({c}, '{sep}') THEN string_split({c}, '{sep}')"
        for sep in (">>", "->", "»", ">", "|", "/", "\\"))
    return (f"list_filter(list_transform(CASE {cases} ELSE [{c}] END, lambda p: trim(p)), "
            f"lambda p: p <> '')")
