"""Feed text: cleaning, category paths, identifiers and word tokens."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Markers of mis-decoded UTF-8 and category separators by priority.
MOJIBAKE_MARKERS = ("Ã", "â", "Â")
CATEGORY_SEPARATORS = (">>", "->", "»", ">", "|", "/", "\\")
MODEL_CATEGORY_SEPARATORS = (">", "/", "|")

WHITESPACE = "[\\s\\x1c-\\x1f]+"
NEEDS_REPAIR = "[&<]|[^\\x00-\\x7f]"
_TAG = re.compile(r"<[^>]+>")
_SPACE = re.compile(r"\s+")
#: An ampersand whose character reference has no semicolon at its end.
_UNENDED = re.compile(r"&(?!#?[0-9A-Za-z]+;)")


def _unmangle(value: str) -> str:
    if any(marker in value for marker in MOJIBAKE_MARKERS):
        try:
            return value.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    return value


def _stripped(value: str, ended: bool = False) -> str:
    """Entities, then tags; with ``ended`` only references that end in a semicolon are resolved."""
    return _TAG.sub(" ", html.unescape(_UNENDED.sub("&amp;", value) if ended else value))


def _clean(value: str | None, ended: bool = False) -> str:
    if value is None:
        return ""
    if not value.isascii():
        value = _unmangle(value)
    if "&" in value or "<" in value:
        value = _stripped(value, ended)
    if not value.isascii():
        value = unicodedata.normalize("NFKC", value)
    return _SPACE.sub(" ", value).strip()


def _split(value: str | None) -> list[str]:
    text = _clean(value)
    for separator in CATEGORY_SEPARATORS:
        if separator in text:
            return [part for part in map(_clean, text.split(separator)) if part]
    return [text] if text else []


def _mapped(column: pd.Series, work: Callable) -> pd.Series:
    """``work`` of the filled cells; most cells of a feed column need none and come as nulls."""
    return pd.Series([work(v) if filled else None for v, filled in zip(column, column.notna(), strict=True)],
                     dtype="object")


# Plain scalar functions: Spark evaluates all calls of one projection in one Arrow pass.
@F.pandas_udf(StringType())
def _clean_batches(column: pd.Series) -> pd.Series:
    return _mapped(column, _clean)


@F.pandas_udf(ArrayType(StringType()))
def _split_batches(column: pd.Series) -> pd.Series:
    return _mapped(column, _split)


@F.pandas_udf(StringType())
def _unmangle_batches(column: pd.Series) -> pd.Series:
    return _mapped(column, _unmangle)


@F.pandas_udf(StringType())
def _clean_ended_batches(column: pd.Series) -> pd.Series:
    return _mapped(column, lambda v: _clean(v, ended=True))


@F.pandas_udf(StringType())
def _strip_html_batches(column: pd.Series) -> pd.Series:
    return _mapped(column, _stripped)


@F.pandas_udf(StringType())
def _strip_ended_batches(column: pd.Series) -> pd.Series:
    return _mapped(column, lambda v: _stripped(v, ended=True))


def repaired_cells(texts: dict[str, Column], paths: Iterable[str] = ()) -> Column:
    """A struct of the cells that need repair, repaired, and nulls for all others, in one Arrow pass.

    Cells named in ``paths`` are split into category paths. ``cell`` and ``path_cell`` read them.
    """
    paths = set(paths)
    kind = StructType([StructField(n, ArrayType(StringType()) if n in paths else StringType()) for n in texts])

    @F.pandas_udf(kind)
    def repair(cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({n: _mapped(cells[n], _split if n in paths else _clean) for n in cells})

    return repair(F.struct(*[F.when(c.rlike(NEEDS_REPAIR), c).alias(n) for n, c in texts.items()]))


def cell(repaired: Column, raw: Column) -> Column:
    """clean_text of a cell, from what the one pass returned for it."""
    return F.coalesce(repaired, clean_plain(raw))


def path_cell(repaired: Column, raw: Column) -> Column:
    """split_categories of a cell, from what the one pass returned for it."""
    return F.coalesce(repaired, split_categories_plain(clean_plain(raw)))


def clean_text(raw: Column, max_length: int | None = None, ended: bool = False) -> Column:
    """Repair encoding, drop markup, fold compatibility characters, collapse white space.

    With ``ended`` a character reference without its semicolon is text, as in XML.
    Null gives the empty string. Entity tables and Unicode folding have no Spark function,
    so cells that hold markup or non-ASCII text take one Arrow-batched call; all others are
    cleaned in the JVM and reach Python only as nulls.
    """
    dirty = raw.rlike(NEEDS_REPAIR)
    batches = _clean_ended_batches if ended else _clean_batches
    text = F.when(dirty, batches(F.when(dirty, raw))).otherwise(clean_plain(raw))
    if max_length is None:
        return text
    return F.rtrim(F.substring(text, 1, max_length))


def clean_plain(raw: Column) -> Column:
    """clean_text for text known to be plain ASCII without markup; stays in the JVM."""
    return F.coalesce(F.trim(F.regexp_replace(raw, WHITESPACE, " ")), F.lit(""))


def strip_html(raw: Column, ended: bool = False) -> Column:
    """Resolve entities, then replace tags by a space; ``ended`` as in ``clean_text``."""
    return _strip_ended_batches(raw) if ended else _strip_html_batches(raw)


def fix_mojibake(raw: Column) -> Column:
    return _unmangle_batches(raw)


def split_categories(raw: Column) -> Column:
    """Category path from feed text, whatever separator it uses."""
    dirty = raw.rlike(NEEDS_REPAIR)
    return F.when(dirty, _split_batches(F.when(dirty, raw))).otherwise(
        split_categories_plain(clean_plain(raw)))


def _split_on_first(text: Column, separators: tuple[str, ...]) -> Column:
    whole = F.array(text)
    parts = whole
    for separator in reversed(separators):
        literal = "\\Q" + separator + "\\E"
        parts = F.when(F.contains(text, F.lit(separator)), F.split(text, literal)).otherwise(parts)
    return F.filter(F.transform(parts, lambda part: F.trim(part)), lambda part: part != "")


def split_categories_plain(cleaned: Column) -> Column:
    """split_categories for text that is already clean; stays in the JVM."""
    return _split_on_first(F.coalesce(cleaned, F.lit("")), CATEGORY_SEPARATORS)


def split_category_path(value: Column) -> Column:
    """Category path of a product given as one string."""
    return _split_on_first(F.coalesce(value, F.lit("")), MODEL_CATEGORY_SEPARATORS)


def normalise_sku(cleaned: Column) -> Column:
    """Cleaned identifier, case kept; blank gives null."""
    return F.nullif(cleaned, F.lit(""))


def first_of_delimited(packed: Column, delimiter: str = "~") -> Column:
    """First segment of a packed list that is not blank."""
    parts = F.transform(F.split(packed, "\\Q" + delimiter + "\\E"), lambda part: F.trim(part))
    return F.get(F.filter(parts, lambda part: part != ""), F.lit(0))


def id_from_url(url: Column, pattern: str = r"/dp/([A-Z0-9]{10})") -> Column:
    """Product id embedded in a link, null when there is none."""
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def strip_in(rank_text: Column) -> Column:
    """Rank label without its leading ``in``."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(rank_text, F.lit(""))), "^in ", ""))


def synthetic_sku(category: Column, title: Column, prefix: str) -> Column:
    """Stable id from category and title, for feeds that have no id."""
    digest = F.sha1(F.concat_ws(":", category, title))
    return F.concat(F.lit(prefix), F.substring(digest, 1, 12))


def first_filled(first: Column, second: Column) -> Column:
    """The first of two columns that is not empty, trimmed after the choice."""
    return F.trim(F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")), F.lit("")))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda token: token != "")


_LATIN = bytes(c if chr(c).isalnum() else 32 for c in range(256))


@cache
def _letters_and_digits() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def words(text: str) -> list[str]:
    """What ``word_tokens`` gives, for code inside tasks: all other characters become spaces."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kept = np.where(_letters_and_digits()[codes], codes, np.uint32(32))
        return kept.tobytes().decode("utf-32-le").split()
