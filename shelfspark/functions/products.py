"""Derived product columns: index text, hashes, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.schema import PRODUCT_FIELDS


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def attributes_text(attributes: Column) -> Column:
    """``key: value`` lines in key order; null values are left out."""
    entries = F.array_sort(F.map_entries(F.map_filter(attributes, lambda k, v: v.isNotNull())))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def embedding_text(title: Column, brand: Column, description: Column,
                   attributes: Column) -> Column:
    """Text to embed: title, brand, description, attributes; never the category."""
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), _filled(brand), _filled(description),
                       _filled(attributes_text(attributes)))


def rerank_text(title: Column, brand: Column, description: Column,
                attribute_lines: Column) -> Column:
    """The same text from a stored row."""
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), _filled(brand), _filled(description),
                       _filled(attribute_lines))


def content_hash() -> Column:
    """Hash over every product field but ``updated_at``; equal content, equal hash.

    Prices count by their value, whatever type they come in.
    """
    fields = []
    for name in sorted(PRODUCT_FIELDS):
        column = F.col(name)
        if name == "attributes":
            column = F.array_sort(F.map_entries(column))
        elif name in ("price", "original_price"):
            column = column.cast("decimal(18,4)")
        fields.append(column.alias(name))
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def object_id(tenant: Column, sku: Column) -> Column:
    """Deterministic key of one product of one tenant."""
    return F.sha2(F.concat_ws("\u0000", tenant, sku), 256)


def attributes_from_json(text: Column) -> Column:
    """Attribute map from stored JSON; unreadable text gives an empty map."""
    parsed = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))
