"""The canonical product row and the other shared table shapes."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 4)

PRODUCT_FIELDS: dict[str, T.DataType] = {
    "sku": T.StringType(),
    "title": T.StringType(),
    "description": T.StringType(),
    "brand": T.StringType(),
    "category_path": T.ArrayType(T.StringType()),
    "price": PRICE,
    "currency": T.StringType(),
    "original_price": PRICE,
    "in_stock": T.BooleanType(),
    "rating": T.DoubleType(),
    "review_count": T.LongType(),
    "image_url": T.StringType(),
    "product_url": T.StringType(),
    "attributes": T.MapType(T.StringType(), T.StringType()),
}

PRODUCT = T.StructType(
    [T.StructField("tenant", T.StringType())]
    + [T.StructField(name, dtype) for name, dtype in PRODUCT_FIELDS.items()]
    + [T.StructField("updated_at", T.TimestampType())]
)

FILTER_FIELDS = T.StructType([
    T.StructField("min_price", PRICE),
    T.StructField("max_price", PRICE),
    T.StructField("brands", T.ArrayType(T.StringType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("in_stock_only", T.BooleanType()),
    T.StructField("genders", T.ArrayType(T.StringType())),
    T.StructField("min_rating", T.DoubleType()),
])

EVIDENCE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("price", PRICE),
    T.StructField("metric", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("minimum", PRICE),
    T.StructField("maximum", PRICE),
    T.StructField("mean", PRICE),
]))

LOG_EVENT = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("event", T.StringType()),
    T.StructField("tenant", T.StringType()),
    T.StructField("conversation_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("cache_written", T.BooleanType()),
])
