"""Closed-set category enrichment: taxonomy, work items, classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import strip_in, word_tokens
from shelfspark.operators.feed_mapping import UNCATEGORIZED
from shelfspark.operators.ranks import dense_index, top_k

SEPARATOR = " > "
DESCRIPTION_CHARS = 150
BATCH_SIZE = 40

# The closed label sets.
TAXONOMIES = {
    "fashion": [
        "Apparel > Menswear", "Apparel > Womenswear", "Apparel > Kidswear",
        "Apparel > Innerwear & Loungewear", "Footwear > Men's", "Footwear > Women's",
        "Footwear > Kids'", "Bags & Luggage > Bags", "Bags & Luggage > Backpacks",
        "Bags & Luggage > Luggage & Trolleys", "Watches > Watches",
        "Jewelry & Eyewear > Jewelry", "Jewelry & Eyewear > Sunglasses & Eyewear",
        "Accessories > Belts & Small Accessories", "Beauty & Personal Care > Skincare",
        "Beauty & Personal Care > Makeup", "Beauty & Personal Care > Haircare",
        "Beauty & Personal Care > Fragrance & Bath",
        "Sportswear & Activewear > Sportswear & Activewear",
        "Home & Living > Decor & Furnishing", "Home & Living > Bedding & Bath",
        "Home & Living > Kitchen & Dining", UNCATEGORIZED,
    ],
    "electronics": [
        "Mobiles & Accessories > Smartphones", "Mobiles & Accessories > Cases & Screen Guards",
        "Computing > Laptops", "Computing > Storage & Peripherals",
        "Audio > Headphones & Earbuds", "Audio > Speakers",
        "TV & Home Entertainment > TV & Home Entertainment",
        "Cameras & Photography > Cameras & Photography", "Wearables > Wearables",
        "Cables, Chargers & Power > Cables, Chargers & Power",
        "Home Appliances > Home Appliances", UNCATEGORIZED,
    ],
    "home": [
        "Kitchen & Dining > Cookware", "Kitchen & Dining > Tableware & Drinkware",
        "Kitchen & Dining > Kitchen Storage", "Kitchen & Dining > Small Appliances",
        "Bedding & Bath > Bedding & Linens", "Bedding & Bath > Bath Textiles",
        "Bedding & Bath > Bath Accessories", "Home Decor > Wall Decor",
        "Home Decor > Decorative Accents", "Home Decor > Lighting & Candles",
        "Storage & Organization > Closet & Wardrobe",
        "Storage & Organization > General Storage", "Furniture > Living Room",
        "Furniture > Bedroom", "Furniture > Outdoor Furniture",
        "Outdoor & Garden > Garden Tools & Decor", "Outdoor & Garden > Outdoor Living",
        "Tools & Home Improvement > Hand Tools & Hardware",
        "Tools & Home Improvement > Home Repair", "Cleaning & Laundry > Cleaning Supplies",
        "Cleaning & Laundry > Laundry Accessories", UNCATEGORIZED,
    ],
}

# Keyword buckets in order of precedence.
KEYWORD_BUCKETS = {
    "phone": r"(?i)\b(phone|smartphone|redmi|iphone|oneplus|realme)\b",
    "camera": r"(?i)\b(camera|dslr|webcam)\b",
    "audio": r"(?i)\b(earphone|headphone|earbud|speaker|bluetooth audio)\b",
    "cable_charger": r"(?i)\b(cable|charger|adapter|power bank)\b",
    "computer": r"(?i)\b(laptop|keyboard|mouse|monitor)\b",
}


def taxonomy_table(spark: SparkSession, taxonomies: dict[str, list[str]] = TAXONOMIES) -> DataFrame:
    rows = [(tenant, i, leaf) for tenant, leaves in taxonomies.items()
            for i, leaf in enumerate(leaves)]
    return spark.createDataFrame(rows, "tenant string, position int, leaf string")


def taxonomy_values(taxonomy: DataFrame) -> DataFrame:
    """Sorted distinct parent and leaf names per tenant; an unknown tenant has no row."""
    names = taxonomy.select("tenant", F.explode(F.split("leaf", SEPARATOR)).alias("name"))
    return names.groupBy("tenant").agg(F.sort_array(F.collect_set("name")).alias("category_values"))


def keyword_bucket(title: Column, buckets: dict[str, str] = KEYWORD_BUCKETS) -> Column:
    """First bucket whose words occur in the title."""
    return F.coalesce(*[F.when(title.rlike(pattern), name) for name, pattern in buckets.items()])


def group_key(kind: Column) -> Column:
    """Grouping key of a catalog: brand, first category or keyword bucket."""
    return (F.when(kind == "fashion", F.col("brand"))
            .when(kind == "home", F.get("category_path", F.lit(0)))
            .when(kind == "electronics", keyword_bucket(F.col("title"))))


def work_items(rows: DataFrame, by_title: bool, order: str = "feed_seq") -> DataFrame:
    """One item per identity key: (tenant, key, title, description, hint, first_seq).

    Title keys keep their first row; id keys keep their last row at the first position.
    rows: tenant, key, title, description, hint and the order.
    """
    hint = F.nullif(strip_in(F.col("hint")), F.lit(""))
    described = rows.select(
        "tenant", "key", F.col(order).alias("_o"), F.struct(
            F.col("title"), F.substring(F.coalesce("description", F.lit("")), 1,
                                        DESCRIPTION_CHARS).alias("description"),
            hint.alias("hint")).alias("_i")).where(
        (F.coalesce("key", F.lit("")) != "") & (F.coalesce("_i.title", F.lit("")) != ""))
    pick = F.min_by if by_title else F.max_by
    return described.groupBy("tenant", "key").agg(
        pick("_i", "_o").alias("_i"), F.min("_o").alias("first_seq")).select(
        "tenant", "key", "_i.*", "first_seq")


def not_done(items: DataFrame, labels: DataFrame) -> DataFrame:
    return items.join(labels.select("key"), "key", "left_anti")


def pilot(items: DataFrame, n: int) -> DataFrame:
    """The first n remaining items per tenant."""
    return top_k(items, ["tenant"], [F.col("first_seq")], n)


def number_batches(items: DataFrame, bucket: Column, size: int = BATCH_SIZE) -> DataFrame:
    """Items with batch (0-based) and slot inside it."""
    at = F.col("_index") - 1
    return dense_index(items, ["tenant"], [F.col("first_seq")], bucket, "_index").withColumns({
        "batch": F.floor(at / size), "slot": (at % size).cast("int")}).drop("_index")


def work_line() -> Column:
    """One numbered prompt line."""
    return F.concat_ws(
        " ", F.concat(F.col("slot").cast("string"), F.lit(". "), F.col("title")),
        F.when(F.col("description") != "",
               F.concat(F.lit("(description: "), F.col("description"), F.lit(")"))),
        F.when(F.col("hint").isNotNull(),
               F.concat(F.lit("(scraper category hint: "), F.col("hint"), F.lit(")"))))


def keyword_overlap(text: Column, leaf: Column) -> Column:
    """Default scorer: how many of the label's words the text holds."""
    return F.size(F.array_intersect(F.array_distinct(word_tokens(leaf)), word_tokens(text)))


def classify(items: DataFrame, taxonomy: DataFrame,
             scorer: Callable[[Column, Column], Column] = keyword_overlap) -> DataFrame:
    """Best label per item: (tenant, key, label); no overlap leaves it uncategorised.

    The label sets are a few dozen rows, gathered to one array per tenant, so each item is
    scored inside its own row.
    """
    labels = taxonomy.where(F.col("leaf") != UNCATEGORIZED).groupBy("tenant").agg(
        F.array_sort(F.collect_list(F.struct("position", "leaf"))).alias("_labels"))
    text = F.concat_ws(" ", "title", "description", "hint")
    scored = items.join(labels, "tenant", "left").withColumn("_s", F.transform(
        "_labels", lambda x: F.struct(scorer(text, x["leaf"]).alias("score"),
                                      (-x["position"]).alias("neg"), x["leaf"].alias("leaf"))))
    best = F.array_max("_s")
    return scored.select("tenant", "key", F.when(best["score"] > 0, best["leaf"]).otherwise(
        F.lit(UNCATEGORIZED)).alias("label"))


def validate_labels(proposed: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels outside the tenant's closed set, or missing, become uncategorised."""
    known = taxonomy.select("tenant", F.col("leaf").alias("label"), F.lit(True).alias("_ok"))
    return proposed.join(known, ["tenant", "label"], "left").select(
        "tenant", "key", F.when(F.col("_ok"), F.col("label")).otherwise(
            F.lit(UNCATEGORIZED)).alias("label"))
