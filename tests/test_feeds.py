"""Mapping, rejection, deduplication, deltas and the stored catalog."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import delta
from shelfspark.operators import feed_mapping as fm
from shelfspark.sources import catalog, feeds
from shelfspark.streaming import runs


def feed(spark, rows, columns):
    schema = ", ".join(f"`{c}` string" for c in columns)
    frame = spark.createDataFrame([tuple(r) for r in rows], schema)
    ordered = spark.createDataFrame(
        frame.rdd.zipWithIndex().map(lambda p: (*p[0], p[1])), schema + ", feed_seq long")
    return ordered.withColumn("tenant", F.lit("m"))


def test_rich_row(spark):
    row = feed(spark, [(" P1 ", "Cotton <b>Shirt</b>", "Soft &amp; light", "Clothing >> Men >> Shirts",
                        "Rs. 1,299.00", "999/-", "Y", "4.5/5", "1,234 ratings", "Blue", "Cotton",
                        "x")],
               ["pid", "name", "desc", "cat", "mrp", "sale", "stock", "stars", "reviews", "colour",
                "fabric", "internal_note"])
    mapping = fm.ColumnMapping(
        sku="pid", title="name", description="desc", category="cat", price="sale",
        original_price="mrp", in_stock="stock", rating="stars", review_count="reviews",
        attribute_columns=("colour", "fabric"), default_currency="INR")
    p = fm.map_feed(row, mapping).first()
    assert (p.sku, p.title, p.description) == ("P1", "Cotton Shirt", "Soft & light")
    assert p.category_path == ["Clothing", "Men", "Shirts"]
    assert (p.price, p.original_price, p.currency) == (Decimal(999), Decimal(1299), "INR")
    assert (p.in_stock, p.rating, p.review_count) == (True, 4.5, 1234)
    assert p.attributes == {"colour": "Blue", "fabric": "Cotton"}
    assert p.error_reason is None and p.brand is None and p.raw["internal_note"] == "x"


def test_rejections_duplicates_and_order(spark):
    rows = feed(spark, [("a", "first", "1"), ("b", "b", "2"), ("", "no id", "3"),
                        ("c", " ", "4"), ("a", "second", "5")], ["id", "name", "price"])
    mapped = fm.map_feed(rows, fm.ColumnMapping(sku="id", title="name"))
    bad = {r.feed_seq: r.error_reason for r in fm.rejected(mapped).collect()}
    assert bad == {2: "missing or empty SKU (column 'id')",
                   3: "missing or empty title (column 'name')"}
    kept = delta.dedupe_last_wins(fm.accepted(mapped)).orderBy("first_seq").collect()
    assert [(r.sku, r.title, r.copies) for r in kept] == [("a", "second", 2), ("b", "b", 1)]
    stats = delta.parse_stats(mapped).first()
    assert (stats.total, stats.ok, stats.failed, stats.duplicates) == (5, 3, 2, 1)
    assert stats.reasons == {"missing or empty SKU": 1, "missing or empty title": 1}


def test_stored_mapping_and_exclusive_options():
    mapping = fm.stored_mapping({"sku": "id", "unknown": 1, "attribute_columns": ["a"]})
    assert mapping.sku == "id" and mapping.attribute_columns == ("a",)
    with pytest.raises(ValueError):
        fm.resolve_mapping(fm.FeedAdapter(mapping), mapping)


def test_content_hash_ignores_attribute_order_and_time(spark):
    base = spark.createDataFrame(
        [("t", "s", "x", "", None, [], Decimal("1299.0000"), None, None, True, None, None, None,
          None, {"a": "1", "b": "2"})],
        "tenant string, sku string, title string, description string, brand string, "
        "category_path array<string>, price decimal(18,4), currency string, "
        "original_price decimal(18,4), in_stock boolean, rating double, review_count long, "
        "image_url string, product_url string, attributes map<string,string>")
    turned = base.withColumn("attributes", F.create_map(
        F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).withColumn("updated_at", F.now())
    changed = base.withColumn("price", F.lit(1).cast("decimal(18,4)"))
    hashes = [delta.with_content_hash(x).first().content_hash for x in (base, turned, changed)]
    assert hashes[0] == hashes[1] != hashes[2]


def test_csv_feed_keeps_file_order_and_quotes(spark, tmp_path):
    (tmp_path / "z.csv").write_text('﻿id,name\n1,"a, ""b""\nc"\n2,x\n', encoding="utf-8")
    (tmp_path / "a.csv").write_text("id,price\n3,9\n", encoding="utf-8")
    read = feeds.read_feed(spark, [str(tmp_path / "z.csv"), str(tmp_path / "a.csv")],
                           multi_line=True)
    rows = read.orderBy("feed_seq").collect()
    assert [(r.id, r.name, r.price) for r in rows] == [
        ("1", 'a, "b"\nc', None), ("2", "x", None), ("3", None, "9")]


def test_enrichment_lines(spark, tmp_path):
    path = tmp_path / "labels.jsonl"
    path.write_text('{"classifications": {"a": "X", "b": "Y"}}\n{"classifications": {"a": "Z"}}\n')
    got = {r.key: r.label for r in feeds.read_enrichment(spark, str(path)).collect()}
    assert got == {"a": "Z", "b": "Y"}
    assert feeds.read_enrichment(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_home_adapter_id_ignores_display_category(spark):
    columns = ["goods-title-link", "goods-title-link--jump", "goods-title-link--jump href",
               "rank-sub", "price", "selling_proposition", "discount"]
    rows = feed(spark, [("Pan", "", "", "in Cookware", "$5", "", ""),
                        ("", "Pan", "http://j", "", "$6", "", "")], columns)
    none = spark.createDataFrame([], "key string, label string")
    one = spark.createDataFrame([("Pan", "Kitchen > Cookware")], "key string, label string")
    ids = []
    for labels in (none, one):
        out = fm.home_adapter(labels, "kitchen").apply(rows).orderBy("feed_seq").collect()
        ids.append([r.sku for r in out])
        assert out[1].product_url == "http://j" and out[1].title == "Pan"
    assert ids[0] == ids[1] and ids[0][0] != ids[0][1]


def test_catalog_table(spark, tmp_path):
    store = catalog.CatalogTable(spark, str(tmp_path / "cat"), buckets=2)
    assert store.delete(spark.createDataFrame([("t", "a")], "tenant string, sku string")) == 0
    rows = spark.createDataFrame(
        [("7", "a", 1.0), ("7", "b", 2.0), ("u", "a", 3.0)], "tenant string, sku string, price double")
    store.upsert(rows)
    store.upsert(rows.where("sku = 'a' AND tenant = '7'").withColumn("price", F.lit(9.0)))
    assert {(r.tenant, r.sku): r.price for r in store.scan().collect()} == {
        ("7", "a"): 9.0, ("7", "b"): 2.0, ("u", "a"): 3.0}
    assert store.delete(rows.where("tenant = '7'")) == 2
    assert [(r.tenant, r.sku) for r in store.scan().collect()] == [("u", "a")]
    store.upsert(rows.limit(1).withColumn("colour", F.lit("red")))
    assert "colour" in store.scan().columns
    assert store.drop_tenant("u") and store.scan("u").count() == 0


def test_ingest_skips_unchanged_and_full_sync_deletes(spark, tmp_path):
    store = catalog.CatalogTable(spark, str(tmp_path / "cat"), buckets=2)
    columns = ["sku", "title", "price"]
    mapping = fm.ColumnMapping()
    first = feed(spark, [("a", "A", "1"), ("b", "B", "2"), ("c", "C", "3")], columns)
    job = runs.ingest_batch(first, store, mapping).first()
    assert (job.indexed, job.unchanged, job.deleted, job.status) == (3, 0, 0, "succeeded")
    second = feed(spark, [("a", "A", "1"), ("b", "B", "5"), ("c", "", "3")], columns)
    job = runs.ingest_batch(second, store, mapping, full_sync=True).first()
    # c is stored but its new row was rejected, so a full sync removes it.
    assert (job.indexed, job.unchanged, job.deleted, job.status) == (1, 1, 1, "partial")
    assert sorted(r.sku for r in store.scan().collect()) == ["a", "b"]


def test_roundtrip_ignores_float_noise(spark):
    left = spark.createDataFrame([("t", "a", 1.0, "x"), ("t", "b", 2.0, None), ("t", "c", 3.0, "z")],
                                 "tenant string, sku string, price double, title string")
    right = spark.createDataFrame([("t", "a", 1.0000000001, "x"), ("t", "b", 2.1, None)],
                                  "tenant string, sku string, price double, title string")
    issues = {(r.sku, r.field) for r in delta.roundtrip_diff(left, right, ["price", "title"]).collect()}
    assert issues == {("b", "price"), ("c", "missing")}


def test_reopened_catalog_keeps_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/catalog"
    rows = spark.range(50).select(F.lit("t").alias("tenant"), F.concat(F.lit("s"), "id").alias("sku"),
                                  F.lit("old").alias("title"), F.lit("h").alias("content_hash"))
    catalog.CatalogTable(spark, path, buckets=4).upsert(rows)
    again = catalog.CatalogTable(spark, path)
    assert again.buckets == 4
    again.upsert(rows.withColumn("title", F.lit("new")))
    assert {(r["title"], r["count"]) for r in again.scan().groupBy("title").count().collect()} == {("new", 50)}


def test_raw_rows_are_those_before_the_hook(spark):
    rows = feed(spark, [("a", "one", "5"), ("", "two", "6"), (" ", "three", "7")], ["id", "name", "price"])
    changed = fm.map_feed(rows, fm.ColumnMapping(sku="id", title="name"),
                          preprocess=lambda f: f.withColumn("id", F.nullif("id", F.lit(" "))).drop("price"))
    raw = {r.feed_seq: r.raw for r in fm.rejected(changed).collect()}
    assert raw == {1: {"id": "", "name": "two", "price": "6"}, 2: {"id": " ", "name": "three", "price": "7"}}
    picked = fm.map_feed(rows, fm.ColumnMapping(sku="id", title="name"),
                         preprocess=lambda f: f.select("tenant", "feed_seq", "id", "name"))
    assert {r.feed_seq: r.raw["price"] for r in fm.rejected(picked).collect()} == {1: "6", 2: "7"}


def test_failed_batches_are_in_the_ledger(spark, tmp_path):
    rows = feed(spark, [("a", "one", "5"), ("b", "two", "6")], ["sku", "title", "price"])
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    broken = fm.FeedAdapter(fm.ColumnMapping(), postprocess=lambda m: m.withColumn(
        "title", F.raise_error(F.lit("no such catalogue"))))
    table = catalog.CatalogTable(spark, f"file://{tmp_path}/table", buckets=2)
    with pytest.raises(Exception, match="no such catalogue"):
        runs.incremental_ingest(stream, table, f"file://{tmp_path}/ledger", f"file://{tmp_path}/state",
                                adapter=broken)
    entry = spark.read.parquet(f"file://{tmp_path}/ledger/*").first()
    assert (entry.tenant, entry.status, entry.total) == ("m", "failed", None)
    assert "no such catalogue" in entry.errors_json
