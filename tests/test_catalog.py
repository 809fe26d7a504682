"""Snapshots of the stored catalog, and the index kept beside its rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.text import word_tokens
from shelfspark.operators import search, text_index
from shelfspark.sources.catalog import CatalogTable, ConcurrentWrite


def products(spark, n, tenant="t", title="one"):
    return spark.range(n).select(F.lit(tenant).alias("tenant"), F.concat(F.lit("s"), "id").alias("sku"),
                                 F.lit(title).alias("title"))


def test_a_large_tenant_is_many_leaves(spark, tmp_path):
    table = CatalogTable(spark, f"file://{tmp_path}/c", leaf_rows=100)
    table.upsert(products(spark, 1000, "hot").unionByName(products(spark, 20, "odd %/=~ name")))
    leaves = table.manifest(table.snapshot()).where("file IS NOT NULL").collect()
    assert sum(r["tenant"] == "hot" for r in leaves) >= 10
    assert max(r["rows"] for r in leaves) <= 200 and sum(r["rows"] for r in leaves) == 1020
    # A change touches its own leaves only; leaves split again as they grow.
    before = {r["file"] for r in leaves}
    table.upsert(products(spark, 1, "hot", "two"))
    after = {r["file"] for r in table.manifest(table.snapshot()).where("file IS NOT NULL").collect()}
    assert len(before - after) == 1 == len(after - before)
    table.upsert(products(spark, 3000, "hot", "three"))
    rows = table.scan("hot").groupBy("title").count().collect()
    assert [(r["title"], r["count"]) for r in rows] == [("three", 3000)]
    assert table.scan("odd %/=~ name").count() == 20


def test_leaves_cover_all_hashes_after_deletions(spark, tmp_path):
    table = CatalogTable(spark, f"file://{tmp_path}/c", leaf_rows=10)
    table.upsert(products(spark, 200))
    assert table.delete(products(spark, 190)) == 190
    table.upsert(products(spark, 400, title="again"))
    assert table.scan().count() == 400 and table.scan().distinct().count() == 400
    assert table.delete(products(spark, 400)) == 400 and table.scan().count() == 0
    table.upsert(products(spark, 5))
    assert table.scan().count() == 5


def test_former_snapshots_stay_readable(spark, tmp_path):
    table = CatalogTable(spark, f"file://{tmp_path}/c")
    table.upsert(products(spark, 3))
    table.upsert(products(spark, 4).withColumn("colour", F.lit("red")))
    assert table.versions() == [0, 1]
    assert table.scan(snapshot=0).columns == ["tenant", "sku", "title"]
    assert (table.scan(snapshot=0).count(), table.scan().where("colour = 'red'").count()) == (3, 4)
    assert table.expire(keep=1) == 1 and table.versions() == [1] and table.scan().count() == 4


def test_a_failed_write_leaves_the_former_state(spark, tmp_path, monkeypatch):
    table = CatalogTable(spark, f"file://{tmp_path}/c", indexed=True)
    table.upsert(products(spark, 3))
    bad = products(spark, 3).withColumn("title", F.when(F.col("sku") == "s2", F.raise_error(F.lit("stop")))
                                        .otherwise(F.lit("new")))
    with pytest.raises(Exception, match="stop"):
        table.upsert(bad)
    # Killed after the data are written, before the snapshot is.
    monkeypatch.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        table.upsert(products(spark, 9, title="new"))
    fresh = CatalogTable(spark, f"file://{tmp_path}/c")
    assert fresh.indexed and {r["title"] for r in fresh.scan().collect()} == {"one"}
    assert fresh.index().postings.select("term").distinct().count() == 4


def test_two_writers(spark, tmp_path):
    one = CatalogTable(spark, f"file://{tmp_path}/c")
    one.upsert(products(spark, 1))
    stale = one.snapshot()
    one.upsert(products(spark, 2))
    with pytest.raises(ConcurrentWrite):
        one._commit(stale, one.manifest(stale), stale.schema)
    assert one.scan().count() == 2


def shop(spark, n, seed=3):
    """Products of Zipf-like words, one tenant with most of them."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    rows = [("big" if k % 5 else "small", f"P-{k}", " ".join(draw.choices(words, weights, k=draw.randint(1, 12))),
             " ".join(draw.choices(words, weights, k=draw.randint(0, 30))), draw.choice([None, "w7 brand"]), "")
            for k in range(n)]
    return rows, spark.createDataFrame(rows, "tenant string, sku string, title string, description string, "
                                             "brand string, attributes_text string")


def brute_force(rows, queries, k):
    tokens = {}
    for tenant, sku, *texts in rows:
        text = " ".join(t for t in (sku, *texts) if t)
        tokens[tenant, sku] = Counter(t for t in re.split(r"[\W_]+", text.lower()) if t)
    out = {}
    for qid, tenant, query in queries:
        own = {s: c for (t, s), c in tokens.items() if t == tenant}
        avgdl = sum(sum(c.values()) for c in own.values()) / len(own)
        scores = []
        for sku, counts in own.items():
            score = 0.0
            for term in set(re.split(r"[\W_]+", query.lower())):
                df = sum(1 for c in own.values() if term in c)
                tf, dl = counts[term], sum(counts.values())
                if tf:
                    score += math.log1p((len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (
                        tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
            if score:
                scores.append((-round(score, 9), sku))
        out[qid] = [s for _, s in sorted(scores)[:k]]
    return out


QUERIES = [("a", "big", "w90 w0 w1"), ("b", "big", "w50"), ("c", "small", "w7 w3 P 12"), ("d", "big", "nothing"),
           ("e", "small", "w0 w1 w2 w3 w4 w110"), ("f", "nobody", "w1"), ("g", "big", "w100 w0 w0")]


@pytest.mark.parametrize("k", [1, 10, 400])
def test_top_documents_are_exact(spark, tmp_path, k, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 16)
    rows, frame = shop(spark, 900)
    table = CatalogTable(spark, f"file://{tmp_path}/c", leaf_rows=150, indexed=True)
    table.upsert(frame.where("sku <> 'P-5'"))
    # What is written again is indexed again.
    table.upsert(frame.where("sku LIKE '%5'"))
    asked = spark.createDataFrame(QUERIES, "qid string, tenant string, query string")
    got = {}
    for r in text_index.top_documents(asked, table.index(), k).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["sku"])
    want = {q: s for q, s in brute_force(rows, [q for q in QUERIES if q[1] != "nobody"], k).items() if s}
    assert got == want


def test_few_pairs_are_scored(spark, tmp_path):
    rows, frame = shop(spark, 3000)
    table = CatalogTable(spark, f"file://{tmp_path}/c", leaf_rows=500, indexed=True)
    table.upsert(frame)
    asked = spark.createDataFrame(QUERIES[:1], "qid string, tenant string, query string")
    met = table.scan("big").where(F.arrays_overlap(word_tokens("title"), F.array(*map(F.lit, ("w0", "w1", "w90")))))
    assert text_index.candidates(asked, table.index(), 10).candidates.count() * 4 < met.count()


def test_search_over_the_catalog(spark, tmp_path):
    from shelfspark.functions.vectors import hashed_embedder

    rows, frame = shop(spark, 400)
    embedded = frame.withColumn("embedding", hashed_embedder()("title")).withColumn("price", F.lit(1.0))
    table = CatalogTable(spark, f"file://{tmp_path}/c", indexed=True)
    table.upsert(embedded)
    asked = spark.createDataFrame(QUERIES[:3], "qid string, tenant string, query string")
    docs = embedded.withColumn("text", search.searchable_text())
    want = search.search(asked, docs).select("qid", "rank", "sku").collect()
    found = search.search_catalog(asked, table)
    assert sorted(map(tuple, found.select("qid", "rank", "sku").collect())) == sorted(map(tuple, want))
