"""Shards of equal bytes: order, sizes, places."""

import zlib

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import byte_shards as bs


def check(found, rows, shards, tolerance):
    """Every row once, in key order, gapless places, and sizes near equal."""
    sizes = [0] * shards
    places = [[] for _ in range(shards)]
    spans = [[] for _ in range(shards)]
    for r in found:
        sizes[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        spans[r["shard"]].append((r["slot"], float("-inf") if r["doc_id"] is None else r["doc_id"]))
    assert len(found) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(sorted(p) == list(range(len(p))) for p in places)
    in_order = [d for s in spans for _, d in sorted(s)]
    assert in_order == sorted(in_order)
    if rows:
        mean, largest = sum(sizes) / shards, max(len((t or "").encode()) + 1 for _, t in rows)
        assert all(abs(s - mean) <= 2 * tolerance * mean + largest for s in sizes)


CASES = {
    "even": [(i, "word " * (i % 37)) for i in range(3000)],
    "outlier ids": [(i, "x" * (i % 11)) for i in range(900)] + [(2**62, "far"), (-2**61, "low")],
    "one id": [(5, f"text {k}") for k in range(600)],
    "copies of one row": [(5, "same text")] * 500 + [(i, "other") for i in range(500)],
    "very long text": [(i, "short") for i in range(300)] + [(150, "long " * 20_000)],
    "null ids and texts": [(None, None), (None, ""), (1, None), (2, "é" * 9)] * 40,
    "few": [(1, "a"), (2, "b")],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_report(spark, documents, name):
    rows = CASES[name]
    frame = documents(rows, ["size", "shard", "slot", "__key", "__row", "law"]).repartition(5)
    found = bs.shard_report(frame)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = found.collect()
    assert {(r["law"], r["grown_shard"]) for r in found} <= {("bytes", None)}
    check(found, rows, bs.SHARDS, bs.TOLERANCE)


def test_small_pieces_keep_the_places(spark, documents):
    rows = CASES["even"]
    report = bs.shard_rows(documents(rows).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")),
        "doc_id", "size", F.lit(0), shards=4, piece_rows=20)
    check(report.collect(), rows, 4, bs.TOLERANCE)


def test_probes_are_refined(spark, documents):
    keyed = documents([(i * i * i, "x" * (i % 90)) for i in range(4000)]).select(
        F.col("doc_id"), F.lit(0).cast("long"), F.monotonically_increasing_id(),
        (F.length("text") + 1).cast("long").alias("size"))
    found = bs.find_splitters(keyed, "size", 16, 1, tolerance=1e-4, probes=64)
    assert 2 <= found.rounds <= 40
    assert found.edges == sorted(found.edges) and len(found.rows_below) == 16


def test_documents_and_files(spark, documents, tmp_path):
    rows = CASES["even"][:400]
    placed = bs.shard_documents(documents(rows, ["__size", "shard"]), shards=4)
    assert {"text", "lang", "__size"} <= set(placed.columns)
    path = str(tmp_path / "shards")
    bs.write_shards(placed, path)
    back = spark.read.parquet(path)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted(rows)
    assert sorted(r["shard"] for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]
