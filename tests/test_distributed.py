"""Distributed order statistics, limits and caches against brute force."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import answer_cache, embeddings, limits, pivot_index, quality, ranks, turns
from shelfspark.session import scratch_path
from shelfspark.streaming import runs, stateful


def test_exact_quantiles_on_large_skewed_groups(spark):
    rng = random.Random(3)
    rows = [("hot", float(int(rng.lognormvariate(3, 2)))) for _ in range(30_000)]
    rows += [("flat", 7.0)] * 9_000 + [("cold", float(i)) for i in range(7)] + [("none", None)] * 3
    rows += [("wide", rng.random()) for _ in range(12_000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = {"p25": .25, "p50": .5, "p95": .95, "p99": .99, "p0": 0.0, "p100": 1.0}
    got = {r.k: r for r in ranks.exact_quantiles(df, ["k"], F.col("v"), probs).collect()}
    for key in ("hot", "flat", "cold", "wide"):
        values = sorted(v for k, v in rows if k == key)
        for name, p in probs.items():
            assert got[key][name] == values[round(p * (len(values) - 1))], (key, name)
    assert got["none"].p50 is None and got["none"].null_count == 3
    whole = ranks.exact_quantiles(df, [], F.col("v"), {"m": .5}).first()
    values = sorted(v for _, v in rows if v is not None)
    assert whole.m == values[round(.5 * (len(values) - 1))]


def test_brackets_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BRACKET_ROWS", 20)
    rng = random.Random(9)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(40_000)]
    rows += [("ties", float(rng.randint(0, 3))) for _ in range(9_000)] + [("few", 1.5), ("few", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = {"p1": .01, "p50": .5, "p99": .99, "p100": 1.0}
    for frame, keys in ((df, ["k"]), (df.where("k = 'hot'").drop("k"), [])):
        for r in ranks.exact_quantiles(frame, keys, F.col("v"), probs).collect():
            key = r["k"] if keys else "hot"
            values = sorted(v for k, v in rows if k == key and v is not None)
            assert [r[n] for n in probs] == [values[round(p * (len(values) - 1))] for p in probs.values()]


def test_a_million_buckets_of_one_key(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("seq"))
    index = ranks.dense_index(df, ["k"], [F.col("seq")], F.col("seq"))
    assert index.where(F.col("index") != F.col("seq") / 3 + 1).count() == 0


def test_tool_rounds_count_over_hours(spark):
    rows = [("a", 0, f"2024-01-01 0{i // 3}:{10 * (i % 3)}:00", i) for i in range(7)] + [("b", 0, "1969-12-31 23:59:59", 9)]
    calls = spark.createDataFrame(rows, "conv_id string, turn long, ts string, event_id long").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    got = {r.event_id: (r["round"], r.force_no_tools) for r in turns.tool_rounds(calls).collect()}
    assert got == {i: (i + 1, i >= 1) for i in range(7)} | {9: (1, False)}


def test_running_and_dense_index(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, rng.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, seq long, x int").repartition(5)
    for inclusive in (True, False):
        out = ranks.running(df, ["k"], [F.col("seq")], F.floor(F.col("seq") / 37),
                            {"total": F.col("x")}, {"top": F.col("x")}, inclusive)
        got = {r.seq: (r.total, r.top) for r in out.collect()}
        seen = {"a": [], "b": []}
        for k, seq, x in rows:
            if inclusive:
                seen[k].append(x)
            expected = (sum(seen[k]), max(seen[k])) if seen[k] else (None, None)
            assert got[seq] == expected
            if not inclusive:
                seen[k].append(x)
    index = ranks.dense_index(df, [], [F.col("seq")], F.floor(F.col("seq") / 50))
    assert all(r["index"] == r.seq + 1 for r in index.collect())


@pytest.mark.parametrize("n", [1, 3, 20, 97, 100, 150])
def test_even_sample(spark, n):
    df = spark.range(100).select(F.lit("t").alias("t"), F.col("id").alias("seq"))
    got = sorted(r.seq for r in quality.even_sample(
        df, n, ["t"], "seq", F.floor(F.col("seq") / 9)).collect())
    step = 100 / n
    assert got == (list(range(100)) if n >= 100 else sorted({int(i * step) for i in range(n)}))


def test_number_rows(spark):
    scan = spark.range(1000).repartition(6).withColumn("feed_seq", F.monotonically_increasing_id())
    fixed = spark.createDataFrame(scan.toPandas())
    numbered = ranks.number_rows(fixed).orderBy("feed_seq").collect()
    assert [r.row_number for r in numbered] == list(range(1, 1001))


def brute_windows(rows, limit, width):
    out, state = {}, {}
    for key, request, us in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start, count = state.get(key, (None, 0))
        if start is None or us >= start + width:
            start, count = us, 0
        count += 1
        state[key] = (start, count)
        out[request] = (start, count, count <= limit)
    return out


@pytest.mark.parametrize("chunk_windows", [1, 2, 7, 1000])
def test_rate_limit(spark, chunk_windows):
    rng = random.Random(chunk_windows)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 60)}"
        rows.append((key, i, rng.randint(0, 4_000) * 1_000_000 + rng.choice([0, 0, 1, 500_000])))
    df = spark.createDataFrame(rows, "key string, request_id long, us long").withColumn(
        "ts", F.timestamp_micros("us")).drop("us")
    out = limits.rate_limit(df, 3, 60, chunk_windows, key_buckets=3).select(
        "request_id", F.unix_micros("window_start").alias("s"), "count", "allowed").collect()
    assert {r.request_id: (r.s, r["count"], r.allowed) for r in out} == brute_windows(
        rows, 3, 60_000_000)


def brute_cache(events, threshold, ring, ttl, replay=False):
    held, stored, hits = {}, {}, {}
    for tenant, us, kind, id_, v in sorted(events, key=lambda e: (e[1], e[2], e[3])):
        entries = held.setdefault(tenant, [])
        if tenant in stored and us - stored[tenant] >= ttl:
            entries.clear()
        if kind == 1:
            entries.clear()
        elif kind == 2:
            entries.append((id_, v))
            del entries[:-ring]
            stored[tenant] = us
        else:
            scored = [(round(float(np.dot(v, w)), 9), i) for i, (_, w) in enumerate(entries)]
            if scored and max(scored)[0] >= threshold:
                hits[id_] = entries[max(scored)[1]][0]
            elif replay:
                entries.append((id_, v))
                del entries[:-ring]
                stored[tenant] = us
    return hits


def cache_events(seed, n=600):
    rng, events = random.Random(seed), []
    pool = [np.array([np.cos(a), np.sin(a)]) for a in np.linspace(0, 3, 12)]
    us = 0
    for i in range(n):
        us += int(rng.expovariate(1 / 5e9)) + 1
        if rng.random() < .02:
            us += 90_000_000_000
        events.append((rng.choice(["hot", "hot", "b"]), us, rng.choice([0, 0, 2, 2, 2, 1] if i % 25
                       == 0 else [0, 2]), f"{i:05d}", rng.choice(pool)))
    return events


@pytest.mark.parametrize("seed", [1, 2])
def test_answer_cache_batch_and_stream(spark, seed):
    events = cache_events(seed)
    expected = brute_cache(events, .95, 10, 80_000_000_000)
    assert expected
    frame = spark.createDataFrame(
        [(t, us, k, i, v.tolist()) for t, us, k, i, v in events],
        "tenant string, us long, kind int, id string, embedding array<double>").withColumn(
        "ts", F.timestamp_micros("us")).drop("us")
    stores = frame.where("kind = 2").withColumnRenamed("id", "store_id")
    asked = frame.where("kind = 0").withColumnRenamed("id", "qid")
    batch = answer_cache.cache_lookup(stores, asked, frame.where("kind = 1"), .95, 10, 80_000)
    assert {r.qid: r.store_id for r in batch.collect()} == expected
    path = scratch_path(spark, "cache-test")
    frame.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(frame.schema).parquet(path)
    hits = runs.drain(stateful.answer_cache_stream(stream, threshold=.95, ring=10,
                                                   ttl_seconds=80_000), "cache-test")
    assert {r.qid: r.store_id for r in hits.collect()} == expected
    asked = [e for e in events if e[2] < 2]
    replayed = runs.drain(stateful.answer_cache_stream(
        stream.where("kind < 2"), threshold=.95, ring=10, ttl_seconds=80_000, replay=True), "replay")
    assert {r.qid: r.store_id for r in replayed.collect()} == brute_cache(
        asked, .95, 10, 80_000_000_000, True)


def test_state_of_dead_keys_ends(spark, tmp_path):
    # Four days of requests, every key on one day only; a file a day is a batch.
    rows = [(f"k{d}-{k % 50}", d * 1000 + k, ((d + 1) * 86_400 + k * 60) * 1_000_000) for d in range(4) for k in range(200)]
    frame = spark.createDataFrame(rows, "key string, request_id long, us long").select(
        "key", "request_id", F.timestamp_micros("us").alias("ts"))
    seen = set()
    for d in range(4):
        frame.where(f"request_id div 1000 = {d}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # The source takes files in the order of their times.
        for path in set((tmp_path / "in").glob("*.parquet")) - seen:
            os.utime(path, (1_700_000_000 + 60 * d,) * 2)
            seen.add(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    held = {}
    for name, lateness in (("ends", "1 hour"), ("stays", None)):
        query = (stateful.rate_limit_stream(stream, 3, 600, lateness).writeStream.format("memory").queryName(name)
                 .option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start())
        query.awaitTermination()
        held[name] = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:])
    assert held["ends"] < held["stays"]
    answers = [sorted((r.request_id, r["count"], r.allowed) for r in spark.table(n).collect()) for n in held]
    assert answers[0] == answers[1] and len(answers[0]) == 800


@pytest.mark.parametrize("chunk_rows", [7, 40, 10_000])
def test_parallel_replay_equals_the_sequential_one(spark, chunk_rows):
    events = cache_events(3, 400)
    frame = spark.createDataFrame(
        [(t, us, k, i, v.tolist()) for t, us, k, i, v in events],
        "tenant string, us long, kind int, id string, embedding array<double>").withColumn(
        "ts", F.timestamp_micros("us")).drop("us")
    found = answer_cache.replay(frame, .95, 10, 80_000, chunk_rows)
    assert {r.qid: r.store_id for r in found.hits.collect()} == brute_cache(events, .95, 10, 80_000_000_000, True)
    # A guess is mended from what a few chunks before it left.
    assert len(found.rounds) <= 12 and sum(found.rounds[1:]) <= 4 * found.rounds[0]
    assert answer_cache.replay(frame.limit(0)).hits.count() == 0


def test_pivot_index_is_exact_and_skips_blocks(spark):
    rng = np.random.default_rng(2)
    centres = 6 * rng.normal(size=(20, 8))
    corpus = (centres[rng.integers(0, 20, 1500)] + .3 * rng.normal(size=(1500, 8))).astype("float32")
    corpus[700:800] = corpus[700]
    tenants = ["big" if k % 6 else "small" for k in range(1500)]
    rows = spark.createDataFrame([(t, f"{k:05d}", v.tolist()) for k, (t, v) in enumerate(zip(tenants, corpus))],
                                 "tenant string, id string, v array<float>")
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "qid")
    index = pivot_index.build(rows, pivots=24, block_rows=60)
    found = pivot_index.nearest(asked, index, 7)
    want = embeddings.knn_topk(asked, rows, 7)
    columns = ["tenant", "qid", "id", "rank"]
    assert sorted(map(tuple, found.hits.select(*columns).collect())) == sorted(
        map(tuple, want.select(*columns).collect()))
    assert pivot_index.skipped(found).first()["skipped"] > 0.3


def test_nearest_stores_no_pairs_of_query_and_block(spark, monkeypatch):
    """Copies tie over many blocks; blocks and queries fill several packs."""
    rng = np.random.default_rng(4)
    corpus = rng.normal(size=(600, 6)).astype("float32")
    corpus[100:300] = corpus[100]
    rows = spark.createDataFrame([("t" if k % 5 else "few", f"{k:04d}", v.tolist()) for k, v in enumerate(corpus)]
                                 + [("one", "x", [1.0] * 6)], "tenant string, id string, v array<float>")
    asked = rows.withColumnRenamed("id", "qid")
    for name, value in (("HEADS", 3), ("BUNDLE_ROWS", 90), ("QUERY_ROWS", 40)):
        monkeypatch.setattr(pivot_index, name, value, raising=False)
    monkeypatch.setattr(pivot_index, "bounds", None)
    hits = pivot_index.nearest(asked, pivot_index.build(rows, pivots=8, block_rows=30), 4).hits
    want = embeddings.knn_topk(asked, rows, 4)
    columns = ["tenant", "qid", "id", "rank"]
    assert sorted(map(tuple, hits.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    corpus = rng.normal(size=(700, 8)).astype("float32")
    corpus[5] = corpus[6]
    asked = corpus[:40]
    rows = [("a" if i % 3 else "b", f"d{i:04d}", v.tolist()) for i, v in enumerate(corpus)]
    frame = spark.createDataFrame(rows, "tenant string, id string, v array<float>").repartition(5)
    queries = spark.createDataFrame(
        [("a" if i % 3 else "b", f"d{i:04d}", v.tolist()) for i, v in enumerate(asked)],
        "tenant string, qid string, v array<float>")
    for own in (False, True):
        got = {}
        for r in embeddings.knn_topk(queries, frame, 4, exclude_self=own).collect():
            got.setdefault(r.qid, {})[r["rank"]] = r.id
        for i, v in enumerate(asked):
            scores = sorted((-round(float(v.astype("float64") @ np.array(w, "float64")), 9), d)
                            for t, d, w in rows if t == rows[i][0] and not (own and d == rows[i][1]))
            assert [got[rows[i][1]][k] for k in (1, 2, 3, 4)] == [d for _, d in scores[:4]]


def test_similarity_means_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 5))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    groups = [["x", "y", "z", None, "lone"][i % 4 if i else 4] for i in range(60)]
    frame = spark.createDataFrame(
        [(i, groups[i], v.tolist()) for i, v in enumerate(vectors)],
        "id int, grp string, embedding array<double>").repartition(4)
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60)]
    mean = np.mean([vectors[i] @ vectors[j] for i, j in pairs])
    assert embeddings.pairwise_similarity(frame).first().mean_similarity == pytest.approx(mean)
    kept = [(i, j) for i, j in pairs if groups[i] in ("x", "y", "z") and groups[j] in ("x", "y", "z")]
    within = [vectors[i] @ vectors[j] for i, j in kept if groups[i] == groups[j]]
    across = [vectors[i] @ vectors[j] for i, j in kept if groups[i] != groups[j]]
    got = embeddings.group_contrast(frame, F.col("grp")).first()
    assert (got.groups_compared, got.n_within_pairs, got.n_across_pairs) == (
        3, len(within), len(across))
    assert got.within_mean == pytest.approx(np.mean(within))
    assert got.across_mean == pytest.approx(np.mean(across))
    assert embeddings.group_contrast(frame.where("grp = 'x'"), F.col("grp")).count() == 0
    assert embeddings.pairwise_similarity(frame.limit(1)).first().mean_similarity == 0.0


def test_grubbs(spark):
    def flagged(rates):
        return {r.tenant for r in quality.duplicate_outliers(spark.createDataFrame(
            pd.DataFrame(list(rates.items()), columns=["tenant", "rate"]))).collect()}

    assert flagged({"a": .3, "b": .1}) == {"a"}
    assert flagged({"a": .1, "b": .1, "c": .1}) == set()
    assert flagged({"a": .1, "b": .1, "c": .4}) == {"c"}
    assert flagged({**{f"p{i}": .01 + i / 1000 for i in range(10)}, "bad": .9}) == {"bad"}


def test_large_slices_keep_several_files_beside_a_small_one(spark):
    from shelfspark.plans import stream_queries

    frame = spark.range(1000)
    slices = [frame.where("id < 998"), frame.where("id = -1"), frame.where("id >= 998")]
    stream = stream_queries._stream(spark, slices, "uneven")
    found = {}

    def note(batch, number):
        rows = batch.select("id", F.input_file_name().alias("file")).collect()
        found[number] = ({r["id"] for r in rows}, len({r["file"] for r in rows}))

    (stream.writeStream.foreachBatch(note).option("checkpointLocation", scratch_path(spark, "uneven-state"))
     .trigger(availableNow=True).start().awaitTermination())
    assert [ids for _, (ids, _) in sorted(found.items()) if ids] == [{*range(998)}, {998, 999}]
    assert found[0][1] == stream_queries.SLICE_FILES


def test_neighbours_of_equal_score_go_by_id_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "QUERY_BLOCK_ROWS", 5)
    ids = [f"{(i * 37) % 60:02d}" for i in range(60)]
    rows = spark.createDataFrame([("t", i, [1.0, 0.0] if int(i) % 3 else [0.0, 1.0]) for i in ids],
                                 "tenant string, id string, v array<float>").coalesce(1)
    asked = spark.createDataFrame([("t", "q", [1.0, 0.0])], "tenant string, qid string, v array<float>")
    found = embeddings.knn_topk(asked, rows, 4).orderBy("rank").collect()
    assert [r["id"] for r in found] == ["01", "02", "04", "05"]


def test_replayed_stream_carries_caches_between_batches(spark, tmp_path):
    """Batches of a tenant's log go through several tasks and give what one sequential replay gives."""
    events = sorted(cache_events(5, 300), key=lambda e: e[1])
    for part in range(3):
        spark.createDataFrame([(t, us, k, i, v.tolist()) for t, us, k, i, v in events[part * 100:part * 100 + 100]
                               if part != 1 or t != "b"],
                              "tenant string, us long, kind int, id string, embedding array<double>").withColumn(
            "ts", F.timestamp_micros("us")).drop("us").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for path in (tmp_path / "in").glob("*.parquet"):
            if path.stat().st_mtime > 1_700_001_000:
                os.utime(path, (1_700_000_000 + 60 * part,) * 2)
    kept = [e for n, e in enumerate(events) if not (100 <= n < 200 and e[0] == "b")]
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for stored in (True, False):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        hits = runs.replay_stream(stream, "replay", threshold=.95, ring=10, ttl_seconds=80_000, chunk_rows=16,
                                  misses_stored=stored)
        assert {r.qid: r.store_id for r in hits.collect()} == brute_cache(kept, .95, 10, 80_000_000_000, stored)

