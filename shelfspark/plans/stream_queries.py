"""Streaming forms, run over what the tables hold now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.usage import with_cost
from shelfspark.operators import answer_cache
from shelfspark.plans import answer_queries as aq
from shelfspark.plans import feed_queries as fq
from shelfspark.plans import standins as st
from shelfspark.plans import telemetry_queries as tq
from shelfspark.plans.registry import register, table
from shelfspark.plans.shapes import plain
from shelfspark.session import scratch_path
from shelfspark.sources.catalog import CatalogTable
from shelfspark.streaming import runs, stateful, windows


SLICE_FILES = 4


def _stream(spark: SparkSession, slices: list[DataFrame], name: str) -> DataFrame:
    """A stream with one micro-batch for each slice, every slice spread over several files."""
    path = scratch_path(spark, name)
    schema = slices[0].schema
    nothing = spark.createDataFrame([], schema).coalesce(1)
    expected = 0
    for rows in slices:
        rows.repartition(SLICE_FILES).write.mode("append").parquet(path)
        expected += SLICE_FILES
        # A slice of few rows leaves files out; empty ones keep the next slice from its batch.
        for _ in range(expected - len(spark.read.schema(schema).parquet(path).inputFiles())):
            nothing.write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(path)


def _sliced(frame: DataFrame, order: str, cuts: list[str]) -> list[DataFrame]:
    """The rows between neighbouring cuts of their order."""
    at = [F.lit(c).cast(frame.schema[order].dataType) for c in cuts]
    edges = [None, *at, None]
    return [frame.where((F.lit(True) if low is None else F.col(order) >= low)
                        & (F.lit(True) if high is None else F.col(order) < high))
            for low, high in zip(edges, edges[1:])]


def _closing(frame: DataFrame, time: str) -> DataFrame:
    """A last slice: every first row again, which comes too late, and the last one ten years on,
    which closes all windows before it and leaves its own open."""
    first, last = frame.agg(F.min(time), F.max(time)).first()
    return frame.where(F.col(time) == F.lit(first)).unionByName(
        frame.where(F.col(time) == F.lit(last)).withColumn(
            time, F.expr(f"`{time}` + INTERVAL 10 YEARS").cast(frame.schema[time].dataType)))


CUTS = ["2024-01-10 00:00:00", "2024-01-20 00:00:00"]


@register("stream_usage", f"""WITH {st.USAGE_SQL}
SELECT epoch_us(date_trunc('day', created_at)) AS window_start, model, count(*) AS calls, {tq.SUMS},
  round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd FROM usage GROUP BY 1, 2""")
def stream_usage(spark, sf):
    usage = st.usage(spark, sf)
    slices = [*_sliced(usage, "created_at", CUTS), _closing(usage, "created_at")]
    rows = _stream(spark, slices, "usage-in")
    return plain(runs.drain(windows.stream_usage(with_cost(rows)), "usage"))


@register("stream_latency", f"""WITH {tq.HIST_SQL.replace(
    "date_trunc('minute', ts) AS m", "date_trunc('minute', ts) AS m, ts")}
SELECT stage, epoch_us("at") AS "at", n, round({tq._interpolated(0.5)}, 6) AS p50,
  round({tq._interpolated(0.95)}, 6) AS p95, round({tq._interpolated(0.99)}, 6) AS p99
FROM totals""")
def stream_latency(spark, sf):
    samples = tq._samples(spark, sf)
    rows = _stream(spark, [*_sliced(samples, "ts", CUTS), _closing(samples, "ts")], "latency-in")
    out = windows.stream_latency(rows, ["stage"], "seconds")
    return plain(runs.drain(out, "latency"))


@register("stream_rate_limit", f"""WITH {tq.LIMIT_SQL.format(width=21600000000)}
SELECT key, event_id AS request_id, start AS window_start, count, count <= 4 AS allowed,
  CASE WHEN count <= 4 THEN 0 ELSE CAST(ceil((start + 21600000000 - us) / 1000000.0) AS BIGINT) END
    AS retry_after FROM counted""")
def stream_rate_limit(spark, sf):
    rows = _stream(spark, _sliced(tq.requests(spark, sf), "ts", CUTS), "requests")
    return plain(runs.drain(stateful.rate_limit_stream(rows, 4, 21600), "limits").drop("ts"))


@register("stream_answer_cache", f"""WITH {aq.CACHE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, idx DESC) AS rn FROM cand
  WHERE sim >= 0.2)
SELECT tenant, lpad(CAST(qid AS VARCHAR), 12, '0') AS qid, lpad(CAST(sid AS VARCHAR), 12, '0')
  AS store_id, round(sim, 6) AS similarity FROM r WHERE rn = 1""")
def stream_answer_cache(spark, sf):
    return plain(runs.replay_stream(_cache_stream(spark, sf), "cache", threshold=0.2, ring=30,
                                    ttl_seconds=4 * 3600, misses_stored=False))


def _cache_events(spark, sf):
    stores, asked, cleared = aq.cache_logs(spark, sf)
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    return stores.select("tenant", F.lit(2).alias("kind"), F.col("store_id").alias("id"), "ts",
                         vector).unionByName(
        asked.select("tenant", F.lit(0).alias("kind"), F.col("qid").alias("id"), "ts", vector)
    ).unionByName(cleared.select(
        "tenant", F.lit(1).alias("kind"), F.lit("").alias("id"), "ts",
        F.array().cast("array<double>").alias("embedding")))


def _cache_stream(spark, sf):
    events = _cache_events(spark, sf)
    return _stream(spark, _sliced(events, "ts", ["2132-01-25 00:00:00", "2132-02-10 00:00:00"]), "cache-in")


#: One step for each event of a tenant: what has expired goes, a query looks up the newest best entry,
#: answers and queries that missed are stored.
REPLAY_SQL = f"""WITH RECURSIVE {aq.CACHE_SQL},
log AS (SELECT tenant, us, kind, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, embedding::DOUBLE[] AS e,
    row_number() OVER (PARTITION BY tenant ORDER BY us, kind, event_id) AS n FROM ev),
steps(tenant, n, ring, stored, qid, hit) AS (
  SELECT DISTINCT tenant, 0::BIGINT, []::STRUCT(id VARCHAR, e DOUBLE[])[], NULL::BIGINT, NULL::VARCHAR,
    NULL::STRUCT(id VARCHAR, s DOUBLE) FROM log
  UNION ALL
  SELECT tenant, n,
    CASE WHEN kind = 1 THEN [] WHEN kind = 2 OR hit IS NULL THEN list_append(held, {{'id': id, 'e': e}})[-30:]
      ELSE held END,
    CASE WHEN kind = 1 THEN NULL WHEN kind = 2 OR hit IS NULL THEN us ELSE kept END,
    CASE WHEN kind = 0 THEN id END, hit
  FROM (SELECT *, CASE WHEN kind = 0 THEN list_reduce(list_prepend(NULL, list_filter(list_transform(held,
        lambda r: {{'id': r.id, 's': round(list_dot_product(r.e, e), 9)}}), lambda r: r.s >= 0.2)),
        lambda a, b: CASE WHEN a IS NULL OR b.s >= a.s THEN b ELSE a END) END AS hit
    FROM (SELECT l.*, CASE WHEN l.us - stored >= 14400000000 THEN [] ELSE ring END AS held,
        CASE WHEN l.us - stored >= 14400000000 THEN NULL ELSE stored END AS kept
      FROM steps s JOIN log l ON l.tenant = s.tenant AND l.n = s.n + 1)))
SELECT tenant, qid, hit.id AS store_id, round(hit.s, 6) AS similarity FROM steps WHERE hit IS NOT NULL"""


@register("semantic_cache", REPLAY_SQL)
def semantic_cache(spark, sf):
    """What-if replay: a query that misses is stored, a hit suppresses its store.

    Each answer depends on all before it; a tenant's log is still replayed by many tasks.
    """
    found = answer_cache.replay(_cache_events(spark, sf), threshold=0.2, ring=30, ttl_seconds=4 * 3600)
    return plain(found.hits)


@register("stream_semantic_cache", REPLAY_SQL)
def stream_semantic_cache(spark, sf):
    """The same replay as a stream, in the order of events."""
    return plain(runs.replay_stream(_cache_stream(spark, sf), "replay", threshold=0.2, ring=30,
                                    ttl_seconds=4 * 3600))


@register("stream_conversation_state", """
SELECT conv_id, turn, count(*) OVER w AS n_messages,
  count(*) FILTER (role = 'user') OVER w AS n_user,
  CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def stream_conversation_state(spark, sf):
    messages = table(spark, sf, "conversations")
    rows = _stream(spark, _sliced(messages, "turn", ["2", "4"]), "messages")
    return plain(runs.drain(stateful.conversation_stream(rows), "conversations"))


@register("incremental_ingest", f"""{fq.MAPPED_SQL}
SELECT tenant, sku, title, round(price, 6) AS price, brand FROM deduped""")
def incremental_ingest(spark, sf):
    """The messy feed as two micro-batches into a stored catalog."""
    feed = _stream(spark, _sliced(st.messy_feed(spark, sf), "feed_seq", ["1000000000"]), "feed")
    store = CatalogTable(spark, scratch_path(spark, "catalog"), buckets=4)
    runs.incremental_ingest(feed, store, scratch_path(spark, "ledger"),
                            scratch_path(spark, "ingest-state"), mapping=fq.MAPPING)
    return plain(store.scan().select("tenant", "sku", "title", "price", "brand"))
