"""Usage, latency, counters and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.usage import with_cost
from shelfspark.operators import limits
from shelfspark.operators import telemetry as tel
from shelfspark.plans import standins as st
from shelfspark.plans.registry import register, table
from shelfspark.plans.shapes import plain
from shelfspark.session import scratch_path

U_SQL = f"WITH {st.USAGE_SQL}"


def usage(spark, sf):
    return with_cost(st.usage(spark, sf))


@register("estimate_cost", f"""{U_SQL}
SELECT event_id, round(CAST(cost_usd * 1000000 AS DOUBLE), 2) AS micro_usd FROM usage""")
def estimate_cost(spark, sf):
    return usage(spark, sf).select("event_id", F.round(
        (F.col("cost_usd") * 1000000).cast("double"), 2).alias("micro_usd"))


@register("sink_usage_ledger", f"""{U_SQL}
SELECT merchant, count(*) AS n, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd FROM usage
GROUP BY 1""")
def sink_usage_ledger(spark, sf):
    path = scratch_path(spark, "usage")
    usage(spark, sf).write.mode("append").partitionBy("merchant").parquet(path)
    return plain(spark.read.parquet(path).withColumn(
        "merchant", F.col("merchant").cast("string")).groupBy("merchant").agg(
        F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd")))


@register("filter_time_range", f"""{U_SQL}
SELECT event_id FROM usage WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00'
  AND created_at < TIMESTAMP '2024-01-12 12:00:00'""")
def filter_time_range(spark, sf):
    return tel.in_time_range(usage(spark, sf), "2024-01-05 00:00:00", "2024-01-12 12:00:00"
                             ).select("event_id")


SUMS = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in tel.TOKENS)


@register("agg_usage_by_model", f"""{U_SQL}
SELECT merchant, CASE WHEN grouping(model) = 1 THEN 'TOTAL' ELSE model END AS model,
  count(*) AS calls, {SUMS}, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd
FROM usage GROUP BY GROUPING SETS ((merchant, model), (merchant))""")
def agg_usage_by_model(spark, sf):
    return plain(tel.usage_by_model(usage(spark, sf)))


@register("agg_spend_daily", f"""{U_SQL}
SELECT epoch_us(date_trunc('day', created_at)) AS day, model,
  round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd FROM usage GROUP BY 1, 2""")
def agg_spend_daily(spark, sf):
    return plain(tel.spend_daily(usage(spark, sf)))


@register("agg_spend_total", f"""{U_SQL}
SELECT coalesce(round(CAST(sum(cost_usd) AS DOUBLE), 6), 0) AS value FROM usage""")
def agg_spend_total(spark, sf):
    return plain(tel.spend_total(usage(spark, sf)))


@register("agg_tokens_total", f"""{U_SQL}
SELECT model, {SUMS}, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd FROM usage GROUP BY 1""")
def agg_tokens_total(spark, sf):
    return plain(tel.tokens_total(usage(spark, sf)))


@register("agg_counters", """
SELECT event_type, user_id % 2 = 0 AS cache_hit, count(*) AS total FROM events GROUP BY 1, 2""")
def agg_counters(spark, sf):
    events = table(spark, sf, "events").withColumn("cache_hit", F.col("user_id") % 2 == 0)
    return tel.counters(events, ["event_type", "cache_hit"])


@register("agg_counters_tokens", f"""{U_SQL}, t AS (
  SELECT model, 'input' AS token_type, input_tokens AS n FROM usage
  UNION ALL SELECT model, 'output', output_tokens FROM usage
  UNION ALL SELECT model, 'cached', cache_read_tokens FROM usage)
SELECT model, token_type, CAST(sum(n) AS BIGINT) AS total FROM t GROUP BY 1, 2""")
def agg_counters_tokens(spark, sf):
    long = st.usage(spark, sf).select("model", F.inline(F.array(
        F.struct(F.lit("input").alias("token_type"), F.col("input_tokens").alias("n")),
        F.struct(F.lit("output").alias("token_type"), F.col("output_tokens").alias("n")),
        F.struct(F.lit("cached").alias("token_type"), F.col("cache_read_tokens").alias("n")))))
    return tel.counters(long, ["model", "token_type"], F.col("n"))


PERCENTILES_SQL = """r AS (SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key}
    ORDER BY {value}) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
  p AS (SELECT k, max(n) AS n, avg(v) AS mean,
    max(CASE WHEN rn = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) THEN v END) AS p50,
    max(CASE WHEN rn = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) THEN v END) AS p95,
    max(CASE WHEN rn = CAST(round_even(0.99 * (n - 1), 0) AS BIGINT) THEN v END) AS p99,
    max(CASE WHEN rn = n // 2 THEN v END) AS upper_median FROM r GROUP BY 1)"""
EVENTS_P = PERCENTILES_SQL.format(key="event_type", value="value", source="events")
LINES_P = PERCENTILES_SQL.format(key="l_linestatus", value="l_extendedprice", source="lineitem")


@register("agg_latency_percentiles", f"""WITH {EVENTS_P}
SELECT k AS event_type, n, round(mean, 4) AS mean, p50, p95, p99 FROM p""")
def agg_latency_percentiles(spark, sf):
    out = tel.latency_percentiles(table(spark, sf, "events"), ["event_type"], "value")
    return plain(out.withColumn("mean", F.round("mean", 4)))


@register("agg_latency_percentiles_lines", f"""WITH {LINES_P}
SELECT k AS l_linestatus, n, round(mean, 3) AS mean, round(p50, 6) AS p50, round(p95, 6) AS p95,
  round(p99, 6) AS p99 FROM p""")
def agg_latency_percentiles_lines(spark, sf):
    out = tel.latency_percentiles(table(spark, sf, "lineitem"), ["l_linestatus"],
                                  "l_extendedprice")
    return plain(out.withColumn("mean", F.round("mean", 3)))


@register("agg_p50_upper", f"""WITH {EVENTS_P}
SELECT k AS event_type, n, upper_median AS p50 FROM p""")
def agg_p50_upper(spark, sf):
    return plain(tel.upper_median(table(spark, sf, "events"), ["event_type"], "value"))


@register("agg_throughput", """
SELECT event_type, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9)
  AS per_second FROM events GROUP BY 1""")
def agg_throughput(spark, sf):
    out = tel.throughput(table(spark, sf, "events"), ["event_type"])
    return out.select("event_type", "n", F.round("per_second", 9).alias("per_second"))


# --- windows and alerts; latency in seconds is value / 10 ------------------------------

def _samples(spark, sf):
    return table(spark, sf, "events").select(
        "ts", F.col("event_type").alias("stage"), (F.col("value") / 10).alias("seconds"))


def _bounds_sql(bounds) -> str:
    return "(VALUES " + ", ".join(f"({i}, CAST({b} AS DOUBLE))" for i, b in enumerate(bounds)) + \
        ") b(i, le)"


@register("hist_buckets", f"""
SELECT event_type AS stage, le, count(*) FILTER (value / 10 <= le) AS n
FROM events, {_bounds_sql(tel.SEARCH_BOUNDS)} GROUP BY 1, 2
UNION ALL SELECT event_type, 99999.0::DOUBLE, count(*) FROM events GROUP BY 1""")
def hist_buckets(spark, sf):
    out = tel.hist_buckets(_samples(spark, sf), ["stage"], "seconds")
    return plain(out.withColumn("le", F.when(F.col("le") > 1e9, 99999.0).otherwise(F.col("le"))))


def _slots_sql(minutes: int) -> str:
    return f"range(1, {minutes + 1}) s(j)"


CHAT = tel.CHAT_BOUNDS
CASES = " ".join(f"WHEN seconds <= {b} THEN {i}" for i, b in enumerate(CHAT))
HIST_SQL = f"""samples AS (SELECT event_type AS stage, date_trunc('minute', ts) AS m,
    value / 10 AS seconds FROM events),
  spread AS (SELECT stage, m + to_minutes(CAST(j AS BIGINT)) AS "at", CASE {CASES} ELSE {len(CHAT)}
    END AS b FROM samples, {_slots_sql(5)}),
  totals AS (SELECT stage, "at", count(*) AS n,
    {', '.join(f'count(*) FILTER (b <= {i}) AS c{i}' for i in range(len(CHAT)))}
    FROM spread GROUP BY 1, 2)"""


def _interpolated(p: float) -> str:
    cases = []
    for i, bound in enumerate(CHAT):
        low = CHAT[i - 1] if i else 0.0
        below = f"c{i - 1}" if i else "0"
        cases.append(f"WHEN c{i} >= {p} * n THEN {low} + ({bound} - {low}) * "
                     f"(CAST({p} * n AS DOUBLE) - {below}) / (c{i} - {below})")
    return f"CAST(CASE {' '.join(cases)} ELSE {CHAT[-1]} END AS DOUBLE)"


@register("hist_quantile", f"""WITH {HIST_SQL}
SELECT stage, epoch_us("at") AS "at", n, round({_interpolated(0.5)}, 6) AS p50,
  round({_interpolated(0.95)}, 6) AS p95, round({_interpolated(0.99)}, 6) AS p99 FROM totals""")
def hist_quantile(spark, sf):
    return plain(tel.hist_quantile(_samples(spark, sf), ["stage"], "seconds"))


@register("rate_by_labels", f"""
SELECT event_type, user_id % 2 AS shard, epoch_us(date_trunc('minute', ts)
  + to_minutes(CAST(j AS BIGINT))) AS at, round(count(*) / 300.0, 6) AS per_second
FROM events, {_slots_sql(5)} GROUP BY ALL""")
def rate_by_labels(spark, sf):
    events = table(spark, sf, "events").withColumn("shard", F.col("user_id") % 2)
    return plain(tel.rate_by_labels(events, ["event_type", "shard"]))


def _sustained_sql(source: str, keys: str, breach: str, minutes: int) -> str:
    return f"""b AS (SELECT *, coalesce({breach}, false) AS breach FROM {source}),
    g AS (SELECT *, NOT breach OR NOT coalesce(lag(breach) OVER w, false)
      OR epoch_us("at") - epoch_us(lag("at") OVER w) > 60000000 AS edge FROM b
      WINDOW w AS (PARTITION BY {keys} ORDER BY "at")),
    h AS (SELECT *, max(CASE WHEN edge THEN "at" END) OVER (PARTITION BY {keys} ORDER BY "at") AS since
      FROM g)
    SELECT {keys}, epoch_us("at") AS "at", CASE WHEN NOT breach THEN 'normal'
      WHEN epoch_us("at") - epoch_us(since) >= {minutes} * 60000000 THEN 'firing'
      ELSE 'pending' END AS state FROM h"""


@register("alert_latency", f"""WITH {HIST_SQL},
p AS (SELECT stage, "at", {_interpolated(0.99)} AS p99 FROM totals),
{_sustained_sql('p', 'stage', 'p99 > 5', 2)}""")
def alert_latency(spark, sf):
    fired = tel.alert_latency(_samples(spark, sf), ["stage"], "seconds", limit=5.0, for_minutes=2)
    return plain(fired.select("stage", "at", "state"))


@register("alert_claims", f"""WITH
r AS (SELECT user_id % 2 AS shard, date_trunc('minute', ts) + to_minutes(CAST(j AS BIGINT)) AS "at",
    sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors
  FROM events, {_slots_sql(15)} GROUP BY 1, 2),
{_sustained_sql('r', 'shard', 'errors > 0', 15)}""")
def alert_claims(spark, sf):
    claims = table(spark, sf, "events").withColumn("shard", F.col("user_id") % 2)
    mismatch = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return plain(tel.alert_claims(claims, ["shard"], mismatch).select("shard", "at", "state"))


@register("alert_cost", f"""{U_SQL}
SELECT event_id, CAST(100000000 * sum(cost_usd) OVER (PARTITION BY merchant ORDER BY created_at
    RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS spend_1h_e8,
  sum(cost_usd) OVER (PARTITION BY merchant ORDER BY created_at
    RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 0.005 AS breached FROM usage""")
def alert_cost(spark, sf):
    return tel.alert_cost(usage(spark, sf), ["merchant"], 0.005).select(
        "event_id", (F.col("spend_1h") * 100000000).cast("long").alias("spend_1h_e8"), "breached")


# --- rate limits ----------------------------------------------------------------------

def requests(spark, sf):
    """One in three requests comes from a single key."""
    key = F.when(F.col("user_id") % 3 == 0, "hot").otherwise(F.col("user_id").cast("string"))
    return table(spark, sf, "events").select(key.alias("key"), F.col("event_id")
                                             .alias("request_id"), "ts")


LIMIT_SQL = """RECURSIVE req AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'hot'
      ELSE CAST(user_id AS VARCHAR) END AS key, event_id, epoch_us(ts) AS us FROM events),
  opened AS (SELECT key, min(us) AS start FROM req GROUP BY 1
    UNION ALL SELECT o.key, min(r.us) FROM opened o JOIN req r ON r.key = o.key
      AND r.us >= o.start + {width} GROUP BY o.key),
  placed AS (SELECT r.key, event_id, us, max(start) AS start FROM req r JOIN opened o
    ON o.key = r.key AND o.start <= r.us GROUP BY ALL),
  counted AS (SELECT *, row_number() OVER (PARTITION BY key, start ORDER BY us, event_id) AS count
    FROM placed)"""


@register("rate_limit", f"""WITH {LIMIT_SQL.format(width=21600000000)}
SELECT key, event_id AS request_id, start AS window_start, count, count <= 4 AS allowed,
  CASE WHEN count <= 4 THEN 0 ELSE CAST(ceil((start + 21600000000 - us) / 1000000.0) AS BIGINT) END
    AS retry_after FROM counted""")
def rate_limit(spark, sf):
    out = limits.rate_limit(requests(spark, sf), 4, 21600, chunk_windows=4)
    return plain(out.drop("ts"))


@register("rate_limit_clock", """
SELECT CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS key,
  epoch_us(ts) // 3600000000 * 3600000000 AS window_start, count(*) AS n,
  greatest(0, count(*) - 2) AS rejected FROM events GROUP BY 1, 2""")
def rate_limit_clock(spark, sf):
    return plain(limits.clock_windows(requests(spark, sf), 2, 3600))
