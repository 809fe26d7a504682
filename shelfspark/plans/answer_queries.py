"""Answer markers, turn verification, scenarios and conversation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import answers as ans
from shelfspark.functions import routing
from shelfspark.operators import answer_cache, turns
from shelfspark.plans import standins as st
from shelfspark.plans.registry import register, table
from shelfspark.plans.shapes import plain
from shelfspark.schema import EVIDENCE

# A turn per order: the answer cites lines' parts, quotes a price and a figure by rule.
TURNS_SQL = """turn_rows AS (
  SELECT o_orderkey AS k, 't' || (o_orderkey % 3) AS tenant, CAST(o_custkey AS VARCHAR)
      AS conversation_id, o_orderkey AS turn, o_custkey,
    'P-' || (o_orderkey % 200) AS own1, 'p-' || ((o_orderkey * 7) % 200) AS own2,
    'P-' || ((o_orderkey * 3) % 260) AS recalled,
    CASE o_orderkey % 5 WHEN 0 THEN 'What is the cheapest ring?' WHEN 1 THEN
      'how many bolts under 500' WHEN 2 THEN 'show me a red gear' WHEN 3 THEN
      'anything above $40 please' ELSE 'is the mean any good' END AS query,
    round(o_totalprice, 2) AS price FROM orders),
  texts AS (SELECT *, CASE k % 8
    WHEN 0 THEN '[[NO_MATCH]] Sorry, nothing here.'
    WHEN 1 THEN 'Take [[SKU:' || upper(own1) || ']] or [[SKU:' || own2 || ']] and [[SKU:'
      || own1 || ']].'
    WHEN 2 THEN 'The best is [[SKU:' || recalled || ']] and also [[SKU:ZZ-9]] [[SKU:zz-9]].'
    WHEN 3 THEN 'It costs $1,' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '.50 [[SKU:' || own1
      || ']]'
    WHEN 4 THEN 'The top price is [[STAT:' || (k % 300) || ']] [[SKU:' || own2 || ']]'
    WHEN 5 THEN 'Between [[STAT:100]] and [[STAT:200.5]].'
    WHEN 6 THEN 'Unfortunately we don''t really have that, only [[SKU:' || own1 || ']].'
    ELSE 'Rs. ' || (k % 300) || ' or ' || (k % 300) || ' INR; see [[SKU:' || own2 || ']]' END
    AS answer FROM turn_rows)"""


def _turn_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")

    def sku(prefix, n):
        return F.concat(F.lit(prefix), n.cast("string"))

    rows = st.wide(spark, sf, "orders").select(
        k.alias("k"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("tenant"),
        F.col("o_custkey").cast("string").alias("conversation_id"), k.alias("turn"),
        sku("P-", k % 200).alias("own1"), sku("p-", (k * 7) % 200).alias("own2"),
        sku("P-", (k * 3) % 260).alias("recalled"),
        F.when(k % 5 == 0, "What is the cheapest ring?").when(k % 5 == 1, "how many bolts under 500")
         .when(k % 5 == 2, "show me a red gear").when(k % 5 == 3, "anything above $40 please")
         .otherwise("is the mean any good").alias("query"))
    kk, m = F.col("k"), F.col("k") % 8

    def mark(name):
        return F.concat(F.lit("[[SKU:"), name, F.lit("]]"))

    own1, own2 = F.col("own1"), F.col("own2")
    n300 = (kk % 300).cast("string")
    answer = (
        F.when(m == 0, "[[NO_MATCH]] Sorry, nothing here.")
        .when(m == 1, F.concat(F.lit("Take "), mark(F.upper(own1)), F.lit(" or "), mark(own2),
                               F.lit(" and "), mark(own1), F.lit(".")))
        .when(m == 2, F.concat(F.lit("The best is "), mark(F.col("recalled")),
                               F.lit(" and also [[SKU:ZZ-9]] [[SKU:zz-9]].")))
        .when(m == 3, F.concat(F.lit("It costs $1,"), F.lpad((kk % 1000).cast("string"), 3, "0"),
                               F.lit(".50 "), mark(own1)))
        .when(m == 4, F.concat(F.lit("The top price is [[STAT:"), n300, F.lit("]] "), mark(own2)))
        .when(m == 5, "Between [[STAT:100]] and [[STAT:200.5]].")
        .when(m == 6, F.concat(F.lit("Unfortunately we don't really have that, only "), mark(own1),
                               F.lit(".")))
        .otherwise(F.concat(F.lit("Rs. "), n300, F.lit(" or "), n300, F.lit(" INR; see "),
                            mark(own2))))
    return rows.withColumn("answer", answer)


def _evidence(rows: DataFrame) -> DataFrame:
    """Products own1 (priced) and own2 (unpriced in odd turns), and statistics by rule."""
    dec, k = "decimal(18,4)", F.col("k")

    def entry(kind, sku=None, price=None, metric=None, count=None, lo=None, hi=None, mean=None):
        def value(v, t):
            return (v if v is not None else F.lit(None)).cast(t)
        return F.struct(
            F.lit(kind).alias("kind"), value(sku, "string").alias("sku"),
            value(price, dec).alias("price"), value(metric, "string").alias("metric"),
            value(count, "long").alias("count"), value(lo, dec).alias("minimum"),
            value(hi, dec).alias("maximum"), value(mean, dec).alias("mean"))

    first = entry("product", F.col("own1"), 1000 + k % 1000)
    second = entry("product", F.col("own2"), F.when(k % 2 == 0, F.lit(7)))
    stats = entry("stats", metric=F.when(k % 6 == 4, "rating").otherwise("price"),
                  count=F.lit(9), lo=F.lit(100), hi=k % 301, mean=F.lit(150.25))
    listed = F.array_compact(F.array(first, second, F.when(k % 3 == 1, stats),
                                     F.when(k % 12 == 4, stats)))
    return rows.withColumn("evidence", listed.cast(EVIDENCE))


def turn_table(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(_turn_rows(spark, sf))


@register("is_no_match", f"""WITH {TURNS_SQL}
SELECT k, k % 8 = 0 AS no_match FROM texts""")
def is_no_match(spark, sf):
    padded = F.concat(F.lit("  "), F.col("answer"))
    return _turn_rows(spark, sf).select("k", ans.is_no_match(padded).alias("no_match"))


@register("extract_cited_skus", rf"""WITH {TURNS_SQL}
SELECT k, array_to_string(regexp_extract_all(answer, '\[\[SKU:([^\[\]]+)\]\]', 1), '|') AS skus
FROM texts""")
def extract_cited_skus(spark, sf):
    return plain(_turn_rows(spark, sf).select("k", ans.cited_skus(F.col("answer")).alias("skus")))


@register("extract_stat_markers", rf"""WITH {TURNS_SQL}
SELECT k, round(coalesce(list_sum(list_transform(regexp_extract_all(answer,
  '\[\[STAT:(-?\d+(?:\.\d+)?)\]\]', 1), lambda x: CAST(x AS DOUBLE))), 0), 6) AS total,
  len(regexp_extract_all(answer, '\[\[STAT:(-?\d+(?:\.\d+)?)\]\]', 1)) AS n FROM texts""")
def extract_stat_markers(spark, sf):
    found = ans.stat_markers(F.col("answer"))
    total = F.aggregate(found, F.lit(0.0), lambda t, x: t + x.cast("double"))
    return plain(_turn_rows(spark, sf).select("k", total.alias("total"), F.size(found).alias("n")))


@register("extract_price_mentions", f"""WITH {TURNS_SQL}
SELECT k, CASE k % 8 WHEN 3 THEN 1000.5 + k % 1000 WHEN 7 THEN CAST(k % 300 AS DOUBLE) END
    AS first_price, CASE k % 8 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS n FROM texts""".replace(
    "1000.5 +", "1000.5::DOUBLE +"))
def extract_price_mentions(spark, sf):
    found = ans.price_mentions(F.col("answer"))
    return plain(_turn_rows(spark, sf).select(
        "k", F.get(found, F.lit(0)).alias("first_price"), F.size(found).alias("n")))


@register("refuses", """SELECT conv_id, turn, regexp_matches(text || CASE turn % 4
    WHEN 0 THEN ' we don''t really have it' WHEN 1 THEN ' no such thing' ELSE '' END,
  '(?i)\\b(don''?t(?:\\s+\\w+){0,2}\\s+(?:have|sell|carry)|no (?:matching|such)|sorry|unfortunately)\\b')
  AS refused FROM conversations""".replace("\\\\", "\\"))
def refuses(spark, sf):
    tail = F.when(F.col("turn") % 4 == 0, " we don't really have it").when(
        F.col("turn") % 4 == 1, " no such thing").otherwise("")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", ans.refuses(F.concat("text", tail)).alias("refused"))


@register("has_superlative", f"""WITH {TURNS_SQL}
SELECT k, k % 5 IN (0, 1) OR (k % 5 = 3) AS superlative FROM texts""")
def has_superlative(spark, sf):
    return _turn_rows(spark, sf).select("k", ans.has_superlative(F.col("query"))
                                        .alias("superlative"))


@register("as_chat_message", """
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Do you have product ' || item_id || ' in stock?'
  ELSE 'I''m looking for item ' || item_id || '.' END AS message FROM benchmark""")
def as_chat_message(spark, sf):
    n = F.col("item_id").cast("string")
    asked = F.when(F.col("item_id") % 2 == 0, n).otherwise(F.concat(F.lit("item "), n))
    return table(spark, sf, "benchmark").select("item_id", ans.as_chat_message(asked)
                                                .alias("message"))


EVIDENCE_SQL = f"""{TURNS_SQL},
facts AS (SELECT *, 1000 + k % 1000 AS price1, CASE WHEN k % 2 = 0 THEN 7 END AS price2,
    (CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 12 = 4 THEN 1 ELSE 0 END) AS n_stats,
    k % 6 = 4 AS stat_is_rating, k % 301 AS stat_hi FROM texts),
cites AS (SELECT k, tenant, sku, pos, row_number() OVER (PARTITION BY k, lower(sku) ORDER BY pos)
    AS copy FROM (SELECT k, tenant, unnest(list) AS sku, generate_subscripts(list, 1) AS pos FROM
    (SELECT k, tenant, regexp_extract_all(answer, '\\[\\[SKU:([^\\[\\]]+)\\]\\]', 1) AS list
     FROM texts))),
judged AS (SELECT c.*, lower(c.sku) IN (lower(f.own1), lower(f.own2)) AS held,
    EXISTS (SELECT 1 FROM part WHERE c.sku = 'P-' || p_partkey
      AND c.tenant = 't' || (p_partkey % 3)) AS in_catalog
  FROM cites c JOIN facts f USING (k))"""


@register("join_hallucinated", f"""WITH {EVIDENCE_SQL}
SELECT k, sku FROM judged WHERE NOT held AND copy = 1""")
def join_hallucinated(spark, sf):
    found = ans.hallucinated_skus(F.col("answer"), ans.products_in(F.col("evidence")))
    return turn_table(spark, sf).select("k", F.explode(found).alias("sku"))


@register("join_backfill", f"""WITH {EVIDENCE_SQL}
SELECT DISTINCT k, sku FROM judged WHERE NOT held AND in_catalog""")
def join_backfill(spark, sf):
    filled = turns.backfill(turn_table(spark, sf), st.products(spark, sf))
    extra = F.slice("products", F.lit(3), F.greatest(F.lit(0), F.size("products") - 2))
    return filled.select("k", F.explode(extra).alias("p")).select("k", F.col("p.sku").alias("sku"))


@register("join_displayed", f"""WITH {EVIDENCE_SQL}
SELECT k, count(DISTINCT lower(sku)) FILTER (held AND k % 8 <> 6) AS displayed FROM judged
GROUP BY 1""")
def join_displayed(spark, sf):
    shown = ans.displayed_products(F.col("answer"), ans.products_in(F.col("evidence")))
    distinct = F.size(F.array_distinct(F.transform(shown, lambda p: F.lower(p["sku"]))))
    return plain(turn_table(spark, sf).where(F.size(ans.cited_skus(F.col("answer"))) > 0).select(
        "k", distinct.alias("displayed")))


STAT_SQL = f"""{EVIDENCE_SQL},
marks AS (SELECT k, CAST(unnest(regexp_extract_all(answer, '\\[\\[STAT:(-?\\d+(?:\\.\\d+)?)\\]\\]',
    1)) AS DOUBLE) AS m FROM texts),
matched AS (SELECT k, m, abs(m - 100) / 100 <= 0.02 OR abs(m - 150.25) / 150.25 <= 0.02
    OR (stat_hi <> 0 AND abs(m - stat_hi) / nullif(stat_hi, 0) <= 0.02) AS ok
  FROM marks JOIN facts USING (k)),
stat AS (SELECT f.k, CASE WHEN count(m) > 0 AND n_stats = 1 AND NOT stat_is_rating
    THEN bool_or(NOT coalesce(ok, false)) END AS stat_mismatch, count(m) > 0 AND n_stats = 0
    AS unverified_refusal FROM facts f LEFT JOIN matched USING (k)
  GROUP BY f.k, n_stats, stat_is_rating)"""


@register("join_stat_claim", f"""WITH {STAT_SQL} SELECT k, stat_mismatch FROM stat""")
def join_stat_claim(spark, sf):
    return turn_table(spark, sf).select("k", ans.stat_mismatch(
        F.col("answer"), F.col("evidence")).alias("stat_mismatch"))


@register("price_mismatch", f"""WITH {EVIDENCE_SQL}
SELECT k, CASE WHEN k % 8 = 3 AND price2 IS NULL
  THEN abs(1000.5 + k % 1000 - price1) / price1 > 0.02 END AS price_mismatch FROM facts""")
def price_mismatch(spark, sf):
    return turn_table(spark, sf).select("k", ans.price_mismatch(
        F.col("answer"), ans.products_in(F.col("evidence"))).alias("price_mismatch"))


VERIFIED_SQL = f"""{STAT_SQL},
verified AS (SELECT f.k, f.tenant, s.stat_mismatch, s.unverified_refusal,
    (SELECT count(*) FROM judged j WHERE j.k = f.k AND NOT held AND copy = 1 AND NOT EXISTS (
      SELECT 1 FROM judged o WHERE o.k = f.k AND lower(o.sku) = lower(j.sku) AND o.in_catalog))
      AS n_hallucinated,
    f.k % 5 IN (0, 1, 3) AND n_stats = 0 AS superlative_without_stats,
    n_stats = 0 AS cacheable FROM facts f JOIN stat s USING (k))"""


def _verified(spark, sf):
    return turns.verify_turns(turn_table(spark, sf), st.products(spark, sf))


@register("verify_turns", f"""WITH {VERIFIED_SQL}
SELECT k AS turn, n_hallucinated, stat_mismatch, unverified_refusal, superlative_without_stats,
  cacheable FROM verified""")
def verify_turns(spark, sf):
    return plain(_verified(spark, sf).select(
        "turn", "n_hallucinated", "stat_mismatch", "unverified_refusal",
        "superlative_without_stats", "cacheable"))


@register("claim_counters", f"""WITH {VERIFIED_SQL}
SELECT 'hallucinated_citation' AS claim_type, CAST(sum(n_hallucinated) AS BIGINT) AS n FROM verified
UNION ALL SELECT 'stat_mismatch', count(*) FILTER (stat_mismatch) FROM verified
UNION ALL SELECT 'unverified_quantitative_refusal', count(*) FILTER (unverified_refusal)
  FROM verified
UNION ALL SELECT 'superlative_without_stats', count(*) FILTER (superlative_without_stats)
  FROM verified""")
def claim_counters(spark, sf):
    return turns.claim_counters(_verified(spark, sf))


# --- scenarios ------------------------------------------------------------------------

SCENARIOS_SQL = f"""{EVIDENCE_SQL},
scenarios AS (SELECT k, tenant, CASE WHEN k % 3 = 2 THEN 'refusal' ELSE 'grounded' END AS kind
  FROM facts),
cited AS (SELECT k, bool_and(held) AS all_held, bool_or(lower(sku) = lower(own1)) AS names1
  FROM judged JOIN facts USING (k) GROUP BY 1),
scored AS (SELECT s.k, s.tenant, kind, coalesce(all_held, true) AS grounded,
    CASE WHEN kind = 'grounded' THEN contains(lower(answer), lower(own1)) END AS answer_correct,
    CASE WHEN kind = 'refusal' THEN s.k % 8 IN (0, 6) END AS refused,
    CASE WHEN s.k % 8 = 3 AND price2 IS NULL
      THEN abs(1000.5 + s.k % 1000 - price1) / price1 > 0.02 END AS price_mismatch
  FROM scenarios s JOIN facts f ON f.k = s.k LEFT JOIN cited c ON c.k = s.k)"""


def _scored(spark, sf):
    answered = turn_table(spark, sf).select(
        F.col("k").alias("scenario_id"), "tenant",
        F.when(F.col("k") % 3 == 2, "refusal").otherwise("grounded").alias("kind"),
        F.array("own1").alias("expected_skus"), "answer",
        ans.products_in(F.col("evidence")).alias("products"))
    return turns.score_scenarios(answered)


@register("score_scenario", f"""WITH {SCENARIOS_SQL}
SELECT k AS scenario_id, tenant, kind, grounded, answer_correct, refused, price_mismatch
FROM scored""")
def score_scenario(spark, sf):
    return _scored(spark, sf)


@register("filter_failures", f"""WITH {SCENARIOS_SQL}
SELECT k AS scenario_id FROM scored WHERE NOT grounded
  OR (kind = 'grounded' AND NOT answer_correct) OR (kind = 'refusal' AND NOT refused)""")
def filter_failures(spark, sf):
    return turns.failures(_scored(spark, sf)).select("scenario_id")


@register("agg_generation", f"""WITH {SCENARIOS_SQL}
SELECT CASE WHEN grouping(tenant) = 1 THEN 'overall' ELSE tenant END AS tenant,
  count(*) AS n_scenarios, round(avg(CAST(grounded AS INT)), 6) AS groundedness_rate,
  round(avg(CAST(answer_correct AS INT)), 6) AS answer_hit_rate,
  count(*) FILTER (kind = 'grounded') AS answer_hit_rate_n,
  round(avg(CASE WHEN kind = 'refusal' THEN CAST(refused AND grounded AS INT) END), 6)
    AS refusal_correctness, count(*) FILTER (kind = 'refusal') AS refusal_correctness_n,
  round(avg(CAST(price_mismatch AS INT)), 6) AS hallucinated_attribute_rate,
  count(price_mismatch) AS hallucinated_attribute_rate_n
FROM scored GROUP BY GROUPING SETS ((tenant), ())""")
def agg_generation(spark, sf):
    return plain(turns.generation_report(_scored(spark, sf)))


@register("union_scenarios", f"""WITH {st.GOLDEN_SQL}
SELECT tenant || '-' || qid AS scenario_id, tenant, 'I''m looking for ' || query || '.' AS message,
  'grounded' AS kind, (SELECT string_agg(sku, '|' ORDER BY sku) FROM judgments j
    WHERE j.qid = g.qid) AS expected_skus
FROM golden g WHERE qid IN (SELECT qid FROM judgments)
UNION ALL SELECT 'probe-' || item_id, 'en', 'Do you sell ' || length(text) || ' kites?', 'refusal',
  '' FROM benchmark""")
def union_scenarios(spark, sf):
    maps = st.judgments(spark, sf).groupBy("qid").agg(F.map_from_entries(F.collect_list(
        F.struct("sku", "rel"))).alias("judgments"))
    golden = st.golden_queries(spark, sf).select("qid", "tenant", "query").join(maps, "qid")
    probes = table(spark, sf, "benchmark").select(
        F.concat(F.lit("probe-"), F.col("item_id").cast("string")).alias("scenario_id"),
        F.lit("en").alias("tenant"), F.concat(F.lit("Do you sell "), F.length("text")
                                              .cast("string"), F.lit(" kites?")).alias("message"),
        F.lit("refusal").alias("kind"), F.array().cast("array<string>").alias("expected_skus"))
    return plain(turns.union_scenarios(turns.grounded_scenarios(golden), probes))


@register("agg_confusion", """
SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS agreement,
  count(*) FILTER (quality = 0 AND toxic = 1) AS false_negatives,
  count(*) FILTER (quality = 1 AND toxic = 0) AS false_positives FROM labels""")
def agg_confusion(spark, sf):
    return turns.confusion(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


TIERS_SQL = f"""{SCENARIOS_SQL},
pairs AS (SELECT f.k AS probe_id, CASE WHEN f.k % 4 = 0 THEN 'baseline' ELSE 'probe' END
    AS probe_group, f.grounded IS DISTINCT FROM r.grounded
      OR f.answer_correct IS DISTINCT FROM r.answer_correct
      OR f.refused IS DISTINCT FROM r.refused AS changed
  FROM scored f JOIN scored r ON r.k = f.k + 3 AND r.kind = f.kind WHERE f.k % 6 < 3)"""


def _tiers(spark, sf):
    """Turn k answered by the fast tier, turn k + 3 standing for the reasoning tier."""
    scored = _scored(spark, sf)
    k = F.col("scenario_id")
    tiers = scored.withColumns({
        "tier": F.when(k % 6 < 3, "fast").otherwise("reasoning"),
        "probe_id": F.when(k % 6 < 3, k).otherwise(k - 3)})
    group = F.when(F.col("probe_id") % 4 == 0, "baseline").otherwise("probe")
    paired = turns.paired_tiers(tiers.withColumn("probe_group", group))
    both = F.col("fast_grounded").isNotNull() & F.col("reasoning_grounded").isNotNull()
    return paired.where(both)


@register("join_paired_tiers", f"""WITH {TIERS_SQL} SELECT probe_id, probe_group, changed FROM pairs""")
def join_paired_tiers(spark, sf):
    return _tiers(spark, sf).select("probe_id", "probe_group", "changed")


@register("agg_router_outcome", f"""WITH {TIERS_SQL}
SELECT probe_group, count(*) FILTER (changed) AS changed, count(*) AS n FROM pairs GROUP BY 1""")
def agg_router_outcome(spark, sf):
    return turns.router_outcome(_tiers(spark, sf))


# --- conversation logs ----------------------------------------------------------------

@register("merge_evidence", """WITH e AS (
  SELECT l_orderkey, l_linenumber % 3 AS round, l_linenumber AS pos,
    CASE WHEN l_linenumber % 5 = 4 THEN 'stats' ELSE 'product' END AS kind,
    CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE 'P-' || (l_partkey % 4) END AS sku FROM lineitem),
f AS (SELECT l_orderkey, sku, min(round) AS first FROM e WHERE kind = 'product' GROUP BY 1, 2)
SELECT e.l_orderkey AS turn, e.round, e.kind, count(*) AS n FROM e LEFT JOIN f
  ON f.l_orderkey = e.l_orderkey AND f.sku = e.sku
WHERE kind <> 'product' OR round = first GROUP BY ALL""")
def merge_evidence(spark, sf):
    stats = F.col("l_linenumber") % 5 == 4
    rounds = table(spark, sf, "lineitem").select(
        F.lit("t").alias("tenant"), F.lit("c").alias("conversation_id"),
        F.col("l_orderkey").alias("turn"), (F.col("l_linenumber") % 3).alias("round"),
        F.col("l_linenumber").alias("pos"), F.when(stats, "stats").otherwise("product")
        .alias("kind"), F.when(~stats, F.concat(F.lit("P-"), (F.col("l_partkey") % 4)
                                                .cast("string"))).alias("sku"))
    return plain(turns.merge_evidence(rounds).groupBy("turn", "round", "kind").agg(
        F.count("*").alias("n")))


@register("last_user_message", """
SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations
WHERE role = 'user' GROUP BY 1""")
def last_user_message(spark, sf):
    return turns.last_user_message(table(spark, sf, "conversations"))


@register("conversation_state", """
SELECT conv_id, turn, count(*) OVER w AS n_messages,
  count(*) FILTER (role = 'user') OVER w AS n_user,
  CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars,
  max(CASE WHEN role = 'user' THEN turn END) OVER w AS last_user_turn
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_state(spark, sf):
    return turns.conversation_state(table(spark, sf, "conversations")).select(
        "conv_id", "turn", "n_messages", "n_user", "n_chars", "last_user_turn")


CALLS_SQL = """calls AS (SELECT event_id, user_id AS conv_id,
    CAST(epoch_us(date_trunc('day', ts)) // 86400000000 AS BIGINT) AS turn, ts FROM events
  WHERE event_type IN ('click', 'view', 'purchase'))"""


def _calls(spark, sf):
    day = F.floor(F.unix_micros(F.date_trunc("day", "ts")) / F.lit(86_400_000_000))
    return table(spark, sf, "events").where(
        F.col("event_type").isin("click", "view", "purchase")).select(
        "event_id", F.col("user_id").alias("conv_id"), day.alias("turn"), "ts")


@register("tool_round_cap", f"""WITH {CALLS_SQL}
SELECT event_id, row_number() OVER w AS round, row_number() OVER w >= 2 AS force_no_tools
FROM calls WINDOW w AS (PARTITION BY conv_id, turn ORDER BY ts, event_id)""")
def tool_round_cap(spark, sf):
    return plain(turns.tool_rounds(_calls(spark, sf)).select("event_id", "round",
                                                             "force_no_tools"))


@register("route_turn", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'end'
  WHEN event_type IN ('click', 'view') AND event_id % 4 < 2 THEN 'tool' ELSE 'validate' END AS route
FROM events""")
def route_turn(spark, sf):
    logged = table(spark, sf, "events").select(
        "event_id", (F.col("event_type") == "signup").alias("cache_hit"),
        F.col("event_type").isin("click", "view").alias("has_tool_call"),
        (F.col("event_id") % 4).alias("rounds"))
    return turns.route_turn(logged).select("event_id", "route")


@register("join_tool_call_result", """WITH e AS (
  SELECT event_id, ts, 'u' || (user_id % 3) AS tenant, CAST(user_id AS VARCHAR) AS conversation_id,
    CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'tool_result' ELSE 'other' END
      AS event FROM events),
n AS (SELECT *, lead(event) OVER w AS ne, lead(event_id) OVER w AS nid, lead(ts) OVER w AS nts
  FROM e WINDOW w AS (PARTITION BY tenant, conversation_id ORDER BY ts, event_id))
SELECT tenant, conversation_id, event_id AS call_id, CASE WHEN ne = 'tool_result' THEN nid END
  AS result_id, CASE WHEN ne = 'tool_result' THEN epoch_us(nts) - epoch_us(ts) END AS elapsed_us
FROM n WHERE event = 'tool_call'""")
def join_tool_call_result(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "ts", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))
        .alias("tenant"), F.col("user_id").cast("string").alias("conversation_id"),
        F.when(F.col("event_type") == "click", "tool_call")
         .when(F.col("event_type") == "view", "tool_result").otherwise("other").alias("event"))
    return turns.pair_tool_events(events)


# --- answer cache ---------------------------------------------------------------------

CACHE_SQL = """ev AS (SELECT event_id, 'm' || (event_id % 2) AS tenant, epoch_us(ts) * 3 AS us,
    CASE WHEN event_type IN ('view', 'signup') THEN 0 WHEN event_type = 'purchase' AND value >= 95
      THEN 1 ELSE 2 END AS kind, embedding
    FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings)),
  st0 AS (SELECT *, lag(us) OVER (PARTITION BY tenant ORDER BY us, event_id) AS prev FROM ev
    WHERE kind = 2),
  inv AS (SELECT tenant, us FROM ev WHERE kind = 1),
  st AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY us, event_id) AS idx,
    prev IS NULL OR us - prev >= 14400000000 OR EXISTS (SELECT 1 FROM inv i
      WHERE i.tenant = st0.tenant AND i.us > prev AND i.us <= st0.us) AS fresh FROM st0),
  se AS (SELECT *, max(CASE WHEN fresh THEN idx END) OVER (PARTITION BY tenant ORDER BY idx)
    AS session FROM st),
  q AS (SELECT * FROM ev WHERE kind = 0),
  lastst AS (SELECT q.event_id AS qid, max(s.idx) AS last FROM q JOIN se s ON s.tenant = q.tenant
    AND s.us < q.us GROUP BY 1),
  live AS (SELECT q.event_id AS qid, q.tenant, q.embedding, l.last, s.session FROM q
    JOIN lastst l ON l.qid = q.event_id JOIN se s ON s.tenant = q.tenant AND s.idx = l.last
    WHERE q.us - s.us < 14400000000 AND NOT EXISTS (SELECT 1 FROM inv i WHERE i.tenant = q.tenant
      AND i.us > s.us AND i.us < q.us)),
  cand AS (SELECT l.qid, l.tenant, s.event_id AS sid, s.idx, round(list_sum(list_transform(
      list_zip(l.embedding, s.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9)
      AS sim
    FROM live l JOIN se s ON s.tenant = l.tenant AND s.idx BETWEEN greatest(l.session, l.last - 29)
      AND l.last)"""


def cache_logs(spark: SparkSession, sf: str):
    """Every event as a store, a query or an invalidation, times stretched threefold.

    Views and signups ask; a large purchase is a change of the catalog; all others are answers.
    """
    e = table(spark, sf, "embeddings")
    size = e.agg(F.count("*").alias("size"))
    large = (F.col("event_type") == "purchase") & (F.col("value") >= 95)
    kind = F.when(F.col("event_type").isin("view", "signup"), answer_cache.QUERY).when(
        large, answer_cache.INVALIDATE).otherwise(answer_cache.STORE)
    ev = table(spark, sf, "events").crossJoin(F.broadcast(size)).withColumn(
        "vec_id", F.col("event_id") % F.col("size")).join(e.select("vec_id", "embedding"), "vec_id").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("tenant"),
        F.timestamp_micros(F.unix_micros("ts") * 3).alias("ts"), kind.alias("kind"), "embedding")
    stores = ev.where(F.col("kind") == answer_cache.STORE).withColumnRenamed("id", "store_id")
    asked = ev.where(F.col("kind") == answer_cache.QUERY).withColumnRenamed("id", "qid")
    return stores, asked, ev.where(F.col("kind") == answer_cache.INVALIDATE).select("tenant", "ts")


@register("join_semantic_cache", f"""WITH {CACHE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, idx DESC) AS rn FROM cand
  WHERE sim >= 0.2)
SELECT tenant, lpad(CAST(qid AS VARCHAR), 12, '0') AS qid, lpad(CAST(sid AS VARCHAR), 12, '0')
  AS store_id, round(sim, 6) AS similarity FROM r WHERE rn = 1""")
def join_semantic_cache(spark, sf):
    stores, asked, cleared = cache_logs(spark, sf)
    return plain(answer_cache.cache_lookup(stores, asked, cleared, threshold=0.2, ring=30,
                                           ttl_seconds=4 * 3600))


@register("classify_messages", r"""
SELECT conv_id, max(turn) AS turn, bool_or(regexp_matches(text, '(?i)\b(and|but|also)\b')) AS joined
FROM conversations WHERE role = 'user' GROUP BY 1""")
def classify_messages(spark, sf):
    users = table(spark, sf, "conversations").where(F.col("role") == "user")
    joined = F.col("text").rlike(routing.CASELESS + r"\b(and|but|also)\b")
    return users.groupBy("conv_id").agg(F.max("turn").alias("turn"),
                                        F.bool_or(joined).alias("joined"))
