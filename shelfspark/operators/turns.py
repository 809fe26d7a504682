"""Verification of logged answers against their evidence, and scenario scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions import answers as ans
from shelfspark.operators.ranks import running

TURN = ["tenant", "conversation_id", "turn"]
MAX_TOOL_ROUNDS = 2
TURNS_PER_BUCKET = 256


def turn_bucket(turn: str = "turn") -> Column:
    return F.floor(F.col(turn) / TURNS_PER_BUCKET)


def merge_evidence(rounds: DataFrame) -> DataFrame:
    """Evidence of a turn over its tool rounds: a product counts in the first round it
    appears in (repeats inside that round stay), statistics always count.

    rounds: the turn's keys, round, pos and the evidence fields kind and sku.
    """
    keys = [*TURN, "sku"]
    first = rounds.where(F.col("kind") == "product").groupBy(*keys).agg(
        F.min("round").alias("_first"))
    return rounds.join(first, keys, "left").where(
        (F.col("kind") != "product") | (F.col("round") == F.col("_first"))).drop("_first")


def missing_citations(turns: DataFrame) -> DataFrame:
    """Cited skus the turn's own products do not hold."""
    products = ans.products_in(F.col("evidence"))
    return turns.select(*TURN, F.explode(F.array_distinct(
        ans.hallucinated_skus(F.col("answer"), products))).alias("sku"))


def backfill(turns: DataFrame, catalog: DataFrame) -> DataFrame:
    """Turns with products: their own plus cited ones that the tenant's catalog holds.

    Only cited-but-missing skus meet the catalog, as an equi-join.
    """
    found = missing_citations(turns).join(
        catalog.select("tenant", "sku", F.col("price").cast("decimal(18,4)").alias("price")),
        ["tenant", "sku"])
    recalled = found.groupBy(*TURN).agg(F.array_sort(F.collect_list(
        F.struct("sku", "price"))).alias("_recalled"))
    own = F.transform(ans.products_in(F.col("evidence")),
                      lambda e: F.struct(e["sku"].alias("sku"), e["price"].alias("price")))
    empty = F.array().cast("array<struct<sku:string,price:decimal(18,4)>>")
    return turns.join(recalled, TURN, "left").withColumn(
        "products", F.concat(own, F.coalesce("_recalled", empty))).drop("_recalled")


def verify_turns(turns: DataFrame, catalog: DataFrame | None = None,
                 cache_enabled: bool = True) -> DataFrame:
    """One row per turn: what its answer claims and whether the evidence holds it.

    turns: keys, query, answer, evidence. Everything but the catalog backfill is computed
    inside the row.
    """
    if catalog is not None:
        turns = backfill(turns, catalog)
    else:
        turns = turns.withColumn("products", ans.products_in(F.col("evidence")))
    answer, evidence, products = F.col("answer"), F.col("evidence"), F.col("products")
    no_stats = F.size(ans.stats_in(evidence)) == 0
    hallucinated = ans.hallucinated_skus(answer, products)
    return turns.select(
        *TURN, hallucinated.alias("hallucinated"), F.size(hallucinated).alias("n_hallucinated"),
        ans.stat_mismatch(answer, evidence).alias("stat_mismatch"),
        ans.unverified_refusal(answer, evidence).alias("unverified_refusal"),
        (ans.has_superlative(F.col("query")) & no_stats).alias("superlative_without_stats"),
        F.size(ans.displayed_products(answer, products)).alias("displayed"),
        (F.lit(cache_enabled) & no_stats).alias("cacheable"))


def claim_counters(verified: DataFrame) -> DataFrame:
    """Mismatched claims by type."""
    counts = verified.agg(
        F.sum("n_hallucinated").alias("hallucinated_citation"),
        F.count_if("stat_mismatch").alias("stat_mismatch"),
        F.count_if("unverified_refusal").alias("unverified_quantitative_refusal"),
        F.count_if("superlative_without_stats").alias("superlative_without_stats"))
    return counts.unpivot([], counts.columns, "claim_type", "n")


def grounded_scenarios(golden: DataFrame) -> DataFrame:
    """Scenarios from golden queries that have a positive judgment.

    golden: qid, tenant, query, judgments map<sku,int>.
    """
    expected = F.array_sort(F.map_keys(F.map_filter("judgments", lambda _, rel: rel > 0)))
    return golden.select(
        F.concat_ws("-", "tenant", "qid").alias("scenario_id"), "tenant",
        ans.as_chat_message(F.col("query")).alias("message"), F.lit("grounded").alias("kind"),
        expected.alias("expected_skus")).where(F.size("expected_skus") > 0)


def union_scenarios(grounded: DataFrame, refusals: DataFrame) -> DataFrame:
    return grounded.unionByName(refusals)


def score_scenarios(answered: DataFrame) -> DataFrame:
    """Per scenario: grounded, answer_correct, refused, price_mismatch.

    answered: scenario_id, tenant, kind, expected_skus, answer, products array<struct<sku,price>>.
    """
    answer, products = F.col("answer"), F.col("products")
    kept = [c for c in ("scenario_id", "tenant", "kind", "latency") if c in answered.columns]
    named = F.exists("expected_skus", lambda sku: F.contains(F.lower(answer), F.lower(sku)))
    return answered.select(
        *kept, (F.size(ans.hallucinated_skus(answer, products)) == 0).alias("grounded"),
        F.when(F.col("kind") == "grounded", named).alias("answer_correct"),
        F.when(F.col("kind") == "refusal", ans.is_no_match(answer) | ans.refuses(answer))
         .alias("refused"),
        ans.price_mismatch(answer, products).alias("price_mismatch"))


def failures(scored: DataFrame) -> DataFrame:
    """Scenarios that are ungrounded, wrong or should have refused."""
    wrong = F.when(F.col("kind") == "grounded", ~F.col("answer_correct")).otherwise(
        ~F.col("refused"))
    return scored.where(~F.col("grounded") | F.coalesce(wrong, F.lit(True)))


def generation_report(scored: DataFrame) -> DataFrame:
    """Rates per tenant and overall; a rate without cases is null."""
    grounded_kind, refusal_kind = F.col("kind") == "grounded", F.col("kind") == "refusal"

    def rate(case: Column, ok: Column) -> Column:
        return F.avg(F.when(case, F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)))

    out = scored.groupingSets([[F.col("tenant")], []], F.col("tenant")).agg(
        F.count("*").alias("n_scenarios"),
        rate(F.lit(True), F.col("grounded")).alias("groundedness_rate"),
        rate(grounded_kind, F.col("answer_correct")).alias("answer_hit_rate"),
        F.count_if(grounded_kind).alias("answer_hit_rate_n"),
        rate(refusal_kind, F.col("refused") & F.col("grounded")).alias("refusal_correctness"),
        F.count_if(refusal_kind).alias("refusal_correctness_n"),
        rate(F.col("price_mismatch").isNotNull(), F.col("price_mismatch"))
        .alias("hallucinated_attribute_rate"),
        F.count("price_mismatch").alias("hallucinated_attribute_rate_n"),
        F.grouping("tenant").alias("_all"))
    return out.withColumn("tenant", F.when(F.col("_all") == 1, "overall").otherwise(
        F.col("tenant"))).drop("_all")


def confusion(rows: DataFrame, heuristic: Column, judge: Column) -> DataFrame:
    """Agreement of a heuristic with a judge."""
    return rows.agg(
        F.count("*").alias("n"), F.count_if(heuristic == judge).alias("agreement"),
        F.count_if(~heuristic & judge).alias("false_negatives"),
        F.count_if(heuristic & ~judge).alias("false_positives"))


OUTCOMES = ("grounded", "answer_correct", "refused")


def paired_tiers(scored: DataFrame) -> DataFrame:
    """Probes scored under both tiers, and whether the tier changed the outcome."""
    keys = ["probe_id", "probe_group"]
    pivoted = scored.groupBy(*keys).pivot("tier", ["fast", "reasoning"]).agg(
        *[F.first(name).alias(name) for name in OUTCOMES])
    changed = [~F.col(f"fast_{n}").eqNullSafe(F.col(f"reasoning_{n}")) for n in OUTCOMES]
    return pivoted.withColumn("changed", changed[0] | changed[1] | changed[2])


def router_outcome(paired: DataFrame) -> DataFrame:
    return paired.groupBy("probe_group").agg(
        F.count_if("changed").alias("changed"), F.count("*").alias("n"))


def last_user_message(messages: DataFrame) -> DataFrame:
    """Latest user text per conversation."""
    return messages.where(F.col("role") == "user").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def conversation_state(messages: DataFrame) -> DataFrame:
    """State after each message: messages and characters so far, user turns, last user turn."""
    user = F.col("role") == "user"
    return running(
        messages, ["conv_id"], [F.col("turn")], turn_bucket(),
        sums={"n_messages": F.lit(1), "n_user": F.when(user, 1).otherwise(0),
              "n_chars": F.length("text")},
        maxima={"last_user_turn": F.when(user, F.col("turn"))})


def tool_rounds(calls: DataFrame, cap: int = MAX_TOOL_ROUNDS) -> DataFrame:
    """Tool calls numbered within their turn, and whether tools are off after each.

    calls: conv_id, turn, ts, event_id.
    """
    hour = F.floor(F.unix_micros("ts") / F.lit(3_600_000_000))
    numbered = running(calls, ["conv_id", "turn"], [F.col("ts"), F.col("event_id")], hour,
                       sums={"round": F.lit(1)})
    return numbered.withColumn("force_no_tools", F.col("round") >= cap)


def route_turn(turns: DataFrame, cap: int = MAX_TOOL_ROUNDS) -> DataFrame:
    """Next step of each logged turn: end, tool or validate."""
    return turns.withColumn("route", F.when(F.col("cache_hit"), "end").when(
        F.col("has_tool_call") & (F.col("rounds") < cap), "tool").otherwise("validate"))


def pair_tool_events(events: DataFrame) -> DataFrame:
    """Each tool_call with the next event of its conversation when that is a tool_result.

    Runs on ordered buckets of each conversation, so a long one is spread; the call ahead
    of a bucket edge takes the first event of the next bucket.
    """
    keys = ["tenant", "conversation_id"]
    bucket = F.date_trunc("hour", "ts")
    rows = events.withColumn("_bucket", bucket)
    at = [*keys, "_bucket"]
    order = [F.col("ts"), F.col("event_id")]
    item = F.struct("event_id", "event", "ts")
    local = rows.withColumn("_next", F.lead(item).over(W.partitionBy(*at).orderBy(*order)))
    firsts = rows.groupBy(*at).agg(F.min_by(item, F.struct(*order)).alias("_head"))
    ahead = firsts.select(*at, F.lead("_head").over(
        W.partitionBy(*keys).orderBy("_bucket")).alias("_ahead"))
    paired = local.join(ahead, at, "left").withColumn("_n", F.coalesce("_next", "_ahead"))
    return paired.where(F.col("event") == "tool_call").select(
        *keys, F.col("event_id").alias("call_id"),
        F.when(F.col("_n.event") == "tool_result", F.col("_n.event_id")).alias("result_id"),
        F.when(F.col("_n.event") == "tool_result",
               F.unix_micros(F.col("_n.ts")) - F.unix_micros("ts")).alias("elapsed_us"))
