"""Quality rules, turn checks and alert states on small cases."""

from decimal import Decimal

from pyspark.sql import functions as F

from shelfspark.operators import enrich, quality, telemetry, turns
from shelfspark.schema import EVIDENCE

PROFILE = ("tenant string, total long, failed long, products_with_category long, hhi double, "
           "price_count long, price_min double, price_p25 double, price_p75 double, "
           "price_max double, rating_max double, description double")


def rules(spark, **changes):
    base = {"tenant": "t", "total": 100, "failed": 0, "products_with_category": 100, "hhi": .1,
            "price_count": 100, "price_min": 1.0, "price_p25": 10.0, "price_p75": 100.0,
            "price_max": 900.0, "rating_max": 5.0, "description": 1.0}
    row = spark.createDataFrame([tuple({**base, **changes}.values())], PROFILE)
    return {r.rule: r.severity for r in quality.rule_flags(row).collect()}


def test_rules(spark):
    assert rules(spark) == {}
    assert rules(spark, failed=5) == {}
    assert rules(spark, failed=6) == {"parse_failures": "warning"}
    assert rules(spark, hhi=.2) == {"category_moderately_concentrated": "warning"}
    assert rules(spark, hhi=.9) == {"category_highly_concentrated": "warning"}
    assert rules(spark, hhi=.9, products_with_category=19) == {}
    assert rules(spark, price_min=0.0) == {"price_not_positive": "critical"}
    assert rules(spark, price_max=1e6) == {"price_far_out": "warning"}
    assert rules(spark, price_p25=0.0, price_max=1e9) == {}
    assert rules(spark, rating_max=5.1) == {"rating_above_scale": "critical"}
    assert rules(spark, description=.49) == {"descriptions_missing": "warning"}
    assert rules(spark, price_min=None, price_p25=None, price_p75=None, price_max=None,
                 rating_max=None) == {}


def turn(spark, answer, evidence, query="hello"):
    rows = spark.createDataFrame([("t", "c", 1, query, answer)],
                                 "tenant string, conversation_id string, turn int, query string, "
                                 "answer string")
    entry = "named_struct('kind', '{}', 'sku', {}, 'price', {}, 'metric', {}, 'count', 3L, " \
            "'minimum', {}, 'maximum', {}, 'mean', {})"
    parts = ", ".join(entry.format(*e) for e in evidence)
    return rows.withColumn("evidence", F.expr(f"array({parts})").cast(EVIDENCE))


PRODUCT = ("product", "'A-1'", "100", "null", "null", "null", "null")
STATS = ("stats", "null", "null", "'price'", "10", "200", "55.5")
RATING = ("stats", "null", "null", "'rating'", "1", "5", "4")


def verdict(spark, *args, catalog=None, **kwargs):
    return turns.verify_turns(turn(spark, *args, **kwargs), catalog).first()


def test_citations_are_checked_without_case(spark):
    got = verdict(spark, "[[SKU:a-1]] [[SKU:B-2]] [[SKU:b-2]]", [PRODUCT])
    assert got.hallucinated == ["B-2"] and got.displayed == 1 and got.cacheable
    catalog = spark.createDataFrame([("t", "B-2", Decimal(5)), ("other", "C", Decimal(1))],
                                    "tenant string, sku string, price decimal(18,4)")
    got = verdict(spark, "[[SKU:B-2]] [[SKU:C]]", [PRODUCT], catalog=catalog)
    assert got.hallucinated == ["C"] and got.displayed == 1
    assert verdict(spark, "Sorry, not [[SKU:A-1]]", [PRODUCT]).displayed == 0


def test_figures(spark):
    assert verdict(spark, "max [[STAT:199]]", [STATS]).stat_mismatch is False
    assert verdict(spark, "max [[STAT:150]]", [STATS]).stat_mismatch is True
    assert verdict(spark, "three [[STAT:3]]", [STATS]).stat_mismatch is True
    assert verdict(spark, "max [[STAT:199]]", [STATS, STATS]).stat_mismatch is None
    assert verdict(spark, "max [[STAT:5]]", [RATING]).stat_mismatch is None
    assert verdict(spark, "nothing", [STATS]).stat_mismatch is None
    assert verdict(spark, "none above [[STAT:9]]", [PRODUCT]).unverified_refusal
    assert not verdict(spark, "none above [[STAT:9]]", [RATING]).unverified_refusal
    lonely = verdict(spark, "x", [PRODUCT], query="the cheapest one")
    assert lonely.superlative_without_stats and lonely.cacheable
    assert not verdict(spark, "x", [STATS], query="the cheapest one").cacheable


def test_alert_states(spark):
    minutes = [(0, 1), (1, 1), (2, 1), (3, 0), (4, 1), (6, 1), (7, 1), (8, 1)]
    rows = spark.createDataFrame([("s", m * 60, bool(b)) for m, b in minutes],
                                 "stage string, sec long, hot boolean").withColumn(
        "at", F.timestamp_seconds("sec"))
    out = telemetry.sustained(rows, ["stage"], F.col("hot"), 2).orderBy("sec").collect()
    assert [r.state for r in out] == ["pending", "pending", "firing", "normal", "pending",
                                      "pending", "pending", "firing"]


def test_histogram_quantile_interpolates(spark):
    rows = spark.createDataFrame([("s", 0, v) for v in (.01, .07, .07, .2, 99.0)],
                                 "stage string, sec long, seconds double").withColumn(
        "ts", F.timestamp_seconds("sec"))
    got = telemetry.hist_quantile(rows, ["stage"], "seconds", quantiles=(.5, .99)).first()
    assert abs(got.p50 - (.05 + .05 * 1.5 / 2)) < 1e-9 and got.p99 == 30.0


def test_taxonomy(spark):
    table = enrich.taxonomy_table(spark)
    assert table.groupBy("tenant").count().count() == 3
    values = {r.tenant: r.category_values for r in enrich.taxonomy_values(table).collect()}
    assert values["fashion"] == sorted(set(values["fashion"]))
    assert "Watches" in values["fashion"] and "Other" in values["home"] and "none" not in values
    items = spark.createDataFrame(
        [("home", "a", "Non-stick cookware pan", "", None), ("home", "b", "zzz", "", None)],
        "tenant string, key string, title string, description string, hint string")
    labels = {r.key: r.label for r in enrich.classify(items, table).collect()}
    assert labels == {"a": "Kitchen & Dining > Cookware", "b": "Other > Uncategorized"}


def test_alert_cost_adds_no_window_row_by_row(spark):
    """Calls at one instant, an hour apart to the microsecond, across hours and before 1970."""
    starts = [0, 0, 5, 3_599_999_999, 3_600_000_000, 3_600_000_001, 7_200_000_000, 7_200_000_000, -1, -3_600_000_001]
    calls = [(i, "ab"[i % 4 == 3], us, f"0.{i + 1:08d}" if i != 2 else None) for i, us in enumerate(starts)]
    usage = spark.createDataFrame(calls, "i int, m string, us long, c string").select(
        "i", "m", F.timestamp_micros("us").alias("created_at"), F.col("c").cast("decimal(14,8)").alias("cost_usd"))
    out = telemetry.alert_cost(usage, ["m"], 0.00000009)
    got = {r.i: (r.spend_1h, r.breached) for r in out.collect()}
    for i, m, us, _ in calls:
        want = sum(Decimal(c) for _, n, at, c in calls if n == m and c and us - 3_600_000_000 <= at <= us)
        assert got[i] == (want, want > Decimal("0.00000009"))
    assert "RangeFrame" not in out._jdf.queryExecution().optimizedPlan().toString()
