"""Lexical routing of queries: class, blend weight and answer tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPLORATORY, ATTRIBUTE, IDENTIFIER = "exploratory", "attribute", "identifier"
CLASSES = (EXPLORATORY, ATTRIBUTE, IDENTIFIER)
PRIOR_ALPHA = {EXPLORATORY: 0.75, ATTRIBUTE: 0.50, IDENTIFIER: 0.15}
DEFAULT_ALPHA = 0.5

# The cue patterns.
IDENTIFIER_TOKEN = (
    r"^(?=.*\d)(?=.*[a-z])[a-z0-9]+(?:[-_/][a-z0-9]+)*$"
    r"|^[a-z]{1,4}[-_]?\d{2,}[a-z0-9-]*$"
    r"|^\d{6,}$"
)
MEASUREMENT = (
    r"\b\d+(?:\.\d+)?\s?(?:ml|l|g|kg|mm|cm|m|in|inch|inches|ft|gb|tb|mb|w|watt|"
    r"v|volt|hz|mah|mp|ton|oz|lb|pack|pcs|yr|year)\b"
    r"|\bsize\s+\w+\b"
    r"|\b\d{2,3}\s?x\s?\d{2,3}\b"
)
EXPLORATORY_CUE = (
    r"\b(something|anything|ideas?|suggest\w*|recommend\w*|looking for|"
    r"need\s+(?:a|an|some)|what should|help me|good for|best for|suitable|"
    r"gift|present|occasion|wedding|party|birthday|anniversary|festival|diwali|"
    r"christmas|vacation|holiday|trip|beach|trend\w*|style|outfit|"
    r"goes with|match\w*)\b"
)
QUESTION_CUE = r"^\s*(what|which|how|can|do|does|is|are|any)\b|\?\s*$"
NEED_FRAME_CUE = (
    r"\b(way|method|tool|device|gear|solution|something|anything)\s+(?:to|for)\b"
    r"|\bprotect\s+\w+"
)
CONTEXT_CUE = (
    r"\b(daily wear|everyday|workout|the gym|travel|for running|college|newborn|"
    r"office wear|working from home|lazy sunday)\b"
)
ATTRIBUTE_CUE = (
    r"\b(waterproof|wireless|cotton|leather|stainless|organic|slim|regular|oversized|"
    r"under|below|above|cheap|budget|premium|red|blue|black|white|green|yellow|pink|"
    r"small|medium|large|xl|xxl|mens|womens|kid|kids|unisex|rechargeable|portable|"
    r"noise|cancelling|nonstick|induction|smart|4k|hd|casual|formal)\b"
)
QUOTED = r"[\"’']([^\"’']{2,})[\"’']"
QUERY_TOKEN = r"[\w\-/]+"
COMPARISON_CUE = (
    r"\b(vs\.?|versus|compare[sd]?|comparison|better than|worse than|"
    r"difference between|which (?:is|one)|pros and cons|trade-?offs?)\b"
)
CONSTRAINT_JOIN = r"\b(and|but|also|as well as)\b"
MESSAGE_TOKEN = r"[\w$%]+"
ESCALATE_AFTER_ROUNDS = 2
LONG_MESSAGE_TOKENS = 25

CASELESS = "(?iU)"


def _hits(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _points(condition: Column, points: Column | float) -> Column:
    return F.when(condition, points).otherwise(F.lit(0.0))


def query_tokens(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit("(?U)" + QUERY_TOKEN), F.lit(0))


def _identifier_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike("(?i)" + IDENTIFIER_TOKEN))


def has_identifier_token(query: Column) -> Column:
    return F.size(_identifier_tokens(query_tokens(query))) > 0


def classify_query(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Adds query_class, confidence, reasons and has_identifier, all without a shuffle."""
    q = F.trim(F.col(query_col))
    signals = queries.withColumn("_tokens", query_tokens(q)).withColumns({
        "_n": F.size("_tokens"),
        "_ids": F.size(_identifier_tokens(F.col("_tokens"))),
        "_quoted": q.rlike(QUOTED),
        "_caps": F.exists("_tokens", lambda t: (F.length(t) > 2) & (t == F.upper(t))
                          & (t != F.lower(t))),
        "_measured": q.rlike(CASELESS + MEASUREMENT),
        "_attrs": _hits(q, CASELESS + ATTRIBUTE_CUE),
        "_intent": q.rlike(CASELESS + EXPLORATORY_CUE),
        "_need": q.rlike(CASELESS + NEED_FRAME_CUE),
        "_context": q.rlike(CASELESS + CONTEXT_CUE),
        "_question": q.rlike(CASELESS + QUESTION_CUE),
        "_digitless": ~q.rlike(r"(?U)\d"),
    })
    n, ids = F.col("_n"), F.col("_ids")
    middling, lengthy = (n > 3) & (n <= 8), n > 8
    wordy = F.col("_digitless") & (n >= 4)
    scored = signals.withColumns({
        "_identifier": (
            _points(ids > 0, 2.5 * (ids / F.greatest(n, F.lit(1))) + 1.0)
            + _points(F.col("_quoted"), 1.0) + _points(F.col("_caps"), 0.5)),
        "_attribute": (
            _points(F.col("_measured"), 1.8)
            + 0.7 * F.least(F.col("_attrs"), F.lit(3)) + _points(middling, 0.5)),
        "_exploratory": (
            _points(F.col("_intent"), 2.0) + _points(F.col("_need"), 2.0)
            + _points(F.col("_context"), 2.0) + _points(F.col("_question"), 0.8)
            + _points(lengthy, 0.8) + _points(wordy, 0.4)),
    })
    e, a, i = F.col("_exploratory"), F.col("_attribute"), F.col("_identifier")
    top = F.greatest(e, a, i)
    reasons = F.array_compact(F.array(
        F.when(ids > 0, "identifier token"), F.when(F.col("_quoted"), "quoted phrase"),
        F.when(F.col("_caps"), "uppercase token"), F.when(F.col("_measured"), "measurement"),
        F.when(F.col("_attrs") > 0, "attribute cue"), F.when(middling, "mid-length query"),
        F.when(F.col("_intent"), "intent cue"), F.when(F.col("_need"), "need frame"),
        F.when(F.col("_context"), "usage context"), F.when(F.col("_question"), "question"),
        F.when(lengthy, "long query"), F.when(wordy, "no digits")))
    empty, silent = q == "", top == 0
    return scored.withColumns({
        # Ties go to the earliest of these three.
        "query_class": F.when(empty, EXPLORATORY).when(silent, ATTRIBUTE)
                        .when(e == top, EXPLORATORY).when(a == top, ATTRIBUTE)
                        .otherwise(IDENTIFIER),
        "confidence": F.when(empty | silent, 0.0).otherwise(
            F.bround(F.try_divide(top, e + a + i), 3)),
        "reasons": F.when(empty, F.array(F.lit("blank")))
                    .when(silent, F.array(F.lit("nothing recognised"))).otherwise(reasons),
        "has_identifier": ids > 0,
    }).select(*queries.columns, "query_class", "confidence", "reasons", "has_identifier")


def resolve_alpha(query_class: Column, explicit: Column | None = None,
                  merchant: Column | None = None, tuned: dict[str, float] | None = None,
                  dynamic: bool = True) -> Column:
    """Blend weight: explicit, then the merchant's, then the class's (or a fixed default)."""
    if dynamic:
        by_class = {**PRIOR_ALPHA, **(tuned or {})}
        routed = F.lit(None).cast("double")
        for name, alpha in by_class.items():
            routed = F.when(query_class == name, alpha).otherwise(routed)
    else:
        routed = F.lit(DEFAULT_ALPHA)
    return F.coalesce(*[c.cast("double") for c in (explicit, merchant) if c is not None], routed)


def decide_rerank(query: Column, explicit: Column | None = None, merchant: Column | None = None,
                  default: bool = False) -> Column:
    """Explicit choice, else the preference unless the query holds a product code."""
    preference = F.coalesce(merchant, F.lit(default)) if merchant is not None else F.lit(default)
    by_shape = preference & ~has_identifier_token(query)
    return F.coalesce(explicit, by_shape) if explicit is not None else by_shape


LENGTH_REASON = " words long"


def classify_complexity(message: Column, rounds: Column | None = None) -> Column:
    """struct<tier, reasons> for one message."""
    rounds = F.lit(0) if rounds is None else rounds
    joins = _hits(message, CASELESS + CONSTRAINT_JOIN)
    length = _hits(message, "(?U)" + MESSAGE_TOKEN)
    reasons = F.array_compact(F.array(
        F.when(message.rlike(CASELESS + COMPARISON_CUE), "compares things"),
        F.when(joins >= 2, F.concat(joins.cast("string"), F.lit(" conditions joined"))),
        F.when(length >= LONG_MESSAGE_TOKENS,
               F.concat(length.cast("string"), F.lit(LENGTH_REASON)))))
    late = rounds >= ESCALATE_AFTER_ROUNDS
    return F.struct(
        F.when(late | (F.size(reasons) > 0), "reasoning").otherwise("fast").alias("tier"),
        F.when(late, F.array(F.concat(F.lit("after tool call "), rounds.cast("string"))))
         .when(F.size(reasons) > 0, reasons)
         .otherwise(F.array(F.lit("nothing asks for reasoning"))).alias("reasons"))
