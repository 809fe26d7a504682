"""Scalar columns against tables of (text, expected)."""

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import answers as ans
from shelfspark.functions import numbers as num
from shelfspark.functions import routing
from shelfspark.functions import text as txt
from shelfspark.plans.registry import table


def values(spark, raws, column):
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    return [r.v for r in rows.select("i", column(F.col("raw")).alias("v")).orderBy("i").collect()]


def check(spark, cases, column):
    assert values(spark, [c[0] for c in cases], column) == [c[1] for c in cases]


def test_parse_price(spark):
    """Separators, signs, noise words and texts that are no price, one rule at a time."""
    d = Decimal
    plain = [("87", "87"), ("0", "0"), ("-0", "0"), ("3 070,25", "3070.25"), ("6.480,75", "6480.75"),
             ("6,480.75", "6480.75"), ("7,35", "7.35"), ("7.35", "7.35"), ("2,450", "2450"),
             ("2.450", "2450"), ("3,45,678.5", "345678.5"), ("5'300.5", "5300.5")]
    noisy = [("MRP 640", "640"), ("640 only", "640"), ("740/-", "740"), ("820 (was 990)", "820"),
             ("€ 15,90", "15.90"), ("from 310 to 415", "310"), ("Rs. 2,050.00", "2050")]
    none = [None, "", "  ", "tbd", "N/A", "nil", "----", "??", "ask us", "Out of stock", "-12",
            "USD -3.50", "-2,450.00", "5,600,700", "5.600.700"]
    # Thin and narrow spaces belong to the number, which is then unreadable, not one digit long.
    none += ["2\u2009450,50", "2\u202f450"]
    check(spark, [(raw, d(v)) for raw, v in plain + noisy] + [(raw, None) for raw in none],
          num.parse_price)


def test_detect_currency(spark):
    check(spark, [
        ("cost: usd 7", "USD"), ("7 us$", "USD"), ("$ 7", "USD"), ("₹ 30", "INR"), ("30 rs.", "INR"),
        ("30 INR", "INR"), ("hours 8", "INR"), ("gbp 4", "GBP"), ("£4", "GBP"), ("4 Eur", "EUR"),
        ("€4", "EUR"), ("jpy 900", "JPY"), ("¥900", "JPY"), ("aed 12", "AED"), ("12", None), ("", None),
        (None, None)], num.detect_currency)


def test_clean_text(spark):
    check(spark, [
        ("<h2>Cast <i>iron</i></h2> pan", "Cast iron pan"), ("3 &lt; 4", "3 < 4"),
        ("cr&egrave;me   br&ucirc;l&eacute;e", "crème brûlée"), ("donâ€™t", "don’t"),
        ("ＷＯＫ", "WOK"), ("\t oak \n board ", "oak board"), (None, ""), ("鍋", "鍋"),
        ("smörgås", "smörgås"), ("salt & pepper", "salt & pepper"), ("lid\x1cpot", "lid pot"),
    ], txt.clean_text)
    assert values(spark, ["earthenware", "tin  can"], lambda c: txt.clean_text(c, 5)) == [
        "earth", "tin c"]


def test_mojibake_and_html(spark):
    check(spark, [("donâ€™t", "don’t"), ("crÃ¨me", "crème"), ("鍋 ₹ â", "鍋 ₹ â"), (None, None),
                  ("smörgås", "smörgås")], txt.fix_mojibake)
    assert "boil" in values(spark, ["<script>boil()</script>"], txt.strip_html)[0]


def test_references_without_semicolon(spark):
    """Resolved as a browser does, or left as text where only ended ones count."""
    raw = "<b>pots&amp</b> &copy; 5 &amp;quot; &eacute; &#233; &am"
    assert values(spark, [raw, None], txt.strip_html) == [" pots&  © 5 &quot; é é &am", None]
    assert values(spark, [raw, None], lambda c: txt.strip_html(c, ended=True)) == [
        " pots&amp  © 5 &quot; é é &am", None]
    assert values(spark, [raw, None], lambda c: txt.clean_text(c, ended=True)) == [
        "pots&amp © 5 &quot; é é &am", ""]


def test_every_document_needs_its_repair(spark, sf, monkeypatch):
    """Without the operator, only ASCII texts and those that windows-1252 can't read come out right."""
    from shelfspark.plans import all_queries

    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    asked = []
    monkeypatch.setattr(txt, "fix_mojibake", lambda raw: asked.append(raw) or raw)
    unrepaired = {r["doc_id"]: r["digest"] for r in all_queries()["fix_mojibake"](spark, sf).collect()}
    assert len(asked) == 1 and unrepaired.keys() == texts.keys()
    for doc, text in texts.items():
        try:
            damaged = text.encode().decode("cp1252")
        except UnicodeDecodeError:
            damaged = text
        assert unrepaired[doc] == hashlib.sha256(damaged.encode()).hexdigest()


def test_mojibake_of_every_byte(spark):
    check(spark, [("Ã\x8d", "Ã\x8d"), ("Ã\xad â‚¬", "í €"), ("Ð´", "Ð´")], txt.fix_mojibake)


def test_split_categories(spark):
    cases = [
        ("Kitchen >> Pots >> Lids", ["Kitchen", "Pots", "Lids"]), ("Kitchen > Pots", ["Kitchen", "Pots"]),
        ("kitchen/pots", ["kitchen", "pots"]), ("One | Two", ["One", "Two"]), ("One -> Two", ["One", "Two"]),
        ("One » Two", ["One", "Two"]), ("one\\two", ["one", "two"]), ("Garden", ["Garden"]), ("", []),
        (None, []), ("One >> >> Two", ["One", "Two"]), ("Mugs &amp; Cups / Tea", ["Mugs & Cups", "Tea"])]
    check(spark, cases, txt.split_categories)
    check(spark, [("One > Two", ["One", "Two"]), ("One/Two|Three", ["One", "Two|Three"]), ("  ", [])],
          txt.split_category_path)


def test_parse_bool(spark):
    clean = lambda c: num.parse_bool(txt.clean_text(c))
    check(spark, [("available", True), ("T", True), ("1", True), ("In  STOCK", True), ("yes", True),
                  ("unavailable", False), ("F", False), ("0", False), ("out of  stock", False),
                  ("soon", None), (None, None)], clean)
    assert values(spark, ["soon", None], lambda c: num.parse_bool(txt.clean_text(c), True)) == [
        True, True]


def test_parse_rating(spark):
    check(spark, [("3.7", 3.7), ("0", 0.0), ("7/10", 3.5), ("3/5", 3.0), ("2,5", 2.5), ("9.5", 5.0),
                  ("-2", 0.0), ("good", None), (None, None), ("", None), ("3/0", None), ("3/five", 3.0),
                  ("nan", None), ("2f", None), (" 2 ", 2.0)], num.parse_rating)
    assert values(spark, ["6", "11"], lambda c: num.parse_rating(c, 10.0)) == [3.0, 5.0]


def test_parse_int_and_sku(spark):
    check(spark, [("2,310 votes", 2310), ("45", 45), ("8.6", 8), ("few", None), (None, None), ("-9", -9)],
          num.parse_int)
    check(spark, [(" pot 7 ", "pot 7"), ("POT-7", "POT-7"), ("", None), (" \t", None), (None, None)],
          lambda c: txt.normalise_sku(txt.clean_text(c)))


def test_feed_text_helpers(spark):
    check(spark, [("a ~ b", "a"), (" ~ b", "b"), (" ~ ", None), (None, None)],
          txt.first_of_delimited)
    check(spark, [("https://x/dp/B012345678/r", "B012345678"), ("https://x/dp/b01", None),
                  (None, None)], txt.id_from_url)
    check(spark, [("in Kitchen", "Kitchen"), ("inside", "inside"), (" in  X ", "X"), (None, "")],
          txt.strip_in)


IDENTIFIERS = ["KX-8815C", "B2207", "40M330T", "QZ-2200XR7", "philips hd9252", "Bosch 13UX6600", '"Big Wok 28"']
EXPLORATORY = ["something for a housewarming party", "gift ideas for my neighbour",
               "what should I cook with in a tiny kitchen", "looking for something sturdy and simple",
               "I need something suitable for a camping trip", "way to keep bread fresh", " "]
ATTRIBUTES = ["cast iron pan size 28", "linen apron size M", "750ml glass storage jar", "24 inch 4k monitor",
              "wireless kitchen scale", "Tefal frying pan", "***"]


def test_classify_query(spark):
    cases = [(q, routing.IDENTIFIER) for q in IDENTIFIERS] + [
        (q, routing.EXPLORATORY) for q in EXPLORATORY] + [(q, routing.ATTRIBUTE) for q in ATTRIBUTES]
    rows = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, query string")
    got = {r.query: r for r in routing.classify_query(rows).collect()}
    assert {q: got[q].query_class for q, _ in cases} == dict(cases)
    assert all(got[q].reasons for q, _ in cases)
    assert got["***"].confidence == 0.0 and got[" "].confidence == 0.0
    assert all(0 <= r.confidence <= 1 for r in got.values())


def test_identifier_token(spark):
    check(spark, [("KX-8815C", True), ("no. 20731145", True), ("frying pan", False),
                  ("size 28 pan", False), ("750ml jar", True)], routing.has_identifier_token)


def test_classify_complexity(spark):
    tier = lambda c: routing.classify_complexity(c)["tier"]
    check(spark, [("pans", "fast"), ("blue bowl under 30", "fast"), ("compare wok vs pan", "reasoning"),
                  ("light and cheap and red", "reasoning"), ("pot " * 25, "reasoning"),
                  ("pot " * 24, "fast")], tier)
    late = lambda c: routing.classify_complexity(c, F.lit(2))["tier"]
    assert values(spark, ["pans"], late) == ["reasoning"]


def test_markers(spark):
    check(spark, [(" [[NO_MATCH]] none", True), ("x [[NO_MATCH]]", False)], ans.is_no_match)
    check(spark, [("[[SKU:A-1]] and [[SKU:b]] [[SKU:A-1]]", ["A-1", "b", "A-1"]), ("none", [])],
          ans.cited_skus)
    check(spark, [("[[STAT:10]] [[STAT:-2.5]] [[STAT:x]]", [Decimal(10), Decimal("-2.5")])],
          ans.stat_markers)
    check(spark, [("₹2,450 or 12.5 USD", [Decimal(2450), Decimal("12.5")]), ("Rs. 75", [75]),
                  ("weighs 75", [])], ans.price_mentions)


def test_refusals_and_superlatives(spark):
    check(spark, [("We don't really stock it", True), ("unfortunately gone", True), ("no such bowl", True),
                  ("Take this bowl", False), ("They do not usually sell it", True),
                  ("I couldn't find one", True)], ans.refuses)
    check(spark, [("priciest wok", True), ("bowls under $20", True), ("how many bowls", True),
                  ("which bowl", False), ("at most 4", True)], ans.has_superlative)


def test_vectors_of_different_length_fail(spark):
    from shelfspark.functions.vectors import cosine_similarity
    bad = spark.range(1).select(cosine_similarity(
        F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("s"))
    with pytest.raises(Exception, match="differ in length"):
        bad.collect()


def test_cost(spark):
    from shelfspark.functions.usage import with_cost
    schema = ("model string, input_tokens long, output_tokens long, cache_read_tokens long, "
              "cache_write_tokens long")
    row = spark.createDataFrame([("reasoning", 1000, 100, 500, 200)], schema)
    assert with_cost(row).first().cost_usd == Decimal("0.00360000")
    with pytest.raises(Exception, match="no price for model"):
        with_cost(spark.createDataFrame([("other", 1, 1, 1, 1)], schema)).collect()
