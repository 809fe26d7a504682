"""Quality rules with DataFrame functions only: base counts, then a likelihood ratio of n-grams.

Words are the runs without white space; a document's n-grams are its words and its pairs of
neighbouring words, hashed into ``BUCKETS`` buckets. One multinomial is counted over the trusted
documents, one over the whole corpus; scaled to the trusted total, both get the same pseudo-count,
so buckets with little evidence say little. A document's score is the mean over its n-grams of the
logarithm of the ratio of the two, and every document with a score of at least ``threshold`` is kept
that didn't fail the base rules. Nothing is drawn at random.

The trusted documents are all those labelled good and never bad or toxic; both multinomials count
whole texts of all their documents.

Cases: null and empty texts have no words and fail the base rules, with score 0; trusted ids may
repeat; without a trusted document every score is 0 and the base rules alone decide; repeated rows
are judged alike; further columns of ``docs`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import materialise

BUCKETS = 1 << 16
#: Up to so many trusted ids (some 50 MB in a hash table) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
PSEUDO_COUNT = 2.0
THRESHOLD = -0.08
MIN_WORDS = 50
MILLION = 1_000_000
#: A document fails with more than this share of its words in repeated windows.
MAX_REPEAT_PERCENT = 50
#: Fixed values of the rules.
SPACES = " \t\n\x0b\f\r"
SPACE_RUNS = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, even inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUNS), "")


def repeated_words(hashes: Column) -> Column:
    """Words in windows of three that occur twice or more, by the hashes of all words.

    Windows are sorted with their places; equal neighbours are repeats; each repeat adds the words
    up to the next one, three at most.
    """
    def covered(places: Column) -> Column:
        gaps = F.aggregate(
            F.sequence(F.lit(1), F.size(places) - 1), F.lit(3),
            lambda n, k: n + F.least(F.lit(3), places[k] - places[k - 1]))
        return F.when(F.size(places) == 0, 0).when(F.size(places) == 1, 3).otherwise(gaps)

    def repeats(s: Column) -> Column:
        same = F.filter(s, lambda w, k: (w["h"] == F.get(s, k - 1)["h"])
                        | (w["h"] == F.get(s, k + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda w: w["i"])), covered)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - 2),
                           lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2]))

    def count(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(placed, repeats))

    return F.when(F.size(hashes) < 3, 0).otherwise(let(let(hashes, windows), count))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def with_hashes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, text (never null) and the hashes of its words."""
    safe = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc).alias("doc_id"), safe.alias("text"), F.transform(
        words_of(safe), lambda w: F.xxhash64(w)).alias("hashes"))


def pair_hashes(h: Column) -> Column:
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))),
                       lambda x, i: F.xxhash64(x, h[i + 1]))


def grams_of(hashes: Column) -> Column:
    """Hashes of all words and of all pairs of neighbouring words."""
    return let(hashes, lambda h: F.concat(h, pair_hashes(h)))


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def bucket_ratios(hashed: DataFrame, trusted: DataFrame, buckets: int = BUCKETS,
                  pseudo: float = PSEUDO_COUNT) -> DataFrame:
    """``bucket`` and ``ratio``, the logarithm of the ratio of both multinomials in millionths.

    ``trusted`` holds the ids (``doc_id``) of the trusted documents, each once. Whole millionths make
    sums of ratios the same in any order.
    """
    good = materialise(trusted.withColumn("good", F.lit(1)))
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    marked = hashed.select("doc_id", "hashes").join(good, "doc_id", "left")
    grams = marked.select("good", F.explode(grams_of(F.col("hashes"))).alias("gram"))
    counts = materialise(grams.groupBy(bucket_of(F.col("gram"), buckets).alias("bucket")).agg(
        F.count("*").alias("raw"), F.count("good").alias("target")))
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    scale = (total["target"] or 0) / (total["raw"] or 1)
    ratio = F.log((F.col("target") + pseudo) / (F.col("raw") * scale + pseudo))
    return counts.select("bucket", F.round(ratio * MILLION).cast("long").alias("ratio"))


def trusted_ids(labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Ids labelled good and never bad or toxic."""
    agreed = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc_id")).agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return agreed.where("q = 1 AND coalesce(t, 0) = 0").select("doc_id")


def rule_report(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text",
                threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Per document: the base counts, base_failed, the score ``llr`` and kept."""
    hashed = with_hashes(docs, doc, text)
    ratios = bucket_ratios(hashed, trusted_ids(labels), buckets)
    h, t = F.col("hashes"), F.col("text")
    base = hashed.select(
        # Ids of documents may repeat; this one is the row's, and a task run again gives it again.
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.size(h).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE_RUNS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        repeated_lines(t).cast("long").alias("n_dup_lines"),
        repeated_words(h).cast("long").alias("n_repeat_words"),
        grams_of(h).alias("grams"))
    counts = [c for c in base.columns if c != "grams"]
    # A row's n-grams are summed in the task that made them; one row a document is shuffled. The
    # table of ratios has at most `buckets` rows.
    summed = (base.select(*counts, F.explode_outer("grams").alias("gram"))
              .select(*counts, bucket_of(F.col("gram"), buckets).alias("bucket"))
              .join(F.broadcast(ratios), "bucket", "left")
              .groupBy(*counts).agg(F.coalesce(F.sum("ratio"), F.lit(0)).alias("total")))
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return (summed.withColumn("llr", F.when(n == 0, 0.0).otherwise(F.col("total") / MILLION / (2 * n - 1)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("llr") >= threshold)).drop("row", "total"))
