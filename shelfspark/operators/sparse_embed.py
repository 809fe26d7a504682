"""Sparse hashed TF-IDF vectors, from DataFrame functions alone unless ``counts_in_tasks`` counts the tokens.

Tokens fall into ``dimensions`` buckets. Each tenant learns how many of its texts hold each bucket; a
text's weights are its counts times the logarithm of the inverse frequency, scaled to unit length and
kept as (index, weight) pairs in index order, so a vector is as long as its text has buckets. Texts
of tenants that were not learned have no vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import word_tokens, words
from shelfspark.functions.vectors import Buckets
from shelfspark.operators.ranks import spread_join
from shelfspark.session import materialise

DIMENSIONS = 256
#: Weights of more tenants than this are not broadcast.
TENANTS = 5_000
_PAIRS = "array<struct<at: int, w: double>>"


def buckets(text: Column, dimensions: int = DIMENSIONS, prefix: str = "") -> Column:
    """The bucket of each token, ascending; ``prefix`` is an instruction put before the text."""
    def bucket(token: Column) -> Column:
        return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dimensions).cast("int")

    told = F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))
    return F.array_sort(F.transform(word_tokens(told), bucket))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def counted(ordered: Column) -> Column:
    """Runs of equal values of an ascending array: at and n, in one pass over it."""
    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                         lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
        found = once(first, lambda starts: F.transform(starts, lambda i, k: F.struct(
            F.get(s, i).alias("at"), (F.coalesce(F.get(starts, k + 1), F.size(s)) - i).alias("n"))))
        return F.when(F.size(s) > 0, found).otherwise(F.array().cast("array<struct<at: int, n: int>>"))

    return once(ordered, runs)


def counts_in_tasks(dimensions: int = DIMENSIONS, prefix: str = "") -> Callable[[Column], Column]:
    """The same runs of buckets from text, by array code in Arrow batches; each token is hashed once."""
    @F.arrow_udf("array<struct<at: int, n: int>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Buckets(dimensions)
        for texts in batches:
            places, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for text in texts.to_pylist():
                memo.trim()
                n = np.bincount(np.fromiter(map(memo.__getitem__, words(prefix + (text or ""))), np.int64),
                                minlength=dimensions)
                places.append(np.flatnonzero(n))
                counts.append(n[places[-1]])
            offsets = np.cumsum([len(p) for p in places])
            at, n = (np.concatenate(c).astype(np.int32) for c in (places, counts))
            yield pa.ListArray.from_arrays(
                offsets.astype(np.int32), pa.StructArray.from_arrays([pa.array(at), pa.array(n)], ["at", "n"]))

    return count


def learn(texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS,
          counts: Callable[[Column], Column] | None = None) -> DataFrame:
    """tenant, n_texts, and ``idf``: the weight of each bucket, null for those no text of the tenant
    holds; ``dimensions`` entries. ``counts`` counts the buckets of a text, if given."""
    found = F.array_distinct(buckets(F.col(text), dimensions)) if counts is None else F.col("_counts.at")
    rows = texts if counts is None else texts.select("tenant", counts(F.col(text)).alias("_counts"))
    held = rows.select("tenant", found.alias("held"))
    sizes = held.groupBy("tenant").agg(F.count("*").alias("n_texts"))
    # The outer form keeps the optimizer from testing the size first, which would hash twice.
    seen = held.select("tenant", F.explode_outer("held").alias("at")).where(F.col("at").isNotNull())
    weight = F.log((1 + F.col("n_texts")) / (1 + F.col("df"))) + 1
    weighed = seen.groupBy("tenant", "at").agg(F.count("*").alias("df")).join(sizes, "tenant").select(
        "tenant", "n_texts", F.struct("at", weight.alias("idf")).alias("e"))
    maps = weighed.groupBy("tenant", "n_texts").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    return maps.select("tenant", "n_texts", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)),
                                                        lambda i: F.try_element_at("m", i)).alias("idf"))


def embed(rows: DataFrame, learned: DataFrame, text: str = "text", name: str = "sparse",
          dimensions: int = DIMENSIONS, prefix: str = "",
          counts: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with their vector. A bucket that the tenant never saw counts as held by no text.
    ``counts``, if given, counts the buckets of a text, the prefix included."""
    told = rows if counts is None else rows.withColumn("_counts", counts(F.col(text)))
    known = materialise(learned.select("tenant", "idf", (F.log(1 + F.col("n_texts")) + 1).alias("_new")))
    # One tenant may hold most of the rows: they stay where they are, or are spread.
    found = told.join(F.broadcast(known), "tenant") if known.count() <= TENANTS else spread_join(
        told, known, ["tenant"], F.col(text))

    def scaled(raw: Column) -> Column:
        length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda total, p: total + p["w"] * p["w"]))
        return once(length, lambda size: F.transform(
            raw, lambda p: F.struct(p["at"].alias("at"), (p["w"] / size).alias("w"))))

    runs = counted(buckets(F.col(text), dimensions, prefix)) if counts is None else F.col("_counts")
    weighed = F.transform(runs, lambda p: F.struct(
        p["at"].alias("at"), (p["n"] * F.coalesce(F.get("idf", p["at"]), F.col("_new"))).alias("w")))
    return found.withColumn(name, once(weighed, scaled).cast(_PAIRS)).drop("_new", "idf", "_counts")


def product(left: Column, right: Column) -> Column:
    """Dot product of two sparse vectors."""
    by_index = F.map_from_entries(right)
    return F.aggregate(left, F.lit(0.0), lambda total, p: total + p["w"] * F.coalesce(
        F.try_element_at(by_index, p["at"]), F.lit(0.0)))


def dense(sparse: Column, dimensions: int = DIMENSIONS) -> Column:
    """The vector as an array of floats, for engines that take one."""
    by_index = F.map_from_entries(sparse)
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(
        F.try_element_at(by_index, i), F.lit(0.0)).cast("float"))
