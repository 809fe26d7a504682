"""Answer-cache lookups replayed over a log of stores, queries and invalidations.

A tenant's cache holds its newest entries; the whole list expires a fixed time after the
last store, and an invalidation empties it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.vectors import cosine_similarity
from shelfspark.operators.ranks import dense_index, running
from shelfspark.session import materialise

# Fixed values.
RING = 200
TTL_SECONDS = 24 * 60 * 60
THRESHOLD = 0.95

QUERY, INVALIDATE, STORE = 0, 1, 2


def _timeline(stores: DataFrame, queries: DataFrame, invalidations: DataFrame | None) -> DataFrame:
    def rows(frame: DataFrame, kind: int, id_: Column) -> DataFrame:
        return frame.select("tenant", F.unix_micros("ts").alias("us"), F.lit(kind).alias("kind"),
                            id_.cast("string").alias("id"))

    parts = rows(stores, STORE, F.col("store_id")).unionByName(
        rows(queries, QUERY, F.col("qid")))
    if invalidations is not None:
        parts = parts.unionByName(rows(invalidations, INVALIDATE, F.lit("")))
    return parts


def visible_entries(stores: DataFrame, queries: DataFrame, invalidations: DataFrame | None = None,
                    ring: int = RING, ttl_seconds: int = TTL_SECONDS
                    ) -> tuple[DataFrame, DataFrame]:
    """Numbered stores, and for each query the range of numbers it can see.

    Only keys and times take part; the vectors stay out of these shuffles.
    """
    order = [F.col("us"), F.col("kind"), F.col("id")]
    day = F.floor(F.col("us") / F.lit(86_400_000_000))
    us, ttl = F.col("us"), ttl_seconds * 1_000_000
    is_store = F.col("kind") == STORE
    before = running(
        _timeline(stores, queries, invalidations), ["tenant"], order, day,
        sums={"n_before": F.when(is_store, 1).otherwise(0)},
        maxima={"last_store": F.when(is_store, us),
                "last_inval": F.when(F.col("kind") == INVALIDATE, us)}, inclusive=False)
    cleared = F.coalesce(F.col("last_inval") > F.col("last_store"), F.lit(False))
    alive = F.coalesce(us - F.col("last_store") < ttl, F.lit(False)) & ~cleared
    numbered = before.withColumns({
        "index": F.coalesce("n_before", F.lit(0)) + F.when(is_store, 1).otherwise(0),
        "alive": alive})
    sessions = running(numbered, ["tenant"], order, day, maxima={
        "session_start": F.when(is_store & ~F.col("alive"), F.col("index"))})
    entries = numbered.where(is_store).select("tenant", F.col("id").alias("store_id"), "index")
    seen = sessions.where((F.col("kind") == QUERY) & F.col("alive")).select(
        "tenant", F.col("id").alias("qid"),
        F.greatest("session_start", F.col("index") - (ring - 1)).alias("first"),
        F.col("index").alias("last"))
    return entries, seen


def cache_lookup(stores: DataFrame, queries: DataFrame, invalidations: DataFrame | None = None,
                 threshold: float = THRESHOLD, ring: int = RING,
                 ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Best cached answer per query that hits: (tenant, qid, store_id, similarity).

    stores: tenant, store_id, ts, embedding. queries: tenant, qid, ts, embedding. A query
    meets only the blocks of ``ring`` entries its range touches; the newest entry wins a tie.
    """
    entries, seen = visible_entries(stores, queries, invalidations, ring, ttl_seconds)
    held = entries.join(stores.select("tenant", F.col("store_id").cast("string").alias("store_id"),
                                      F.col("embedding").alias("_sv")), ["tenant", "store_id"])
    asked = seen.join(queries.select("tenant", F.col("qid").cast("string").alias("qid"),
                                     F.col("embedding").alias("_qv")), ["tenant", "qid"])
    block = F.floor(F.col("index") / F.lit(ring))
    reach = F.sequence(F.floor(F.col("first") / F.lit(ring)), F.floor(F.col("last") / F.lit(ring)))
    met = held.withColumn("_block", block).join(
        asked.withColumn("_block", F.explode(reach)), ["tenant", "_block"]).where(
        F.col("index").between(F.col("first"), F.col("last")))
    scored = met.withColumn("similarity", F.round(
        cosine_similarity(F.col("_qv"), F.col("_sv")), 9)).where(
        F.col("similarity") >= threshold)
    best = scored.groupBy("tenant", "qid").agg(F.max(F.struct(
        "similarity", "index", "store_id")).alias("_b"))
    return best.select("tenant", "qid", "_b.store_id", "_b.similarity")


# --- what-if replay -------------------------------------------------------------------

CHUNK_ROWS = 512
_STATE = "ring array<struct<id: string, embedding: array<double>>>, stored_at long"
_REPLAYED = ("tenant string, chunk long, entered string, left string, "
             f"hits array<struct<qid: string, store_id: string, similarity: double>>, {_STATE}")


@dataclass
class Ring:
    """A tenant's cache as it stands: entries from old to new, and when the last was stored."""

    threshold: float
    size: int
    ttl: int
    #: Whether a query that misses is stored itself.
    replay: bool
    entries: list[tuple[str, np.ndarray]] = field(default_factory=list)
    stored_at: int | None = None

    def clear(self) -> None:
        self.entries, self.stored_at = [], None

    def step(self, kind: int, us: int, id_: str, vector) -> tuple[str, float] | None:
        """The effect of one event; the entry that answers it, if one does."""
        if self.stored_at is not None and us - self.stored_at >= self.ttl:
            self.clear()
        if kind == INVALIDATE:
            self.clear()
            return None
        value, hit = np.asarray(vector, dtype="float64"), None
        if kind == QUERY and self.entries:
            scores = np.round(np.stack([v for _, v in self.entries]) @ value, 9)
            best = len(scores) - 1 - int(np.argmax(scores[::-1]))
            if scores[best] >= self.threshold:
                hit = self.entries[best][0], float(scores[best])
        if kind == STORE or (self.replay and kind == QUERY and hit is None):
            self.entries = [*self.entries, (id_, value)][-self.size:]
            self.stored_at = us
        return hit

    def digest(self) -> str:
        told = "\n".join([str(self.stored_at), *(id_ for id_, _ in self.entries)])
        return hashlib.sha256(told.encode()).hexdigest()


@dataclass
class Replay:
    """Hits of a replay, how many chunks ran in each round, and the cache each tenant was left with."""

    hits: DataFrame
    rounds: list[int]
    state: DataFrame


def replay(events: DataFrame, threshold: float = THRESHOLD, ring: int = RING,
           ttl_seconds: int = TTL_SECONDS, chunk_rows: int = CHUNK_ROWS, misses_stored: bool = True,
           begun: DataFrame | None = None) -> Replay:
    """The log of each tenant replayed in order, by many tasks: (tenant, qid, store_id, similarity).

    events: tenant, kind (0 query, 1 invalidate, 2 store), id, ts, embedding. ``begun`` (tenant, ring, stored_at)
    is the state that an earlier replay left, for logs that come in parts. A tenant's log is cut into chunks of ``chunk_rows`` events, all replayed at once from a guess of the cache they begin with (an
    empty one). A chunk whose guess differs from what its predecessor left is replayed from that; this
    goes on until no guess differs. Then each chunk began with what the one before it left, and the
    first one with nothing, as in one sequential replay. A cache that is emptied, outlived or filled
    anew within a chunk no longer depends on the guess, so few rounds are the rule; in the worst
    case there are as many as a tenant has chunks. Events of one time go queries first, then by id.
    """
    us = F.unix_micros("ts").alias("us")
    rows = events.select("tenant", us, "kind", F.col("id").cast("string").alias("id"), "embedding")
    order = [F.col("us"), F.col("kind"), F.col("id")]
    numbered = dense_index(rows, ["tenant"], order, F.floor(F.col("us") / F.lit(86_400_000_000)), "place")
    chunked = materialise(numbered.withColumn("chunk", F.floor((F.col("place") - 1) / F.lit(chunk_rows))))
    spark = events.sparkSession
    keys = ["tenant", "chunk"]

    def run(key: tuple, part: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        cache = Ring(threshold, ring, ttl_seconds * 1_000_000, misses_stored)
        if len(state):
            cache.entries = [(e["id"], np.asarray(e["embedding"])) for e in state["ring"][0]]
            at = state["stored_at"][0]
            cache.stored_at = None if pd.isna(at) else int(at)
        entered, hits = cache.digest(), []
        part = part.sort_values("place")
        for kind, at, id_, vector in zip(part["kind"], part["us"], part["id"], part["embedding"], strict=True):
            hit = cache.step(kind, int(at), id_, vector)
            if hit:
                hits.append({"qid": id_, "store_id": hit[0], "similarity": hit[1]})
        entries = [{"id": i, "embedding": v.tolist()} for i, v in cache.entries]
        return pd.DataFrame([(key[0], key[1], entered, cache.digest(), hits, entries, cache.stored_at)],
                            columns=["tenant", "chunk", "entered", "left", "hits", "ring", "stored_at"]
                            ).astype({"stored_at": "Int64"})

    def replayed(part: DataFrame, states: DataFrame) -> DataFrame:
        return materialise(part.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(run, _REPLAYED))

    first = begun or spark.createDataFrame([], f"tenant string, {_STATE}")
    done = replayed(chunked, first.select("tenant", F.lit(0).cast("long").alias("chunk"), "ring", "stored_at"))
    rounds = [done.count()]
    while True:
        before = done.select("tenant", (F.col("chunk") + 1).alias("chunk"), "left", "ring", "stored_at")
        wrong = materialise(done.select(*keys, "entered").join(before, keys).where("entered <> left")
                            .select(*keys, "ring", "stored_at"))
        count = wrong.count()
        if not count:
            break
        rounds.append(count)
        again = replayed(chunked.join(wrong.select(*keys), keys, "left_semi"), wrong)
        done = materialise(done.join(again.select(*keys), keys, "left_anti").unionByName(again))
    hits = done.select("tenant", F.explode("hits").alias("h")).select("tenant", "h.*")
    last = done.groupBy("tenant").agg(F.max("chunk").alias("chunk"))
    state = done.join(last, keys, "left_semi").select("tenant", "ring", "stored_at")
    return Replay(hits, rounds, state)
