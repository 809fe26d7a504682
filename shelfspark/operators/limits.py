"""Rate limiting as an audit over a request log.

A window opens at a key's first request and lasts a fixed time; the next request at or
after its end opens the next. Each window depends on the one before, so a key is not
simply grouped: its requests are cut into time chunks, every chunk reports where each
possible entry leaves it, and only those short maps are chained per key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.ranks import dense_index

# Requests per window of 60 seconds.
LIMITS = {"ingest": 10, "search": 120, "chat": 20}
WINDOW_SECONDS = 60
CHUNK_WINDOWS = 64


def _followers(codes: np.ndarray, us: np.ndarray, width: int) -> np.ndarray:
    """For rows sorted by key code and time: the row opening the next window, else -1."""
    low = int(us.min())
    step = int(us.max()) - low + width + 1
    place = codes * step + (us - low)
    at = np.searchsorted(place, place + width, "left")
    safe = np.minimum(at, len(us) - 1)
    return np.where((at < len(us)) & (codes[safe] == codes), safe, -1)


def _last_starts(following: np.ndarray) -> np.ndarray:
    """The last window start that a window opening at each row leads to."""
    last = np.where(following >= 0, following, np.arange(len(following)))
    while True:
        jumped = last[last]
        if (jumped == last).all():
            return last
        last = jumped


def anchored_windows(requests: DataFrame, window_seconds: int = WINDOW_SECONDS,
                     chunk_windows: int = CHUNK_WINDOWS, key_buckets: int | None = None
                     ) -> DataFrame:
    """Requests (key, request_id, ts) with the start of the window each falls in (start_us).

    A group holds one time chunk of one hash bucket of keys, so neither a busy key nor a
    long history ends up in one task; ``key_buckets`` defaults to the cluster's cores.
    """
    width = window_seconds * 1_000_000
    span = width * chunk_windows
    buckets = key_buckets or requests.sparkSession.sparkContext.defaultParallelism
    rows = requests.select(
        "key", "request_id", "ts", F.unix_micros("ts").alias("us"),
        F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("slot")).withColumn(
        "chunk", F.floor(F.col("us") / F.lit(span)))

    def leave(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["key", "us"])
        part = part.assign(code=pd.factorize(part["key"])[0]).sort_values(["code", "us"])
        codes, us = part["code"].to_numpy(), part["us"].to_numpy()
        exits = us[_last_starts(_followers(codes, us, width))]
        # A carried window ends inside the first width of the chunk: what may open the next
        # one is a row there or the first row after it.
        late = us >= group[1] * span + width
        first_late = late & ~(np.roll(late, 1) & (np.roll(codes, 1) == codes))
        first_late[0] = late[0]
        kept = ~late | first_late
        keys, codes, us, exits = part["key"].to_numpy()[kept], codes[kept], us[kept], exits[kept]
        ends = np.append((codes[1:] != codes[:-1]) | (exits[1:] != exits[:-1]), True)
        return pd.DataFrame({"key": keys[ends], "slot": group[0], "chunk": group[1],
                             "entry_us": us[ends], "exit_us": exits[ends]})

    def chain(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "chunk", "entry_us"])
        out, carry, entered, at = [], None, False, (None, None)
        for key, chunk, entry, exit_us in zip(part["key"], part["chunk"], part["entry_us"],
                                              part["exit_us"], strict=True):
            if key != at[0]:
                carry = None
            if (key, chunk) != at:
                out.append((key, group[0], chunk, carry))
                at, entered = (key, chunk), False
            if not entered and (carry is None or entry >= carry + width):
                carry, entered = exit_us, True
        return pd.DataFrame(out, columns=["key", "slot", "chunk", "carry_us"]).astype(
            {"carry_us": "Int64"})

    def assign(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(code=pd.factorize(part["key"])[0]).sort_values(
            ["code", "us", "request_id"])
        codes, us = part["code"].to_numpy(), part["us"].to_numpy()
        none = np.iinfo("int64").min // 2
        carry = part["carry_us"].fillna(none).to_numpy("int64")
        following = _followers(codes, us, width)
        free = us >= carry + width
        same_key = np.append(False, codes[1:] == codes[:-1])
        front = np.flatnonzero(free & ~(np.append(False, free[:-1]) & same_key))
        opened = np.zeros(len(us), dtype=bool)
        while len(front):
            opened[front] = True
            front = following[front]
            front = front[front >= 0]
        key_start = np.flatnonzero(~same_key)[codes]
        latest = np.maximum.accumulate(np.where(opened, np.arange(len(us)), -1))
        start = np.where(latest >= key_start, us[np.maximum(latest, 0)], carry)
        return part.assign(start_us=start)[["key", "request_id", "ts", "us", "chunk", "start_us"]]

    types = dict(requests.dtypes)
    key_type, id_type = types["key"], types["request_id"]
    exits = rows.groupBy("slot", "chunk").applyInPandas(
        leave, f"key {key_type}, slot int, chunk long, entry_us long, exit_us long")
    carried = exits.groupBy("slot").applyInPandas(
        chain, f"key {key_type}, slot int, chunk long, carry_us long")
    return rows.join(carried, ["key", "slot", "chunk"]).groupBy("slot", "chunk").applyInPandas(
        assign, f"key {key_type}, request_id {id_type}, ts timestamp, us long, chunk long, "
                "start_us long")


def rate_limit(requests: DataFrame, limit: int, window_seconds: int = WINDOW_SECONDS,
               chunk_windows: int = CHUNK_WINDOWS, key_buckets: int | None = None) -> DataFrame:
    """Every request with window_start, count, allowed and retry_after seconds.

    Rejected requests count as well.
    """
    placed = anchored_windows(requests, window_seconds, chunk_windows, key_buckets)
    counted = dense_index(placed, ["key", "start_us"], [F.col("us"), F.col("request_id")],
                          F.col("chunk"), "count")
    left = F.col("start_us") + window_seconds * 1_000_000 - F.col("us")
    allowed = F.col("count") <= limit
    return counted.select(
        "key", "request_id", "ts", F.timestamp_micros("start_us").alias("window_start"), "count",
        allowed.alias("allowed"),
        F.when(allowed, 0).otherwise(F.ceil(left / F.lit(1_000_000))).cast("long")
         .alias("retry_after"))


def clock_windows(requests: DataFrame, limit: int, window_seconds: int = WINDOW_SECONDS
                  ) -> DataFrame:
    """The clock-aligned variant: requests per key and window, and how many pass the limit."""
    return requests.groupBy("key", F.window("ts", f"{window_seconds} seconds").alias("w")).agg(
        F.count("*").alias("n")).select(
        "key", F.col("w.start").alias("window_start"), "n",
        F.greatest(F.lit(0), F.col("n") - limit).alias("rejected"))
