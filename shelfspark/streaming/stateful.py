"""Stateful stream operators: rate limiter, answer cache, conversation state.

The limiter's and the cache's state can end by event time: with a ``lateness`` the stream carries a
watermark, rows behind it are dropped, and a timer clears a key when its window or its entries'
lifetime is over. Without one, state stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfspark.operators.answer_cache import RING, THRESHOLD, TTL_SECONDS, Ring
from shelfspark.session import SETTINGS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

LIMIT_OUTPUT = ("key string, request_id long, ts timestamp, window_start timestamp, count long, "
                "allowed boolean, retry_after long")
CACHE_OUTPUT = "tenant string, qid string, store_id string, similarity double"
CONVERSATION_OUTPUT = "conv_id long, turn long, n_messages long, n_user long, n_chars long"


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype("int64")


class Ending(StatefulProcessor):
    """A processor whose state for a key may end at a time of its own."""

    ends = False

    def end_at(self, us: int) -> None:
        """Clear the key's state when the watermark has passed this time, and at no other."""
        if self.ends:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(us // 1000 + 1)

    def clear(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter([])

    def close(self) -> None:
        pass


class RateLimiter(Ending):
    """Counter per key in a window anchored at its first request."""

    def __init__(self, limit: int, window_seconds: int, ends: bool = False):
        self.limit, self.width, self.ends = limit, window_seconds * 1_000_000, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start_us long, count long")

    def clear(self) -> None:
        self.window.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        start, count = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for at, us, request in zip(batch["ts"], _micros(batch["ts"]), batch["request_id"],
                                   strict=True):
            us = int(us)
            if start is None or us >= start + self.width:
                start, count = us, 0
            count += 1
            allowed = count <= self.limit
            wait = 0 if allowed else -(-(start + self.width - us) // 1_000_000)
            out.append((str(key[0]), request, at, pd.Timestamp(start, unit="us"), count, allowed,
                        wait))
        self.window.update((start, count))
        self.end_at(start + self.width)
        yield pd.DataFrame(out, columns=["key", "request_id", "ts", "window_start", "count",
                                         "allowed", "retry_after"])


class AnswerCache(Ending):
    """Ring of the newest answers per tenant; each store renews the list's lifetime.

    With ``replay`` on, a query that misses is stored itself, as the live service would.
    """

    def __init__(self, threshold: float = THRESHOLD, ring: int = RING,
                 ttl_seconds: int = TTL_SECONDS, replay: bool = False, ends: bool = False):
        self.settings, self.ends = (threshold, ring, ttl_seconds * 1_000_000, replay), ends

    def clear(self) -> None:
        self.entries.clear()
        self.stored_at.clear()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "store_id string, embedding array<double>")
        self.stored_at = handle.getValueState("stored_at", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows)).sort_values(["ts", "kind", "id"])
        cache = Ring(*self.settings)
        if self.entries.exists():
            cache.entries = [(e[0], np.asarray(e[1])) for e in self.entries.get()]
        cache.stored_at = self.stored_at.get()[0] if self.stored_at.exists() else None
        out = []
        for kind, us, id_, vector in zip(batch["kind"], _micros(batch["ts"]), batch["id"],
                                         batch["embedding"], strict=True):
            hit = cache.step(kind, int(us), id_, vector)
            if hit:
                out.append((str(key[0]), id_, *hit))
        if cache.entries:
            self.entries.put([(id_, vector.tolist()) for id_, vector in cache.entries])
            self.stored_at.update((cache.stored_at,))
            self.end_at(cache.stored_at + cache.ttl)
        else:
            self.clear()
        yield pd.DataFrame(out, columns=["tenant", "qid", "store_id", "similarity"])


class ConversationState(StatefulProcessor):
    """Counts of a conversation so far, carried between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "messages long, users long, chars long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows)).sort_values("turn")
        messages, users, chars = self.totals.get() if self.totals.exists() else (0, 0, 0)
        result = pd.DataFrame({
            "conv_id": key[0], "turn": batch["turn"],
            "n_messages": messages + np.arange(1, len(batch) + 1),
            "n_user": users + (batch["role"] == "user").cumsum(),
            "n_chars": chars + batch["text"].str.len().cumsum()})
        last = result.iloc[-1]
        self.totals.update((int(last["n_messages"]), int(last["n_user"]), int(last["n_chars"])))
        yield result

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, output: str,
           lateness: str | None = None) -> DataFrame:
    """The processor over the rows of each key; its state needs the RocksDB store."""
    rows.sparkSession.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy(key).transformWithStateInPandas(
        processor, output, "Append", "EventTime" if lateness else "None")


def rate_limit_stream(requests: DataFrame, limit: int, window_seconds: int,
                      lateness: str | None = None) -> DataFrame:
    """requests: key, request_id, ts."""
    return _keyed(requests, "key", RateLimiter(limit, window_seconds, bool(lateness)), LIMIT_OUTPUT, lateness)


def answer_cache_stream(events: DataFrame, lateness: str | None = None, **options) -> DataFrame:
    """events: tenant, kind (0 query, 1 invalidate, 2 store), id, ts, embedding."""
    return _keyed(events, "tenant", AnswerCache(**options, ends=bool(lateness)), CACHE_OUTPUT, lateness)


def conversation_stream(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, text."""
    return _keyed(messages, "conv_id", ConversationState(), CONVERSATION_OUTPUT)
