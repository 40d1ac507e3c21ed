"""Token buckets, one a client: a batch fold and the same fold as keyed state of a stream.

A bucket starts full and refills lazily. A request is allowed if the tokens cover its cost; a denied one still leaves the
refilled tokens behind. A cost over the capacity is denied for ever and leaves the bucket alone. Time never runs backwards:
a late request refills nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "client string, event_id long, allowed boolean, tokens double, retry_after double"
STATE = "tokens double, last double"


class Bucket:
    def __init__(self, rate: float, capacity: float, tokens: float | None = None, last: float | None = None):
        if rate <= 0 or capacity <= 0:
            raise ValueError("rate and capacity must be positive")
        self.rate, self.capacity, self.last = rate, capacity, last
        self.tokens = capacity if tokens is None else tokens

    def allow(self, now: float, cost: float) -> tuple[bool, float | None]:
        """Whether a request passes, and after how many seconds it would (None: never)."""
        if cost > self.capacity:
            return False, None
        if self.last is not None:
            self.tokens = min(self.capacity, self.tokens + max(0.0, now - self.last) * self.rate)
        self.last = now if self.last is None else max(now, self.last)
        if self.tokens >= cost:
            self.tokens -= cost
            return True, 0.0
        return False, (cost - self.tokens) / self.rate


def retry_after(seconds: float | None) -> int | None:
    """The header's value: whole seconds, 1 at least; none if the request can never pass."""
    return None if seconds is None or math.isinf(seconds) else max(1, round(seconds))


def _fold(bucket: Bucket, client: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for event, now, cost in rows.sort_values(["seconds", "event_id"])[["event_id", "seconds", "cost"]].itertuples(index=False):
        allowed, wait = bucket.allow(now, cost)
        out.append((client, event, allowed, bucket.tokens, wait))
    return pd.DataFrame(out, columns=["client", "event_id", "allowed", "tokens", "retry_after"])


def limit(requests: DataFrame, rate: float, capacity: float) -> DataFrame:
    """The decision on each of requests(client, event_id, seconds, cost), folded by client in the order of time and id."""
    Bucket(rate, capacity)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        return _fold(Bucket(rate, capacity), key[0], rows)

    return requests.select("client", "event_id", "seconds", "cost").groupBy("client").applyInPandas(run, OUT)


def limit_stream(requests: DataFrame, rate: float, capacity: float) -> DataFrame:
    """As `limit` on a stream: what is left of a client's bucket is its state between micro-batches."""
    Bucket(rate, capacity)

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = Bucket(rate, capacity, *(state.get if state.exists else (None, None)))
        out = _fold(bucket, key[0], pd.concat(list(parts)))
        state.update((bucket.tokens, bucket.last))
        yield out

    rows = requests.select("client", "event_id", "seconds", "cost")
    return rows.groupBy("client").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def from_events(events: DataFrame, costs: dict[str, float]) -> DataFrame:
    """Requests(client, event_id, seconds, cost) of events(event_id, ts, user_id, event_type)."""
    cost = F.lit(1.0)
    for kind, value in costs.items():
        cost = F.when(F.col("event_type") == kind, F.lit(float(value))).otherwise(cost)
    return events.select(F.col("user_id").cast("string").alias("client"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), cost.alias("cost"))
