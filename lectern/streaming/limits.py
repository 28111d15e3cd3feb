"""Quotas and rate limits: one rule each, as a fold over a key's rows in order, for a stream or a whole table.

A sliding log lets a hit through if fewer than `limit` accepted ones lie in the window before it; rejected hits aren't
logged. A daily quota lets a request of some units through if they fit beside those accepted on the key's UTC day; one
that doesn't fit is skipped, and a smaller one after it may still pass.

As streams they keep state for each key (`transformWithStateInPandas`): the log as a list of at most `limit` instants, the
day's units as a value and the units by feature as a map. An event-time timer clears what the watermark has left behind, so
keys that stay away cost nothing. A batch's rows of one key are put in order before the fold; a row that comes in a
later batch than rows after it is judged by what was accepted before it came. The stream's session needs the
RocksDB provider of state stores (`STORE`). As tables the same folds run over rows sorted within tasks, which keep no more.

Cases: hits of a null key or instant are rejected; a request is invalid, and changes nothing, if its units aren't from 1
to the limit or its feature isn't of 1 to 50 characters (null too); ties of an instant go by id; empty tables give no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting that streams with such state need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY, FEATURE = 86_400.0, 50
HIT = "key bigint, id bigint, at double, accepted boolean, retry_after bigint"
USAGE = "key bigint, id bigint, at double, feature string, units bigint, problem string, accepted boolean, used bigint, remaining bigint, retry_after bigint"


@dataclass
class Log:
    """The instants of a key's accepted hits in the window."""

    limit: int
    window: float
    times: list[float] = field(default_factory=list)

    def hit(self, at: float | None) -> tuple[bool, int | None]:
        """Whether a hit passes; else the whole seconds after which the oldest one leaves the window, 1 at least."""
        if at is None or at != at:
            return False, None
        self.times = [t for t in self.times if t > at - self.window]
        if len(self.times) >= self.limit:
            return False, max(1, int(self.times[0] + self.window - at) + 1)
        self.times.append(at)
        return True, None


@dataclass
class Usage:
    """A key's accepted units on a UTC day, all and by feature."""

    limit: int
    day: int | None = None
    used: int = 0
    features: dict[str, int] = field(default_factory=dict)

    def request(self, at: float | None, feature: str | None, units: int | None) -> tuple[str | None, bool, int, int, int | None]:
        """(problem, accepted, used, remaining, retry_after)."""
        if at is None or at != at:
            return "no_time", False, self.used, max(0, self.limit - self.used), None
        day = int(at // DAY)
        if day != self.day:
            self.day, self.used, self.features = day, 0, {}
        problem = None
        if units is None or units != units or not 0 < units <= self.limit:
            problem = "units"
        elif not isinstance(feature, str) or not 0 < len(feature) <= FEATURE:
            problem = "feature"
        on = problem is None and self.used + units <= self.limit
        if on:
            self.used += int(units)
            self.features[feature] = self.features.get(feature, 0) + int(units)
        left = (day + 1) * DAY - at
        return problem, on, self.used, max(0, self.limit - self.used), None if on or problem else max(1, int(-(-left // 1)))


def _hits(rows: pd.DataFrame, log: Log) -> pd.DataFrame:
    out = [log.hit(at) for at in rows["at"]]
    return rows.assign(accepted=[a for a, _ in out], retry_after=pd.array([r for _, r in out], dtype="Int64"))[["key", "id", "at", "accepted", "retry_after"]]


def _requests(rows: pd.DataFrame, usage: Usage) -> pd.DataFrame:
    out = [usage.request(at, f, u) for at, f, u in zip(rows["at"], rows["feature"], rows["units"], strict=True)]
    named = dict(zip(("problem", "accepted", "used", "remaining", "retry_after"), zip(*out), strict=True))
    return rows.assign(**named | {"retry_after": pd.array(named["retry_after"], dtype="Int64"), "units": pd.array([None if u != u else u for u in rows["units"]], dtype="Int64")})[["key", "id", "at", "feature", "units", "problem", "accepted", "used", "remaining", "retry_after"]]


def _folded(rows: DataFrame, fresh, step, schema: str) -> DataFrame:
    """The fold over the rows of each key in the order of (at, id); a task keeps the state of the key at hand."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            if not len(b):
                continue
            # runs of one key within the batch
            cuts = (b["key"] != b["key"].shift()).cumsum()
            for _, run in b.groupby(cuts, sort=False):
                now = run["key"].iloc[0]
                if state is None or now != key:
                    key, state = now, fresh()
                yield step(run, state)

    known = rows.filter("key IS NOT NULL").repartition("key").sortWithinPartitions("key", F.asc_nulls_first("at"), "id")
    return known.mapInPandas(fold, schema)


def limited(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """HIT of each of hits (key, id, at in seconds), accepted or not."""
    rows = hits.select(F.col("key").cast("bigint").alias("key"), F.col("id").cast("bigint").alias("id"), F.col("at").cast("double").alias("at"))
    lost = rows.filter("key IS NULL").select("key", "id", "at", F.lit(False).alias("accepted"), F.lit(None).cast("bigint").alias("retry_after"))
    return _folded(rows, lambda: Log(limit, window), _hits, HIT).unionByName(lost)


def metered(requests: DataFrame, limit: int) -> DataFrame:
    """USAGE of each of requests (key, id, at in seconds, feature, units)."""
    rows = _usage_rows(requests)
    lost = rows.filter("key IS NULL").select("*", F.lit("no_key").alias("problem"), F.lit(False).alias("accepted"), F.lit(0).cast("bigint").alias("used"), F.lit(limit).cast("bigint").alias("remaining"), F.lit(None).cast("bigint").alias("retry_after"))
    return _folded(rows, lambda: Usage(limit), _requests, USAGE).unionByName(lost)


def usage_by_feature(usage: DataFrame) -> DataFrame:
    """key, day (since 1970, UTC), used and features (a map of units) of what metered accepted."""
    day = F.floor(F.col("at") / DAY).cast("bigint")
    each = usage.filter("accepted").groupBy("key", day.alias("day"), "feature").agg(F.sum("units").alias("units"))
    # features of one key and day: few names
    return each.groupBy("key", "day").agg(F.sum("units").alias("used"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "units")))).alias("features"))


def _usage_rows(requests: DataFrame) -> DataFrame:
    return requests.select(F.col("key").cast("bigint").alias("key"), F.col("id").cast("bigint").alias("id"), F.col("at").cast("double").alias("at"), "feature", F.col("units").cast("bigint").alias("units"))


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a batch, with `at` in seconds, in order."""
    frame = pd.concat(list(rows), ignore_index=True)
    return frame.sort_values(["at", "id"], na_position="first", kind="stable")


class _Logs(StatefulProcessor):
    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = Log(self.limit, self.window, [float(t[0]) for t in self.times.get()] if self.times.exists() else [])
        yield _hits(_ordered(rows), log)
        self._keep(log.times)

    def _keep(self, times: list[float]) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if times:
            self.times.put([(t,) for t in times])
            self.handle.registerTimer(int((times[-1] + self.window) * 1000) + 1)
        else:
            self.times.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Quotas(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.today = handle.getValueState("today", "day bigint, used bigint")
        self.features = handle.getMapState("features", "feature string", "units bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        usage = Usage(self.limit)
        if self.today.exists():
            usage.day, usage.used = (int(x) for x in self.today.get())
            usage.features = {k[0]: int(v[0]) for k, v in self.features.iterator()} if self.features.exists() else {}
        yield _requests(_ordered(rows), usage)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.features.clear()
        if usage.day is None:
            self.today.clear()
            return
        self.today.update((usage.day, usage.used))
        for k, v in usage.features.items():
            self.features.updateValue((k,), (v,))
        self.handle.registerTimer(int((usage.day + 1) * DAY * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.today.clear()
        self.features.clear()
        return iter(())

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, watermark: str) -> DataFrame:
    return rows.filter("key IS NOT NULL").withColumn("event_time", F.timestamp_micros(F.round(F.coalesce("at", F.lit(0.0)) * 1_000_000).cast("bigint"))).withWatermark("event_time", watermark)


def limited_stream(hits: DataFrame, limit: int, window: float, watermark: str = "1 hour") -> DataFrame:
    """As limited, for a stream; hits later than the watermark are dropped. Output mode append."""
    rows = hits.select(F.col("key").cast("bigint").alias("key"), F.col("id").cast("bigint").alias("id"), F.col("at").cast("double").alias("at"))
    return _timed(rows, watermark).groupBy("key").transformWithStateInPandas(_Logs(limit, window), HIT, "Append", "EventTime")


def metered_stream(requests: DataFrame, limit: int, watermark: str = "1 hour") -> DataFrame:
    """As metered, for a stream."""
    return _timed(_usage_rows(requests), watermark).groupBy("key").transformWithStateInPandas(_Quotas(limit), USAGE, "Append", "EventTime")
