"""Keyed state of streams by state processors: the latest reading, and a breaker that a timer half-opens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State processors need a store with column families.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A row's time as a number: what workers make of timestamps depends on their time zone.
MICROS = "_micros"


class with_rocksdb:
    """Queries started inside use the RocksDB state store, whatever the session's own is."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(PROVIDER, None)
        self.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_):
        if self.before is None:
            self.conf.unset(PROVIDER)
        else:
            self.conf.set(PROVIDER, self.before)


class Latest(StatefulProcessor):
    """One value a key: the newest (time, order, value) and how many rows there were; forgotten `keep_ms` after a key's last
    update, if that is given."""

    def __init__(self, key: str, order: str, value: str, keep_ms: int | None):
        self.names, self.keep_ms = (key, order, value), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("latest", "at long, id long, value double, seen long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        name, order, value = self.names
        held = self.best.get()
        best, seen = ((held[0], held[1], held[2]), held[3]) if held is not None else (None, 0)
        for r in rows:
            seen += 1
            now = (r[MICROS], r[order], r[value])
            if best is None or now[:2] > best[:2]:
                best = now
        self.best.update((*best, seen))
        yield Row(**{name: key[0], order: best[1], MICROS: best[0], value: best[2], "seen": seen})

    def close(self) -> None: ...


def latest_state(stream: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", value: str = "value", keep_ms: int | None = None) -> DataFrame:
    """(key, order, ts, value, seen): after every batch the newest row of each key that the batch touched.

    State is one row for each key, whatever its number of readings. Rows are passed on one by one, so a key of any size
    needs no memory. With keep_ms keys that get nothing for so long, by the clock, are forgotten; such a stream needs a trigger
    that goes on, since one that ends with its input would wait for the clock.
    """
    out = f"{key} long, {order} long, {MICROS} long, {value} double, seen long"
    timed = stream.withColumn(MICROS, F.unix_micros(F.col(ts)))
    found = timed.groupBy(key).transformWithState(Latest(key, order, value, keep_ms), out, "Update", "ProcessingTime" if keep_ms else "None")
    return found.select(key, order, F.timestamp_micros(MICROS).alias(ts), value, "seen")


class Breaker(StatefulProcessor):
    """Closed, open or half-open, over a list of the last observations. Opening sets a timer, so that a key half-opens
    even if nothing comes."""

    def __init__(self, key: str, ok: str, ms: str, order: str, size: int, max_error: float, max_p95: float, open_ms: int):
        self.key, self.names, self.size, self.max_error, self.max_p95, self.open_ms = key, (ok, ms, order), size, max_error, max_p95, open_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "kind string, since long, rate double, p95 double")
        self.recent = handle.getListState("recent", "ok boolean, ms double")

    def handleInputRows(self, key, rows, timerValues):
        ok, ms, order = self.names
        kind, since, rate, p95 = self.state.get() if self.state.exists() else ("closed", 0, 0.0, 0.0)
        recent, now = [tuple(r) for r in self.recent.get()], 0
        # a batch's rows of one key come in any order
        for r in sorted(rows, key=lambda r: (r[MICROS], r[order])):
            now = r[MICROS] // 1000
            if kind == "open" and now - since >= self.open_ms:
                kind, recent = "half-open", []
            good = bool(r[ok])
            recent = [*recent, (good, float(r[ms]))][-self.size :]
            rate = sum(not g for g, _ in recent) / len(recent)
            times = sorted(t for _, t in recent)
            p95 = times[min(len(times) - 1, int(len(times) * 0.95))]
            was = kind
            if kind == "half-open":
                kind = "open" if not good or p95 > self.max_p95 else "closed" if len(recent) >= min(5, self.size) else kind
            elif kind == "closed" and (rate > self.max_error or p95 > self.max_p95):
                kind = "open"
            if kind == "open" and was != "open":
                since = now
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kind == "open":
            self.handle.registerTimer(max(since + self.open_ms, timerValues.getCurrentWatermarkInMs() + 1))
        self.state.update((kind, since, rate, p95))
        self.recent.put(recent)
        yield self._row(key, kind, rate, p95, now)

    def _row(self, key, kind, rate, p95, at) -> Row:
        return Row(**{self.key: key[0], "state": kind, "error_rate": rate, "p95": p95, "at": at})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kind, since, rate, p95 = self.state.get()
        if kind == "open":
            self.state.update(("half-open", since, rate, p95))
            self.recent.clear()
            yield self._row(key, "half-open", rate, p95, max(since + self.open_ms, expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None: ...


def breaker(
    stream: DataFrame, key: str, ok: str, ms: str, size: int = 30, max_error: float = 0.5, max_p95: float = 300_000.0,
    open_ms: int = 30_000, ts: str = "ts", order: str = "event_id"
) -> DataFrame:
    """(key, state, error_rate, p95, at): a breaker over the last `size` observations of each key; at is when, in milliseconds.

    Closed opens on too many errors or a slow 95th percentile. Open lets observations through again (half-open) `open_ms`
    after it opened, by event time: with the next observation or, where none comes, when the watermark gets there. Half-open
    opens again on the first bad or slow one and closes after five good ones. The stream needs a watermark.
    """
    out = f"{key} long, state string, error_rate double, p95 double, at long"
    timed = stream.withColumn(MICROS, F.unix_micros(F.col(ts)))
    return timed.groupBy(key).transformWithState(Breaker(key, ok, ms, order, size, max_error, max_p95, open_ms), out, "Update", "EventTime")
