"""Keyed folds over streams with typed state, by Spark's arbitrary stateful processing.

`ordered_fold` holds rows back until the watermark has passed them and then folds them in order of event
time, so that rows which come late, but within the delay, are judged as if they had come in time; rows behind
the watermark are dropped by Spark. `arrival_fold` folds rows as they come and forgets a key by TTL. Both take a
step of one's own: (state, row) -> (state, verdict), with the state as a dict of `state` schema's fields.

State lives in RocksDB (`with_rocksdb` sets the provider for the queries that start within), survives
restarts with the checkpoint, and can be read with Spark's `statestore` source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[dict, dict], tuple[dict, str]]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """State of queries that start within is kept in RocksDB, and batches without rows run if `idle`; the session's own settings come back after."""
    wanted = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Keyed(StatefulProcessor):
    """A step and its typed state; `fold` judges rows in the given order."""

    def __init__(self, step: Step, state: T.StructType, rows: T.StructType, order: list[str], out: str, ttl_ms: int | None = None):
        self.step, self.state_schema, self.rows_schema, self.order, self.out, self.ttl_ms = step, state, rows, order, out, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema, self.ttl_ms)

    def plain(self, rows: Iterator[Row]) -> list[tuple]:
        return [tuple(r[n] for n in self.rows_schema.names) for r in rows]

    def sorted(self, rows: list[tuple]) -> list[tuple]:
        at = [self.rows_schema.names.index(c) for c in self.order]
        return sorted(rows, key=lambda r: tuple((r[i] is None, r[i]) for i in at))

    def fold(self, rows: list[tuple]) -> Iterator[Row]:
        if not rows:
            return
        names, fields = self.rows_schema.names, self.state_schema.names
        known = self.state.get() if self.state.exists() else None
        now = {} if known is None else dict(zip(fields, known, strict=True))
        judged = Row(*names, self.out)
        for r in self.sorted(rows):
            now, verdict = self.step(now, dict(zip(names, r, strict=True)))
            yield judged(*r, verdict)
        self.state.update(tuple(now.get(f) for f in fields))

    def close(self) -> None:
        pass


class Arrival(Keyed):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self.fold(self.plain(rows))


class Ordered(Keyed):
    """Rows wait in a list until the watermark has passed them; a timer stands at the earliest, or at the key's expiry."""

    def __init__(self, *args, expire_ms: int):
        super().__init__(*args)
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", self.rows_schema)
        self.last = handle.getValueState("last", "ms long")

    def moved(self, more: list[tuple], watermark: int) -> Iterator[Row]:
        at = self.rows_schema.names.index(self.order[0])
        held = [*(tuple(r) for r in self.waiting.get()), *more]
        passed = lambda r: r[at] is None or r[at] <= watermark * 1000
        ready, rest = [r for r in held if passed(r)], [r for r in held if not passed(r)]
        run, last = [], self.last.get()[0] if self.last.exists() else None
        for r in self.sorted(ready):
            now = None if r[at] is None else r[at] // 1000
            if last is not None and now is not None and now - last >= self.expire_ms:  # idle for so long: as if new
                yield from self.fold(run)
                self.state.clear()
                run = []
            run.append(r)
            last = last if now is None else now
        yield from self.fold(run)
        if last is not None:
            self.last.update((last,))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = min(-(-r[at] // 1000) for r in rest) if rest else (watermark if last is None else last) + self.expire_ms
        self.handle.registerTimer(max(due, watermark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self.moved(self.plain(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        idle = not self.waiting.exists() and self.last.exists() and self.last.get()[0] + self.expire_ms <= watermark
        if idle:
            for s in (self.state, self.last, self.waiting):
                s.clear()
            return
        yield from self.moved([], watermark)


def _prepared(df: DataFrame, out: str, order: list[str]) -> tuple[DataFrame, T.StructType, T.StructType, list[str], list[Column]]:
    """Input, row and result schemas, order, and the columns that give a result its types back.

    Steps see timestamps as microseconds since 1970, which no time zone touches.
    """
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    stamps = {f.name: f"__us_{f.name}" for f in kept if isinstance(f.dataType, T.TimestampType)}
    rows = T.StructType([T.StructField(stamps.get(f.name, f.name), T.LongType() if f.name in stamps else f.dataType) for f in kept])
    wide = df.select(*(f.name for f in kept), *(F.unix_micros(c).alias(n) for c, n in stamps.items()))
    back = [F.timestamp_micros(stamps[f.name]).alias(f.name) if f.name in stamps else F.col(f.name) for f in kept]
    return wide, rows, T.StructType([*rows.fields, T.StructField(out, T.StringType())]), [stamps.get(c, c) for c in order], [*back, F.col(out)]


def ordered_fold(df: DataFrame, key: str, order: list[str], step: Step, state: str, out: str = "verdict", delay: str = "10 minutes", expire_hours: float = 24 * 60) -> DataFrame:
    """A stream's rows with the step's verdict, per key in order of event time (the timestamp `order[0]`); rows show when the watermark has passed them.

    A key without rows for `expire_hours` of event time is forgotten and starts anew.
    """
    wide, rows, result, order_us, back = _prepared(df, out, order)
    worker = Ordered(step, T._parse_datatype_string(state), rows, order_us, out, expire_ms=int(expire_hours * 3_600_000))
    return wide.withWatermark(order[0], delay).groupBy(key).transformWithState(worker, result, "Append", "EventTime").select(*back)


def arrival_fold(df: DataFrame, key: str, order: list[str], step: Step, state: str, out: str = "verdict", ttl_hours: float | None = 24 * 60) -> DataFrame:
    """A stream's rows with the step's verdict, micro-batch by micro-batch in order; a key without rows for `ttl_hours` of processing time is forgotten."""
    wide, rows, result, order_us, back = _prepared(df, out, order)
    worker = Arrival(step, T._parse_datatype_string(state), rows, order_us, out, None if ttl_hours is None else int(ttl_hours * 3_600_000))
    return wide.groupBy(key).transformWithState(worker, result, "Append", "ProcessingTime").select(*back)
