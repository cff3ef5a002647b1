"""Structured Streaming jobs: incremental indexing, windows, stateful rates and traces."""

from __future__ import annotations

import itertools
import math
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import ListState

from ..operators.chunking import chunks
from ..operators.evaluate import quantile_sketches
from ..operators.events import LEAST_RATE, LEAST_SECONDS, classify_fault
from ..operators.ingest import append_chunks
from ..session import sized

LATE = "10 minutes"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive; times get the session's zone, which watermarks need."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def index_new_documents(stream: DataFrame, table_path: str, checkpoint: str):
    """Appends the chunks of new documents ``(source_path, mtime_ns, text)``, each id once, replays included; a batch reads the folders of its sources only."""
    def append(batch: DataFrame, _: int) -> None:
        append_chunks(chunks(batch), table_path, batch)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """Rows of which no other with the key came within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stage_counts(stream: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Events of each type in tumbling windows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding_speed(stream: DataFrame, width: str = "30 seconds", step: str = "10 seconds", late: str = LATE) -> DataFrame:
    """Value per sliding window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "total")


def _latest_of(held: list[tuple], frame: pd.DataFrame, n: int) -> list[tuple]:
    """The last ``n`` of held and new events by time and id, oldest first; an event without a time is older than all."""
    new = [(int(i), None if pd.isna(t) else t.to_pydatetime(), k) for i, t, k in zip(frame.event_id, frame.ts, frame.event_type, strict=True)]
    return sorted(held + new, key=lambda e: (e[1] is not None, e[1], e[0]))[-n:] if n else []


def last_events(stream: DataFrame, n: int = 1000) -> DataFrame:
    """After each batch, the last ``n`` event ids of each user that it touched, oldest first.

    Of a key's rows no more than ``n`` and one Arrow batch are held at a time.
    """
    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [(i, None if t is None else pd.Timestamp(t, unit="us").to_pydatetime(), "") for i, t in zip(*state.get, strict=True)] if state.exists else []
        for frame in frames:
            held = _latest_of(held, frame.assign(event_type=""), n)
        ids = [e[0] for e in held]
        state.update((ids, [None if e[1] is None else pd.Timestamp(e[1]).value // 1000 for e in held]))
        yield pd.DataFrame({"user_id": [key[0]], "events": [ids]})

    return stream.groupBy("user_id").applyInPandasWithState(keep, "user_id long, events array<long>", "events array<long>, at array<long>", "update", "NoTimeout")


_TOLD = pa.schema([("user_id", pa.int64()), ("event_id", pa.int64()), ("at", pa.int64()), ("event_type", pa.string())])
_GIVEN = pa.schema([("user_id", pa.int64()), ("blocks", pa.int64()), ("due", pa.int64())])
_MANY = 50_000


def _pack(state: ListState, rows: pa.Table) -> None:
    """Replaces the list by the rows, as Arrow streams of ``_MANY`` rows at most."""
    packed = []
    for k in range(0, rows.num_rows, _MANY):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows.slice(k, _MANY))
        packed.append((sink.getvalue().to_pybytes(),))
    if packed:
        state.put(packed)
    else:
        state.clear()


def _unpack(state: ListState, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(pa.py_buffer(x)).read_all() for (x,) in state.get())]).combine_chunks()


def _by_user(*tables: pa.Table) -> pa.Table:
    """Rows by user, time and id; what is null is first."""
    rows = pa.concat_tables(tables).combine_chunks()
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("user_id", "at", "event_id")], null_placement="at_start"))


def _users(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """The users of rows sorted by user, where the rows of each start and how many they are."""
    ids, lacking = rows["user_id"].fill_null(0).to_numpy(), rows["user_id"].is_null().to_numpy()
    starts = np.flatnonzero(np.r_[np.ones(min(len(ids), 1), bool), (ids[1:] != ids[:-1]) | (lacking[1:] != lacking[:-1])])
    return rows["user_id"].take(pa.array(starts)).to_pylist(), starts, np.diff(np.r_[starts, len(ids)])


class FlightRecorder(StatefulProcessor):
    """Keeps each user's last ``n`` events in list state and gives out all events once, in blocks of ``block``.

    The key is a group of users, whose rows are sorted, cut and stored together:
    a call on the state costs about as much as a thousand rows. Events of an
    unfinished block wait in state of their own until they are ``block``, or until
    the watermark is ``idle`` beyond the user's last event. The group's timer is
    set to the first of its users' times.
    """

    def __init__(self, n: int, block: int, idle: pd.Timedelta) -> None:
        self.n, self.block, self.idle = n, block, idle // pd.Timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent, self.pending, self.given = (handle.getListState(name, "rows binary") for name in ("recent", "pending", "given"))

    def _blocks(self, rows: pa.Table, given: dict[int | None, list], short: bool = False) -> tuple[pa.Table, Iterator[pd.DataFrame]]:
        """The sorted rows that wait on, and the others as blocks, numbered from the user's count in ``given``; all are given out if the last may be ``short``."""
        users, starts, sizes = _users(rows)
        whole = sizes if short else sizes - sizes % self.block
        first = np.array([given.setdefault(u, [0, None])[0] for u in users], np.int64)
        for u, blocks in zip(users, (-(-whole // self.block)).tolist(), strict=True):
            given[u][0] += blocks
        place = np.arange(rows.num_rows) - np.repeat(starts, sizes)
        done = place < np.repeat(whole, sizes)
        out = rows.append_column("block", pa.array(np.repeat(first, sizes) + place // self.block, pa.int64())).filter(pa.array(done))
        frames = [out.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)] if out.num_rows else []
        return rows.filter(pa.array(~done)), iter(frames)

    def _state(self) -> tuple[pa.Table, dict[int | None, list], int | None]:
        """What waits, blocks given and time due of each user, and the timer that is set."""
        given = {u: [blocks, due] for u, blocks, due in zip(*(c.to_pylist() for c in _unpack(self.given, _GIVEN).itercolumns()), strict=True)}
        return _unpack(self.pending, _TOLD), given, self._first(given)

    def _first(self, given: dict[int | None, list]) -> int | None:
        return min((due for _, due in given.values() if due is not None), default=None)

    def _keep(self, waiting: pa.Table, given: dict[int | None, list]) -> None:
        _pack(self.pending, waiting)
        _pack(self.given, pa.table([list(given), [b for b, _ in given.values()], [d for _, d in given.values()]], schema=_GIVEN))
        if (timer := self._first(given)) is not None:
            self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (waiting, given, timer), recent = self._state(), _unpack(self.recent, _TOLD)
        if timer is not None:
            self.handle.deleteTimer(timer)
        touched, new = set(), []
        for frame in itertools.chain(rows, [None]):  # frames are joined until they are as many as the rows kept, so that sorting stays linear
            if frame is not None:
                value = lambda name, bit, f=frame: pa.array(f[name].to_numpy(np.int64), mask=(f["lacks"].to_numpy() & bit) > 0)
                new.append(pa.table([value("user_id", 1), value("event_id", 2), value("at", 4), pa.array(frame["event_type"], pa.string(), from_pandas=True)], schema=_TOLD))
            if new and (frame is None or sum(t.num_rows for t in new) >= max(_MANY, recent.num_rows)):
                for t in new:
                    touched.update(t["user_id"].unique().to_pylist())
                recent = _by_user(recent, *new)
                _, starts, sizes = _users(recent)
                recent = recent.filter(pa.array(np.arange(recent.num_rows) >= np.repeat(starts + sizes - self.n, sizes)))
                waiting, done = self._blocks(_by_user(waiting, *new), given)
                yield from done
                new = []
        for u in touched:
            given[u][1] = None
        users, starts, sizes = _users(waiting)
        for u, last in zip(users, waiting["at"].take(pa.array(starts + sizes - 1)).to_pylist(), strict=True):
            if u in touched:
                given[u][1] = max((last or 0) // 1000 + self.idle, timerValues.getCurrentWatermarkInMs() + 1)
        _pack(self.recent, recent)
        self._keep(waiting, given)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, given, timer = self._state()
        ended = {u for u, (_, due) in given.items() if due is not None and due <= max(timer, timerValues.getCurrentWatermarkInMs())}
        users, _, sizes = _users(waiting)
        over = np.repeat(np.array([u in ended for u in users], bool), sizes)
        _, done = self._blocks(waiting.filter(pa.array(over)), given, short=True)
        yield from done
        for u in ended:
            given[u][1] = None
        self._keep(waiting.filter(pa.array(~over)), given)

    def close(self) -> None:
        pass


def flight_log(stream: DataFrame, n: int = 1000, block: int = 100, idle: str = "1 hour", late: str = LATE, groups: int = 1024) -> DataFrame:
    """Append-only log ``(user_id, block, event_id, ts, event_type)``: every event once, each hundred of a user's events as one block.

    The last ``n`` events of each user stay in the list state ``recent``
    (``kept_state``). A block that isn't full is given out once the watermark is
    ``idle`` beyond the user's last event. Written by a file sink with a checkpoint,
    the log holds every event once, restarts included. Users are dealt to ``groups``
    by hash. What a group keeps is held in one task's memory and written anew by each
    batch that touches it, so many millions of users, or small batches that come often,
    want more groups. Their number must stay the same for a checkpoint. Needs a RocksDB
    state store (``state_store``).
    """
    lacks = sum((F.when(F.col(c).isNull(), bit).otherwise(0) for c, bit in (("user_id", 1), ("event_id", 2), ("ts", 4))), F.lit(0))
    whole = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    told = stream.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("dealt"), "ts", whole(F.col("user_id"), "user_id"), whole(F.col("event_id"), "event_id"), whole(F.unix_micros("ts"), "at"), lacks.alias("lacks"), "event_type")
    log = told.groupBy("dealt").transformWithStateInPandas(
        FlightRecorder(n, block, pd.Timedelta(idle)), "user_id long, block long, event_id long, at long, event_type string", "Append", "EventTime")
    return log.select("user_id", "block", "event_id", F.timestamp_micros("at").alias("ts"), "event_type")


@contextmanager
def state_store(spark: SparkSession, provider: str = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider") -> Iterator[None]:
    """Streams that start inside use this state store; the session's setting is put back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept_state(spark: SparkSession, checkpoint: str, name: str, operator: int = 0) -> DataFrame:
    """Rows ``(user_id, event_id, ts, event_type)`` of a list, ``recent`` or ``pending``, that a stream of ``flight_log`` keeps in its state."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield from pa.ipc.open_stream(x.as_buffer())

    packed = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", name).load()
    told = packed.select("list_element.rows").mapInArrow(rows, "user_id long, event_id long, at long, event_type string")
    return told.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "event_type")


def ema_rate(stream: DataFrame, total: float = 0.0, alpha: float = 0.25, idle: str = "1 hour", late: str = LATE) -> DataFrame:
    """Per user ``(ema, done, rate, eta, ended)`` after each batch that touches it, and once more when it has been idle.

    ``ema`` is the moving average of values, ``rate`` that of their rates and
    ``eta`` the time left of ``total`` (``operators.events.smoothed_eta``), in time
    order within a batch and across batches. Once the watermark is ``idle`` beyond
    a user's last event, a row with ``ended`` is given out and the state is gone. A
    user's rows of one micro-batch are sorted together, so batches must be bounded.
    """
    wait = int(pd.Timedelta(idle) / pd.Timedelta(milliseconds=1))

    def row(key, ema, done, rate, ended) -> pd.DataFrame:
        eta = max(total - done, 0.0) / rate if total > 0 and rate is not None and rate > LEAST_RATE else None
        lacking = lambda x: math.nan if x is None else x
        return pd.DataFrame({"user_id": np.array([key[0]]), "ema": np.array([ema], float), "done": np.array([done], float), "rate": np.array([lacking(rate)]), "eta": np.array([lacking(eta)]), "ended": np.array([ended])})

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ema, done, rate, _ = state.get
            state.remove()
            yield row(key, ema, done, rate, True)
            return
        ats, ids, values = (np.concatenate(x) for x in zip(*((f.ts.to_numpy("datetime64[ns]"), f.event_id.to_numpy(), f.value.to_numpy(float)) for f in frames), strict=True))
        order = np.lexsort((ids, ats))  # rows without a time are last
        seconds, values = ats[order].astype(np.int64) // 10**9, np.nan_to_num(values[order], nan=0.0, posinf=np.inf, neginf=-np.inf)
        ema, done, rate, last = state.get if state.exists else (None, 0.0, None, None)
        for second, v in zip(seconds.tolist(), values.tolist(), strict=True):
            ema = v if ema is None else alpha * v + (1 - alpha) * ema
            done += max(v, 0.0)
            if last is not None:
                now = max(v, 0.0) / max(second - last, LEAST_SECONDS)
                rate = now if rate is None else alpha * now + (1 - alpha) * rate
            last = int(second)
        state.update((ema, done, rate, last))
        state.setTimeoutTimestamp(max(last * 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield row(key, ema, done, rate, False)

    told = stream.withWatermark("ts", late).select("user_id", "ts", "event_id", "value")
    return told.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, ema double, done double, rate double, eta double, ended boolean", "ema double, done double, rate double, last long", "update", "EventTimeTimeout")


def faults(stream: DataFrame, playbook: DataFrame) -> DataFrame:
    """Error events classified and joined with a static playbook ``(error_class, advice)``."""
    found = stream.where("event_type = 'error'").withColumn("f", classify_fault(F.col("event_type"), F.col("props"))).select("event_id", "ts", "f.*")
    return found.join(sized(playbook, "playbook"), "error_class", "left")


def traced(events: DataFrame, found: DataFrame, seconds: int = 60, late: str = LATE, splits: int = 4) -> DataFrame:
    """Events within ``seconds`` of a fault, both streams watermarked.

    A bucket's events are dealt to ``splits`` keys, all of which each fault gets, so a burst of events is several tasks' work.
    """
    bucket = F.floor(F.unix_seconds("ts") / seconds)
    e = events.withWatermark("ts", late).select("event_id", F.col("ts").alias("event_ts"), bucket.alias("bucket"), F.pmod(F.xxhash64("event_id"), F.lit(splits)).cast("int").alias("split"))
    f = found.withWatermark("ts", late).select(F.col("event_id").alias("fault_id"), F.col("ts").alias("fault_ts"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    f = f.withColumn("split", F.explode(F.array(*(F.lit(k) for k in range(splits)))))
    near = F.expr(f"event_ts BETWEEN fault_ts - INTERVAL {seconds} SECONDS AND fault_ts + INTERVAL {seconds} SECONDS")
    return e.join(f.hint("merge"), ["bucket", "split"]).where(near).select("fault_id", "event_id")


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The DataFrame with live counters that are read after its action."""
    watch = Observation(name)
    return df.observe(watch, *(c.alias(k) for k, c in metrics.items())), watch


class Progress(StreamingQueryListener):
    """Counts the rows that streams have read, by the progress they report."""

    def __init__(self) -> None:
        self.rows, self.ended = 0, set()
        self._told = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._told:
            self.ended.add(str(event.runId))
            self._told.notify_all()

    def wait(self, run_id: str, seconds: float = 60) -> bool:
        """Waits until the end of a run was reported, which follows all its progress."""
        with self._told:
            return self._told.wait_for(lambda: run_id in self.ended, seconds)


def late_rows(query) -> int:
    """Rows that a query's watermarks have dropped so far."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def keep_sketches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], value: str):
    """Writes each batch's quantile sketches to a folder of its own, so a batch that is run again replaces them; returns the finished query."""
    def keep(batch: DataFrame, n: int) -> None:
        quantile_sketches(batch, keys, value).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return drain(stream, "", checkpoint, sink=keep)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None):
    """Runs a stream over all that is there; returns the finished query. Rows are in the memory table ``name`` or went to ``sink``."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
    query.awaitTermination()
    return query
