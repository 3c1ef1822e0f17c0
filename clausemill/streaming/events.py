"""The event log as a stream: acceptance, session state, sequence numbers, roll-ups.

Control rows (``session_start``, ``session_end``) and client rows of one study go through one keyed state, so
numbers are dealt in order of arrival; rows ahead of their turn wait in that state; the state store and the checkpoint
bring it back after a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clausemill.session import checkpoint_dir

#: The types that a client may send.
CLIENT_EVENTS = (
    "client_hello", "screen_view", "heartbeat", "click", "profile_selection", "analysis_result", "change_card_expand",
    "change_card_collapse", "original_clause_open", "category_toggle", "preview_toggle", "ask_ai_open", "ask_ai_message",
)
PAYLOAD_BYTES = 64 * 1024


def rejection(event_type: Column, data: Column) -> Column:
    """Why a client row is not taken: ``too_large`` (413) or ``unknown_type`` (422); null if it is."""
    return F.when(F.octet_length(F.coalesce(data, F.lit(""))) > PAYLOAD_BYTES, "too_large").when(~F.coalesce(event_type.isin(*CLIENT_EVENTS), F.lit(False)), "unknown_type")


def accepted(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Client rows that are taken, and the others with their reason."""
    told = events.withColumn("reason", rejection(F.col("event_type"), F.col("data")))
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


STAMPED = "study string, arrival long, server_ms long, event_type string, data string, participant_id string, session_id string, seq long, t_ms long, logged boolean, reason string"
STATE = "participant_id string, session_id string, next_seq long, start_ms long"
_INPUT = ["arrival", "server_ms", "event_type", "data", "participant_id", "session_id"]
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def transition(state: tuple | None, row) -> tuple[tuple | None, dict]:
    """One row against the state: (state after it, what is written).

    A start while a session is active is refused (409), an end without one too (404); a client row without a
    session is dropped. Rows of a session are numbered from 0, and timed from its start.
    """
    out = {"participant_id": None, "session_id": None, "seq": None, "t_ms": None, "logged": False, "reason": None}
    if row.event_type == "session_start":
        if state:
            return state, out | {"reason": "already_active"}
        state = (row.participant_id, row.session_id, 0, int(row.server_ms))
    elif not state:
        return state, out | {"reason": "no_active_session"}
    participant, session, seq, start = state
    out |= {"participant_id": participant, "session_id": session, "seq": seq, "t_ms": int(row.server_ms) - start, "logged": True}
    return (None if row.event_type == "session_end" else (participant, session, seq + 1, start)), out


def numbered_rows(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
    """``transition`` over rows which are in order, for all of them at once.

    Behind a start a session is active, whether it was taken or refused, and behind an end none is; so each row knows by
    the last start or end before it whether one is active, and starts that find none begin the sessions.
    """
    n = len(rows)
    kind, place = rows["event_type"].to_numpy(dtype=object), np.arange(n)
    starts, ends = kind == "session_start", kind == "session_end"
    last = np.maximum.accumulate(np.where(starts | ends, place, -1)) if n else place
    before = np.concatenate([[-1], last[:-1]]) if n else place
    active = np.where(before >= 0, starts[before], state is not None) if n else starts
    begun = starts & ~active
    logged = active & ~starts | begun
    times = rows["server_ms"].to_numpy()
    # the row that began the session of each: -1 is the one of the state
    own = np.maximum.accumulate(np.where(begun, place, -1)) if n else place
    old = own < 0
    count = np.cumsum(logged)
    first_of = np.where(old, 0, own)
    seq = np.where(old, count - 1 + (state[2] if state else 0), count - count[first_of])
    t_ms = times - np.where(old, state[3] if state else 0, times[first_of])
    out = {}
    for i, c in enumerate(("participant_id", "session_id")):
        values = np.where(old, state[i] if state else None, rows[c].to_numpy(dtype=object)[first_of]).astype(object)
        out[c] = np.where(logged, values, None)
    out |= {c: pd.arrays.IntegerArray(x.astype(np.int64), ~logged) for c, x in (("seq", seq), ("t_ms", t_ms))}
    out["reason"] = np.where(logged, None, np.where(starts, "already_active", "no_active_session")).astype(object)
    out["logged"] = logged
    told = rows[["arrival", "server_ms", "event_type", "data"]].reset_index(drop=True).assign(**out)
    if n and last[-1] >= 0 and ends[last[-1]]:
        state = None
    elif n and (state or logged.any()):
        at = int(own[-1])
        held = int(logged.sum()) if at < 0 else int(count[-1] - count[at] + 1)
        if at < 0:
            state = (state[0], state[1], state[2] + held, state[3])
        else:
            state = (rows["participant_id"].iloc[at], rows["session_id"].iloc[at], held, int(times[at]))
    return state, told


class Sessions(StatefulProcessor):
    """The session of each study, and the rows that came ahead of their turn.

    Rows are taken in order of ``arrival`` within a micro-batch, however many Arrow batches it comes in. ``dense`` says
    that a study's arrivals are consecutive: then a row waits, also over micro-batches and restarts, until those before
    it have come, and one whose number is past is told as ``repeated``. With ``wait_ms`` a row waits until one of its
    study that much later by ``server_ms`` has come. What waits longer than ``patience_ms`` of processing time is taken
    as it is, in order. Waiting rows are kept as one block for each micro-batch, not one state entry a row.
    """

    def __init__(self, dense: bool, wait_ms: int, patience_ms: int | None, ttl_ms: int | None):
        self.dense, self.wait_ms, self.patience_ms, self.ttl_ms = dense, wait_ms, patience_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE, self.ttl_ms)
        self.place = handle.getValueState("place", "turn long, latest long, timer long")
        self.ahead = handle.getListState("ahead", "rows binary")

    def _waiting(self) -> list[pd.DataFrame]:
        if not self.ahead.exists():
            return []
        return [pa.ipc.open_stream(bytes(r[0])).read_all().to_pandas() for r in self.ahead.get()]

    def _taken(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        now = self.session.get() if self.session.exists() else None
        after, told = numbered_rows(tuple(now) if now else None, rows)
        if after:
            self.session.update((after[0], after[1], int(after[2]), int(after[3])))
        elif now:
            self.session.clear()
        told.insert(0, "study", key[0])
        for at in range(0, len(told), 50_000):
            yield told.iloc[at : at + 50_000]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = [f[_INPUT] for f in rows if len(f)]
        before = self._waiting()
        pdf = pd.concat(before + own, ignore_index=True).sort_values(["arrival", "server_ms"], kind="stable", ignore_index=True)
        turn, latest, timer = self.place.get() if self.place.exists() else (None, None, None)
        if self.dense:
            past = np.zeros(len(pdf), dtype=bool)
            arrival = pdf["arrival"].to_numpy()
            past[1:] = arrival[1:] == arrival[:-1]
            past |= arrival < (arrival[0] if turn is None else turn)
            if past.any():
                gone = pdf[past]
                told = gone[["arrival", "server_ms", "event_type", "data"]].assign(study=key[0], participant_id=None, session_id=None, seq=None, t_ms=None, logged=False, reason="repeated")
                yield told[[c.split()[0] for c in STAMPED.split(", ")]].astype({"seq": "Int64", "t_ms": "Int64"})
                pdf = pdf[~past].reset_index(drop=True)
            first = 0 if turn is None else turn
            ready = np.cumprod(pdf["arrival"].to_numpy() == first + np.arange(len(pdf))).astype(bool)
        else:
            latest = max(int(pdf["server_ms"].max()), latest if latest is not None else -(2**62))
            # in order: nothing passes a row that still waits
            ready = np.cumprod(pdf["server_ms"].to_numpy() <= latest - self.wait_ms).astype(bool)
        yield from self._release(key, pdf, ready, turn, latest, timer, bool(before), timerValues)

    def _release(self, key: tuple, pdf: pd.DataFrame, ready: np.ndarray, turn, latest, timer, held: bool, times) -> Iterator[pd.DataFrame]:
        taken, left = pdf[ready], pdf[~ready]
        if len(taken):
            turn = int(taken["arrival"].iloc[-1]) + 1
            yield from self._taken(key, taken)
        if len(left):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(left, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.ahead.put([(sink.getvalue().to_pybytes(),)])
            if timer is None and self.patience_ms is not None:
                timer = times.getCurrentProcessingTimeInMs() + self.patience_ms
                self.handle.registerTimer(timer)
        else:
            if held:
                self.ahead.clear()
            if timer is not None:
                self.handle.deleteTimer(timer)
                timer = None
        self.place.update((turn, latest, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, latest, _ = self.place.get()
        before = self._waiting()
        if before:
            pdf = pd.concat(before, ignore_index=True)
            yield from self._release(key, pdf, np.ones(len(pdf), dtype=bool), turn, latest, None, True, timerValues)
        else:
            self.place.update((turn, latest, None))


def stamped(rows: DataFrame, dense: bool = False, wait_ms: int = 0, patience_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """STAMPED rows of a stream of (study, arrival, server_ms, event_type, data, participant_id, session_id), numbered in order of arrival.

    See ``Sessions`` for the order across micro-batches. Dense arrivals start from 0. The state needs the RocksDB state
    store, which is set for the session unless it already is. One study's rows of one micro-batch, and those that wait,
    meet in one task, as its numbers do; a source's limits of a trigger bound them.
    """
    conf = rows.sparkSession.conf
    if "RocksDB" not in (conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    mode = "None" if patience_ms is None and ttl_ms is None else "ProcessingTime"
    return rows.groupBy("study").transformWithStateInPandas(Sessions(dense, wait_ms, patience_ms, ttl_ms), STAMPED, "Append", mode)


def status(rows: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Per session: events, last heartbeat and last event with their ages, and the current screen."""
    t, ev = F.col("server_ms"), F.col("event_type")
    now = now_ms if now_ms is not None else F.max(t)
    beat = F.max(F.when(ev == "heartbeat", t))
    return rows.groupBy("participant_id", "session_id").agg(
        F.count("*").alias("n_events"),
        ((now - F.max(t)) / 1000).alias("last_event_age_s"),
        ((now - beat) / 1000).alias("last_heartbeat_age_s"),
        F.max_by("screen", F.when(F.col("screen").isNotNull(), F.struct(t, F.col("seq")))).alias("screen"),
        F.bool_or(ev == "session_end").alias("ended"),
    )


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Event-time sessions of a user, closed by a gap: an extension, the same in batch and streaming form."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.session_window(F.col(ts), gap)
    return marked.groupBy(F.col(user).alias("user_id"), w.alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("value")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value"
    )


def best_effort(write: Callable[[DataFrame], None], report: Callable[[int, str], None]) -> Callable[[DataFrame, int], None]:
    """A batch writer that reports a failure and lets the stream go on."""

    def each(batch: DataFrame, epoch: int) -> None:
        try:
            write(batch)
        except Exception as e:  # reported, not raised: the log must not stop the study
            report(epoch, f"{type(e).__name__}: {e}")

    return each


def idempotent(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer whose epochs overwrite themselves, so a batch that is run again is not written twice."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return each


def drained(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for what is there now, by way of Parquet in the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    rows = f"{path}/rows"
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{rows}/epoch=-1")

    def each(batch: DataFrame, epoch: int) -> None:  # an epoch that is run again overwrites itself; a complete one is all there is
        batch.write.mode("overwrite").parquet(f"{rows}/epoch={epoch if mode == 'append' else 0}")

    q = df.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).option("basePath", rows).parquet(rows).select(df.columns)
