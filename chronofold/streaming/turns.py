"""Live turns: a state machine over a stream of turn events, and the outbox that keeps an index current.

Events of one turn: begin, action, observation, complete, abort. A result needs its call, a call id is used
once, a turn with open calls can't complete, events after the end are rejected, and a turn left open is
aborted by a timer. Repeats of what already happened change nothing and say so.

The calls of a turn are forgotten when it ends, and its end after a grace time, so the state holds the open turns
and those that ended lately; a later event of a forgotten turn is one of a turn that was never begun.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.speech import SpeechStream

OUTPUT = "turn_key string, event string, correlation_id string, outcome string, status string, pending long"
FINAL = {"success", "failed", "error", "cancelled", "done", ""}


class TurnState:
    """One turn: status (None, open, closed, aborted) and the state of its calls."""

    def __init__(self, status: str | None = None, calls: dict[str, str] | None = None):
        self.status, self.calls = status, dict(calls or {})
        self.unanswered = sum(s != "done" for s in self.calls.values())

    @property
    def pending(self) -> int:
        return self.unanswered if self.status == "open" else 0

    def apply(self, event: str, call: str = "", status: str = "") -> str:
        """The outcome of an event; only accepted ones change the state."""
        if event == "begin":
            if self.status is None:
                self.status = "open"
                return "accepted"
            return "repeated" if self.status == "open" else "conflict"
        if event == "complete" and self.status == "closed":
            return "already_completed"
        if event == "abort" and self.status == "aborted":
            return "repeated"
        if self.status != "open":
            return "conflict" if event in ("complete", "abort") and self.status else "turn_not_open"
        if event == "action":
            if not call:
                return "correlation_required"
            if call in self.calls:
                return "duplicate_call"
            self.calls[call] = "open"
            self.unanswered += 1
            return "accepted"
        if event == "observation":
            if call not in self.calls:
                return "call_not_found"
            if status in FINAL and self.calls[call] != "done":
                self.calls[call] = "done"
                self.unanswered -= 1
            return "accepted"
        if event == "complete":
            if self.pending > 0:
                return "calls_pending"
            self.status = "closed"
            return "accepted"
        if event == "abort":
            self.status = "aborted"
            return "accepted"
        return "unknown_event"


class TurnProcessor(StatefulProcessor):
    """Keyed by turn. Within a batch a turn's events are put in order of (timestamp, seq) first."""

    def __init__(self, max_age_ms: int = 3_600_000, grace_ms: int = 3_600_000):
        self.max_age_ms, self.grace_ms = max_age_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, forget_at long")
        self.calls = handle.getMapState("calls", "call string", "state string")

    def _load(self) -> TurnState:
        return TurnState(self.status.get()[0] if self.status.exists() else None, {k[0]: v[0] for k, v in self.calls.iterator()})

    def _save(self, turn: TurnState, was: TurnState, now: int) -> None:
        if turn.status is not None and turn.status != was.status:
            ended = turn.status != "open"
            self.status.update((turn.status, now + self.grace_ms if ended else 0))
            self.handle.registerTimer(now + (self.grace_ms if ended else self.max_age_ms))
        if turn.status != "open":
            if was.calls:
                self.calls.clear()
            return
        for call, state in turn.calls.items():
            if was.calls.get(call) != state:
                self.calls.updateValue((call,), (state,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["timestamp", "seq"], kind="stable")
        was, out = self._load(), []
        turn = TurnState(was.status, was.calls)
        for e in events.itertuples():
            outcome = turn.apply(e.event, e.correlation_id or "", e.status or "")
            out.append((key[0], e.event, e.correlation_id, outcome, turn.status or "", turn.pending))
        self._save(turn, was, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["turn_key", "event", "correlation_id", "outcome", "status", "pending"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was, now = self._load(), timerValues.getCurrentProcessingTimeInMs()
        if was.status == "open":
            turn = TurnState(was.status, was.calls)
            turn.apply("abort")
            self._save(turn, was, now)
            yield pd.DataFrame([(key[0], "abort", None, "stale_turn", turn.status, turn.pending)], columns=["turn_key", "event", "correlation_id", "outcome", "status", "pending"])
        elif was.status is not None and now >= self.status.get()[1]:
            self.status.clear()

    def close(self) -> None:
        pass


def turns(events: DataFrame, max_age_ms: int = 3_600_000, grace_ms: int = 3_600_000) -> DataFrame:
    """Outcome of every event of a stream (turn_key, event, correlation_id, status, timestamp, seq).

    Needs the RocksDB state store provider.
    """
    return events.groupBy("turn_key").transformWithStateInPandas(TurnProcessor(max_age_ms, grace_ms), OUTPUT, "Append", "processingTime")


def replay(events: DataFrame) -> DataFrame:
    """The same outcomes of a finished table: turns lie one after the other, and one turn's state is held at a time."""
    keys = [F.col(c).cast("string").alias(c) for c in ("turn_key", "event", "correlation_id", "status")]
    order = [F.asc_nulls_last(c) for c in ("turn_key", "timestamp", "seq")]
    rows = events.select(*keys, "timestamp", "seq").repartition("turn_key").sortWithinPartitions(*order).drop("timestamp", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, last = TurnState(), None
        for batch in batches:
            made = []
            for key, event, call, status in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if key != last:
                    turn, last = TurnState(), key
                outcome = turn.apply(event, call or "", status or "")
                made.append((outcome, turn.status or "", turn.pending))
            outcomes, states, pending = zip(*made, strict=True) if made else ((), (), ())
            new = [pa.array(outcomes, pa.string()), pa.array(states, pa.string()), pa.array(pending, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], ["turn_key", "event", "correlation_id", "outcome", "status", "pending"])

    return rows.mapInArrow(run, OUTPUT)


def spoken(chunks: DataFrame) -> DataFrame:
    """Events (stream, place, type, text) of streamed replies (stream, seq, chunk), each stream in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        stream, events = SpeechStream(), []
        for chunk in frame.sort_values("seq", kind="stable").chunk:
            events += stream.feed(chunk)
        events += stream.finish()
        text = lambda e: e.get("text") if e["type"] != "final" else e["payload"]["speech"]
        return pd.DataFrame([(frame.stream.iloc[0], i, e["type"], text(e)) for i, e in enumerate(events)], columns=["stream", "place", "type", "text"])

    return chunks.groupBy("stream").applyInPandas(run, "stream string, place long, type string, text string")


def stale(turns: DataFrame, now: int, max_age: int) -> DataFrame:
    """Open turns older than ``max_age`` seconds, for batch recovery."""
    return turns.where((F.col("status") == "open") & (F.col("opened_at") < now - max_age))


def activity(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Windowed counts with a watermark: tumbling, sliding (``slide``) or session (``gap``) windows."""
    window = F.session_window("ts", gap) if gap else F.window("ts", length, slide or length)
    keys = [F.col("user_id")] if gap else [F.col("event_type")]
    return events.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "n", "total")


def outbox(stream: DataFrame, index: Callable[[DataFrame], None], checkpoint: str):
    """Index each micro-batch once: a batch that fails is run again, and ``index`` must be idempotent by key."""
    return stream.writeStream.foreachBatch(lambda batch, _id: index(batch)).option("checkpointLocation", checkpoint)
