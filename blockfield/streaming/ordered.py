"""Stateful processors over numbered rows of a source: rows in order, late rows waiting in state, timers for what never ends.

A source numbers its rows 0, 1, 2, ... in ``seq``; ``ts`` is their event time.  Rows may arrive in any order, inside a trigger
or across triggers.  The rows that continue a source's sequence are processed batch by batch; others wait in state, in
chunks of bounded size, until the rows before them have come, and repeats of rows that were processed are dropped.  No step
holds more than one Arrow batch and one chunk, however many rows a source has in a trigger.
"""

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Rows of one chunk that waits in state.
CHUNK = 4096
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(rows: pd.DataFrame) -> bytes:
    sink = io.BytesIO()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class OrderedSource(StatefulProcessor):
    """Base of the processors: ``advance`` turns (state, rows in order) into (state, output), ``expire`` closes what is open.

    ``state_schema`` is the machine's state, ``start`` its first value, ``pending(state)`` tells whether something is open that
    the timer should close ``timeout_ms`` of event time after the source's last row.
    """

    state_schema: str
    start: tuple

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle):
        self.handle = handle
        self.machine = handle.getValueState("machine", self.state_schema)
        self.place = handle.getValueState("place", "next bigint, latest bigint, timer bigint, waiting bigint")
        self.early = handle.getMapState("early", "first bigint", "rows binary")

    def advance(self, state: tuple, rows: pd.DataFrame) -> tuple:
        raise NotImplementedError

    def expire(self, state: tuple) -> tuple:
        raise NotImplementedError

    def pending(self, state: tuple) -> bool:
        raise NotImplementedError

    def frames(self, key, out: dict):
        """The output as frames: one, or none if it has no rows."""
        n = len(next(iter(out.values())))
        if n:
            yield pd.DataFrame({"source": np.full(n, key[0], "i8"), **out})

    def _load(self):
        state = tuple(self.machine.get()) if self.machine.exists() else self.start
        place = tuple(self.place.get()) if self.place.exists() else (0, None, None, 0)
        self.waiting = place[3]
        return state, place[:3]

    def _keep(self, rows: pd.DataFrame) -> None:
        """Rows that are too early, sorted: one chunk per gap, or more of them where they are many."""
        seq = rows["seq"].to_numpy()
        for part in np.split(np.arange(len(seq)), np.flatnonzero(np.diff(seq) != 1) + 1):
            for at in range(0, len(part), CHUNK):
                chunk = rows.iloc[part[at : at + CHUNK]]
                first = int(seq[part[at]])
                if self.early.containsKey((first,)):  # rows that come again: the longer chunk stays
                    held = _unpacked(self.early.getValue((first,))[0])
                    chunk = held if len(held) >= len(chunk) else chunk
                else:
                    self.waiting += 1
                self.early.updateValue((first,), (_packed(chunk),))

    def _drain(self, state, following):
        """Process the waiting chunks that continue the sequence."""
        for first in sorted(k[0] for k in self.early.keys()) if self.waiting else ():
            if first > following:
                break
            rows = _unpacked(self.early.getValue((first,))[0])
            self.early.removeKey((first,))
            self.waiting -= 1
            rows = rows[rows["seq"].to_numpy() >= following]
            if len(rows):
                state, out = self.advance(state, rows)
                following += len(rows)
                yield state, following, out

    def _arm(self, state, place):
        """One timer per source, for as long as something is open or waits."""
        following, latest, timer = place
        wanted = latest + self.timeout_ms if self.pending(state) or self.waiting else None
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.machine.update(state)
        self.place.update((following, latest, wanted, self.waiting))

    def handleInputRows(self, key, rows, timerValues):
        state, (following, latest, timer) = self._load()
        for batch in rows:
            batch = batch.sort_values("seq", kind="stable")
            seen = int(batch["ts"].max().value // 1_000_000)
            latest = seen if latest is None else max(latest, seen)
            seq = batch["seq"].to_numpy()
            new = (seq >= following) & np.append(True, seq[1:] != seq[:-1])
            batch, seq = batch[new], seq[new]
            ready = int((seq == following + np.arange(len(seq))).cumprod().sum())
            if ready:
                state, out = self.advance(state, batch.iloc[:ready])
                following += ready
                yield from self.frames(key, out)
            if ready < len(seq):
                self._keep(batch.iloc[ready:])
            for state, following, out in self._drain(state, following):
                yield from self.frames(key, out)
        self._arm(state, (following, latest, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Close what is open; rows that wait behind a gap go on after it, so a lost row ends one frame only."""
        state, (following, latest, _) = self._load()
        if self.pending(state):
            state, out = self.expire(state)
            yield from self.frames(key, out)
        if self.waiting:
            following = max(following, min(k[0] for k in self.early.keys()))
            for state, following, out in self._drain(state, following):
                yield from self.frames(key, out)
            # event time goes on from now: what is open again, or still waits, gets the timeout anew
            latest = max(latest, int(timerValues.getCurrentWatermarkInMs()))
        self._arm(state, (following, latest, None))

    def close(self):
        pass


def by_source(rows: DataFrame, processor: OrderedSource, schema: str, lateness: str) -> DataFrame:
    """Run a processor per source; ``ts`` gets a watermark that trails by ``lateness`` and drives the timers."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.withWatermark("ts", lateness).groupBy("source").transformWithStateInPandas(processor, schema, "Append", "EventTime")
