"""Word streams: frame delimiting, config snapshots, sticky errors, block assembly, ownership checks, running counts.

State is per source and small: counters, the latched configuration, one flag, at most 200 buffered words, and the rows that
arrived too early.  Frames and records that never end are closed by an event-time timer and reported.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfield.operators.trace import unpack_words
from blockfield.streaming.ordered import OrderedSource, by_source

WORD, CONTROL, CLEAR = 0, 1, 2
#: Event time after a source's last row until its open frame counts as lost.
TIMEOUT_MS = 600_000
LATENESS = "1 minute"
FRAME_OUTPUT = (
    "source bigint, frame bigint, ordinal bigint, stage bigint, `group` bigint, `index` bigint, value bigint, last boolean, "
    "distance_q8 bigint, protocol_error boolean, outcome string"
)
BLOCK_WORDS = 201


def decode_stream(words: DataFrame, group_bits: int = 16, value_bits: int = 32) -> DataFrame:
    """Stateless projection of a stream with a DECIMAL ``data`` column."""
    return unpack_words(words, group_bits, value_bits)


class FrameDelimiter(OrderedSource):
    """(frame, ordinal, latched configuration, pending configuration, sticky error) of a source."""

    state_schema = "frame bigint, ordinal bigint, latched bigint, latched_words bigint, pending bigint, pending_words bigint, sticky boolean"
    start = (0, 0, 0, 0, 0, 0, False)

    def pending(self, state):
        return state[1] > 0

    def advance(self, state, rows):
        frame, ordinal, latched, latched_words, pending, pending_words, sticky = state
        is_word = rows["kind"].to_numpy() == WORD
        words, n = rows[is_word], int(is_word.sum())
        events = np.flatnonzero(~is_word)
        kinds = rows["kind"].to_numpy()[events].tolist()
        configs = list(zip(rows["distance_q8"].to_numpy()[events].tolist(), rows["expected_words"].to_numpy()[events].tolist()))
        # Position of every control row among the words, so each can act exactly between two words.
        slots = np.searchsorted(np.flatnonzero(is_word), events)
        last = words["last"].to_numpy(dtype=bool)
        frames, ordinals = np.empty(n, "i8"), np.empty(n, "i8")
        distances, errors = np.empty(n, "i8"), np.empty(n, bool)
        cuts = sorted(set([0, n, *slots.tolist(), *(np.flatnonzero(last) + 1).tolist()]))
        at = 0

        def control(k):
            nonlocal pending, pending_words, sticky
            if kinds[k] == CONTROL:
                pending, pending_words = int(configs[k][0]), int(configs[k][1])
            else:
                sticky = False

        for start, stop in zip(cuts[:-1], cuts[1:]):
            while at < len(events) and slots[at] <= start:
                control(at)
                at += 1
            if ordinal == 0:
                latched, latched_words = pending, pending_words
            count = stop - start
            frames[start:stop] = frame
            ordinals[start:stop] = np.arange(ordinal, ordinal + count)
            distances[start:stop] = latched
            ended = bool(last[stop - 1])
            position = np.arange(ordinal + 1, ordinal + count + 1)
            wrong = (position == latched_words) != last[start:stop] if latched_words else np.zeros(count, bool)
            flags = np.maximum.accumulate(np.concatenate([[sticky], wrong]))[1:]
            errors[start:stop] = flags
            sticky = bool(flags[-1])
            frame, ordinal = (frame + 1, 0) if ended else (frame, ordinal + count)
        for k in range(at, len(events)):
            control(k)
        columns = {c: words[c].to_numpy() for c in ("stage", "group", "index", "value")}
        out = {"frame": frames, "ordinal": ordinals, **columns, "last": last, "distance_q8": distances, "protocol_error": errors, "outcome": np.full(n, None, object)}
        return (frame, ordinal, latched, latched_words, pending, pending_words, sticky), out

    def expire(self, state):
        frame, ordinal, latched, *rest = state
        none = pd.array([None], "Int64")
        out = {"frame": [frame], "ordinal": [ordinal], **{c: none for c in ("stage", "group", "index", "value")}, "last": [False], "distance_q8": [latched],
               "protocol_error": [True], "outcome": ["expired"]}
        return (frame + 1, 0, latched, *rest[:-1], True), out


def delimit_frames(events: DataFrame, timeout_ms: int = TIMEOUT_MS, lateness: str = LATENESS) -> DataFrame:
    """Cut each source's words into frames at their last flag.

    Input: (source, seq, ts, kind, stage, group, index, value, last, distance_q8, expected_words).  Control rows set
    the configuration of the *next* frame: it is latched with a frame's first word.  A last flag that
    contradicts the expected word count sets a sticky error until a clear row.  A frame without a further row for
    ``timeout_ms`` of event time is closed by a row without a word: outcome ``expired``, its words as ordinal, the error set.
    """
    return by_source(events, FrameDelimiter(timeout_ms), FRAME_OUTPUT, lateness)


class BlockAssembler(OrderedSource):
    """(words of the open record, number of the block) of a source."""

    state_schema = "kept array<bigint>, block bigint"
    start = ([], 0)

    def pending(self, state):
        return len(state[0]) > 0

    def advance(self, state, rows):
        kept, block = state
        data = np.concatenate([np.asarray(kept, "i8"), rows["data"].to_numpy("i8")])
        whole = len(data) // BLOCK_WORDS
        records = data[: whole * BLOCK_WORDS].reshape(whole, BLOCK_WORDS)
        signed = records.astype("u4").astype("i4")
        planes = {p: list(signed[:, 9 + 64 * i:73 + 64 * i].astype("i8")) for i, p in enumerate("xyb")}
        out = {"block": np.arange(block, block + whole), "words": np.full(whole, BLOCK_WORDS), "scalars": list(records[:, :9]), **planes}
        return (data[whole * BLOCK_WORDS:].tolist(), block + whole), out

    def expire(self, state):
        kept, block = state
        return ([], block + 1), {"block": [block], "words": [len(kept)], **{c: [None] for c in ("scalars", "x", "y", "b")}}


def assemble_blocks(words: DataFrame, timeout_ms: int = TIMEOUT_MS, lateness: str = LATENESS) -> DataFrame:
    """201-word records from (source, seq, ts, data); a partial record waits in state for its missing words, and is given up
    after the timeout with a row of its number of words and null arrays."""
    output = "source bigint, block bigint, words bigint, scalars array<bigint>, x array<bigint>, y array<bigint>, b array<bigint>"
    return by_source(words, BlockAssembler(timeout_ms), output, lateness)


#: Owners that are laid out at once.
OWNERS = 4096


class OwnershipCheck(OrderedSource):
    """(cells covered beyond the first gap, first gap, frame, owners of the open frame, sticky overflow) of a source."""

    state_schema = "covered array<bigint>, first_gap bigint, frame bigint, pending bigint, sticky boolean"
    start = ([], 0, 0, 0, False)

    def pending(self, state):
        return state[3] > 0

    def advance(self, state, rows):
        covered, first_gap, frame, pending, sticky = state
        names = ("block", "raw_strategy", "last", "x_blocks", "y_blocks")
        block, shape, last, width, height = (rows[c].to_numpy() for c in names)
        outcomes, at, n = [], 0, len(block)
        ends = np.flatnonzero(last.astype(bool)) + 1
        while at < n:
            following = np.searchsorted(ends, at, side="right")
            stop = min(int(ends[following]) if following < len(ends) else n, at + OWNERS)
            used, fault, done, covered, first_gap = _laid_out(covered, first_gap, *(c[at:stop] for c in (block, shape, last, width, height)))
            at, pending = at + used, pending + used - fault
            if fault or done:
                sticky = sticky or fault
                outcomes.append((frame, pending, "dropped" if fault else "complete", sticky))
                covered, first_gap, frame, pending = [], 0, frame + 1, 0
        columns = list(zip(*outcomes)) or [[]] * 4
        return (covered, first_gap, frame, pending, sticky), dict(zip(("frame", "owners", "outcome", "overflow"), map(list, columns)))

    def expire(self, state):
        _, _, frame, pending, _ = state
        return ([], 0, frame + 1, 0, True), {"frame": [frame], "owners": [pending], "outcome": ["expired"], "overflow": [True]}


def _laid_out(covered, first_gap, block, shape, last, width, height):
    """Lay owners of one frame on its cells up to the frame's end or its first fault.

    Returns (rows used, fault, done, cells covered beyond the first gap, first gap).  Every cell gets the number of the owner
    that covers it; the gap that owner i meets is the first cell whose number is i or more, found for all owners at once.
    """
    n = len(block)
    wide, high = np.where(shape == 2, 2, 1), np.where(shape == 1, 2, 1)
    x, y = block % width, block // width
    inside = (block >= first_gap) & (x + wide <= width) & (y + high <= height) & (width == width[0]) & (height == height[0])
    fits = int(inside.cumprod().sum())
    cells = np.concatenate([block[:fits], block[:fits][shape[:fits] == 2] + 1, (block + width)[:fits][shape[:fits] == 1]])
    owner = np.concatenate([np.arange(fits), np.flatnonzero(shape[:fits] == 2), np.flatnonzero(shape[:fits] == 1)])
    span = max([first_gap, *covered, *cells.tolist()]) - first_gap + 2
    by = np.full(span, n, np.int64)
    order = np.lexsort((owner, cells))
    cells, owner = cells[order], owner[order]
    twice = np.flatnonzero(cells[1:] == cells[:-1]) + 1  # the later owner of a cell overlaps
    clash = np.concatenate([owner[twice], owner[np.isin(cells, covered)]])
    once = np.append(True, cells[1:] != cells[:-1]) if len(cells) else np.zeros(0, bool)
    by[cells[once] - first_gap] = owner[once]
    by[np.asarray(covered, np.int64) - first_gap] = -1
    ahead = np.maximum.accumulate(by)
    gaps = first_gap + np.searchsorted(ahead, np.arange(fits + 1))  # the gap before owner i, and after the last
    wrong = np.ones(n, bool)
    wrong[:fits] = gaps[:fits] != block[:fits]
    wrong[clash] = True
    full = np.zeros(n, bool)
    full[:fits] = gaps[1:] == width[0] * height[0]
    wrong |= last.astype(bool) != full
    bad = int(np.argmax(wrong)) if wrong.any() else n
    if bad < n:
        return bad + 1, True, False, [], 0
    gap = int(gaps[-1])
    return n, False, bool(full[-1]), [int(c) for c in {*covered, *cells.tolist()} if c > gap], gap


def check_ownership(owners: DataFrame, timeout_ms: int = TIMEOUT_MS, lateness: str = LATENESS) -> DataFrame:
    """One outcome per frame from (source, seq, ts, block, raw_strategy, last, x_blocks, y_blocks).

    An owner must start at the first uncovered raster cell, stay inside the frame and overlap nothing; last must
    come exactly with full coverage.  A violation drops the frame and sets a sticky overflow; a frame without a further owner
    for the timeout is ``expired``.
    """
    return by_source(owners, OwnershipCheck(timeout_ms), "source bigint, frame bigint, owners bigint, outcome string, overflow boolean", lateness)


def running_counts(trace: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Words per stage and ingest-time window, for update mode: a window is given again whenever it grew."""
    windowed = trace.withWatermark("ts", lateness).groupBy(F.window("ts", width), "stage").agg(F.count(F.lit(1)).alias("words"))
    return windowed.select(F.col("window.start").alias("start"), "stage", "words")


def beat_gaps(trace: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Span and idle microseconds per window: time between first and last beat not accounted for by beats."""
    micros = F.unix_micros("ts")
    windowed = trace.withWatermark("ts", lateness).groupBy(F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("words"), F.min(micros).alias("_first"), F.max(micros).alias("_last")
    )
    return windowed.select(F.col("window.start").alias("start"), "words", (F.col("_last") - F.col("_first") + 1).alias("span"),
                           (F.col("_last") - F.col("_first") + 1 - F.col("words")).alias("bubbles"))
