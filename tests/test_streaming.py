import datetime

import numpy as np
import pandas as pd
import pytest

from blockfield.operators import trace as T
from blockfield.streaming import frames as S
from blockfield.streaming import ordered
from blockfield.streaming.tables import VersionedTable


def drain(spark, tmp_path, batches, schema, job, name):
    folder = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = job(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


T0 = datetime.datetime(2024, 1, 1)
EVENTS = "source bigint, seq bigint, ts timestamp, kind bigint, stage bigint, group bigint, index bigint, value bigint, last boolean, distance_q8 bigint, expected_words bigint"


def at(second):
    return T0 + datetime.timedelta(seconds=second)


def word(seq, last=False):
    return (1, seq, at(seq), S.WORD, 12, 0, 0, seq, last, 0, 0)


def test_frames_latch_config_and_keep_errors(spark, tmp_path):
    control = lambda seq, d, n: (1, seq, at(seq), S.CONTROL, None, None, None, None, None, d, n)
    batches = [
        [control(0, 256, 2), word(1), control(2, 512, 3)],
        [word(3, True), word(4), word(5, True)],
        [word(6), (1, 7, at(7), S.CLEAR, None, None, None, None, None, None, None), word(8), word(9, True)],
    ]
    rows = sorted(drain(spark, tmp_path, batches, EVENTS, S.delimit_frames, "frames_test"), key=lambda r: r["value"])
    got = [(r["value"], r["frame"], r["ordinal"], r["distance_q8"], r["protocol_error"]) for r in rows]
    assert got == [
        (1, 0, 0, 256, False), (3, 0, 1, 256, False),  # the later control row does not touch the running frame
        (4, 1, 0, 512, False), (5, 1, 1, 512, True),  # last one word early
        (6, 2, 0, 512, True), (8, 2, 1, 512, False), (9, 2, 2, 512, False),  # sticky until the clear row
    ]


def test_blocks_wait_for_their_words(spark, tmp_path):
    data = list(range(402))
    batches = [[(1, i, at(i), data[i]) for i in range(a, b)] for a, b in ((0, 150), (150, 210), (210, 402))]
    rows = sorted(drain(spark, tmp_path, batches, "source bigint, seq bigint, ts timestamp, data bigint", S.assemble_blocks, "blocks_test"), key=lambda r: r["block"])
    assert [r["block"] for r in rows] == [0, 1] and rows[1]["scalars"] == data[201:210] and rows[0]["b"] == data[137:201]


def test_malformed_owners_drop_the_frame(spark, tmp_path):
    owner = lambda seq, block, shape, last: (1, seq, at(seq), block, shape, last, 2, 2)
    batches = [
        [owner(0, 0, 1, False), owner(1, 1, 1, True)],  # two vertical pairs cover 2x2
        [owner(2, 1, 0, False)],  # gap
        [owner(3, 0, 2, False), owner(4, 2, 2, True), owner(5, 0, 0, True)],  # good, then an early last
    ]
    schema = "source bigint, seq bigint, ts timestamp, block bigint, raw_strategy bigint, last boolean, x_blocks bigint, y_blocks bigint"
    rows = sorted(drain(spark, tmp_path, batches, schema, S.check_ownership, "owners_test"), key=lambda r: r["frame"])
    assert [(r["frame"], r["owners"], r["outcome"], r["overflow"]) for r in rows] == [
        (0, 2, "complete", False), (1, 0, "dropped", True), (2, 2, "complete", True), (3, 0, "dropped", True)]


def words_of(frames, drop_last=(), start=0):
    """Word rows of frames of given lengths; frames in drop_last have no last flag."""
    rows, seq = [], start
    for k, n in enumerate(frames):
        rows += [word(seq + i, i == n - 1 and k not in drop_last) for i in range(n)]
        seq += n
    return rows


def other(second):
    """A row of another source that moves the watermark."""
    return (2, 0, at(second), S.WORD, 12, 0, 0, 0, True, 0, 0)


def test_rows_in_any_order_give_the_frames_of_the_order(spark, tmp_path):
    rows = words_of([3, 5, 1, 4, 7])
    order = np.random.default_rng(2).permutation(len(rows)).tolist()
    batches = [[rows[i] for i in part] for part in (order[:6], order[6:9], order[9:] + order[:4])]  # some rows come twice
    got = sorted(drain(spark, tmp_path, batches, EVENTS, S.delimit_frames, "shuffled"), key=lambda r: r["value"])
    assert [(r["value"], r["frame"], r["ordinal"]) for r in got] == [(i, f, o) for i, (f, o) in enumerate((f, o) for f, n in enumerate([3, 5, 1, 4, 7]) for o in range(n))]


def test_a_frame_that_never_ends_is_closed_by_the_timer(spark, tmp_path):
    rows = words_of([3, 4], drop_last=(1,))
    batches = [rows, [other(5000)], [(2, 1, at(5001), S.WORD, 12, 0, 0, 1, True, 0, 0)]]
    got = [r for r in drain(spark, tmp_path, batches, EVENTS, S.delimit_frames, "expiring") if r["source"] == 1]
    closing = [r for r in got if r["outcome"]]
    assert [(r["frame"], r["ordinal"], r["value"], r["outcome"], r["protocol_error"]) for r in closing] == [(1, 4, None, "expired", True)]
    assert len(got) == 8


def test_a_lost_row_ends_one_frame_and_the_rest_go_on(spark, tmp_path):
    rows = words_of([3, 4, 2])
    batches = [rows[:4] + rows[5:], [other(5000)], [(2, 1, at(5001), S.WORD, 12, 0, 0, 1, True, 0, 0)], [(2, 2, at(9999), S.WORD, 12, 0, 0, 2, True, 0, 0)]]
    got = sorted((r for r in drain(spark, tmp_path, batches, EVENTS, S.delimit_frames, "lost") if r["source"] == 1), key=lambda r: (r["frame"], r["ordinal"]))
    assert [(r["frame"], r["value"], r["outcome"]) for r in got] == [
        (0, 0, None), (0, 1, None), (0, 2, None), (1, 3, None), (1, None, "expired"), (2, 5, None), (2, 6, None), (3, 7, None), (3, 8, None)]


def test_a_record_that_never_ends_is_given_up(spark, tmp_path):
    schema = "source bigint, seq bigint, ts timestamp, data bigint"
    batches = [[(1, i, at(i), i) for i in range(250)], [(2, 0, at(9000), 1)], [(2, 1, at(9001), 1)]]
    got = sorted((r["block"], r["words"], r["scalars"] is None) for r in drain(spark, tmp_path, batches, schema, S.assemble_blocks, "given_up") if r["source"] == 1)
    assert got == [(0, 201, False), (1, 49, True)]


def test_waiting_rows_are_held_in_chunks_of_state(spark, tmp_path, monkeypatch):
    """The first row comes last: what waits is in chunks, no chunk longer than the bound, and nothing is left afterwards."""
    held = []

    class Values:
        def __init__(self):
            self.kept = {}

        def exists(self):
            return bool(self.kept)

        def get(self):
            return self.kept[0]

        def update(self, value):
            self.kept[0] = value

        def containsKey(self, key):
            return key in self.kept

        def getValue(self, key):
            return self.kept[key]

        def updateValue(self, key, value):
            self.kept[key] = value
            held.append(len(ordered._unpacked(value[0])))

        def removeKey(self, key):
            del self.kept[key]

        def keys(self):
            return iter(list(self.kept))

    class Handle:
        timers = set()

        def getValueState(self, *_):
            return Values()

        getMapState = getValueState

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    monkeypatch.setattr(ordered, "CHUNK", 100)
    machine, names = S.BlockAssembler(1000), ["source", "seq", "ts", "data"]
    machine.init(Handle())
    rows = pd.DataFrame([(1, i, pd.Timestamp(at(i)), i) for i in range(1, 2010)], columns=names)
    assert list(machine.handleInputRows((1,), iter([rows[:700], rows[700:]]), None)) == []
    assert max(held) == 100 and len(machine.early.kept) == 21 and len(machine.handle.timers) == 1
    out = pd.concat(machine.handleInputRows((1,), iter([pd.DataFrame([(1, 0, pd.Timestamp(at(0)), 0)], columns=names)]), None))
    assert out["block"].tolist() == list(range(10)) and not machine.early.kept and not machine.machine.get()[0]


def slow_ownership(owners):
    """The rule, owner by owner."""
    covered, gap, frame, pending, sticky, out = set(), 0, 0, 0, False, []
    for block, shape, last, width, height in owners:
        wide, high = (2 if shape == 2 else 1), (2 if shape == 1 else 1)
        cells = {block} | ({block + 1} if wide == 2 else set()) | ({block + width} if high == 2 else set())
        fits = block % width + wide <= width and block // width + high <= height and block == gap and not cells & covered
        if fits:
            covered |= cells
            while gap in covered:
                gap += 1
        done = gap == width * height
        if not fits or last != done:
            sticky = True
            out.append((frame, pending, "dropped", sticky))
        elif done:
            out.append((frame, pending + 1, "complete", sticky))
        else:
            pending += 1
            continue
        covered, gap, frame, pending = set(), 0, frame + 1, 0
    return out


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_ownership_of_random_owners(pieces):
    rng = np.random.default_rng(pieces)
    owners = []
    for _ in range(150):
        width, height = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        free, rows = [c for c in range(width * height)], []
        while free:
            c = free[0]
            options = [0] + [1] * (c + width in free) + [2] * (c % width + 1 < width and c + 1 in free)
            shape = int(rng.choice(options))
            for cell in (c, c + width if shape == 1 else c, c + 1 if shape == 2 else c):
                if cell in free:
                    free.remove(cell)
            rows.append([c, shape, not free, width, height])
        if rng.random() < 0.4:
            k, what = int(rng.integers(len(rows))), int(rng.integers(3))
            rows[k][what] = [int(rng.integers(width * height)), int(rng.integers(3)), not rows[k][2]][what]
        owners += rows
    frame = pd.DataFrame(owners, columns=["block", "raw_strategy", "last", "x_blocks", "y_blocks"])
    machine, state, got = S.OwnershipCheck(1000), S.OwnershipCheck.start, []
    for part in np.array_split(np.arange(len(frame)), pieces):
        state, out = machine.advance(state, frame.iloc[part])
        got += list(zip(*out.values()))
    assert got == slow_ownership(owners) and {o[2] for o in got} == {"complete", "dropped"}


def test_versions_of_a_replayed_batch(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "table"), ["k"], "k bigint, n bigint", every=3)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k bigint, n bigint")
    batches = [rows((1, 1), (2, 1)), rows((1, 2)), rows((3, 5), (2, 4)), rows((1, 7))]
    for i, b in enumerate(batches):
        table.merge(b, i)
        table.merge(b, i)
    want = {(1, 7), (2, 4), (3, 5)}
    assert set(map(tuple, table.read(spark).collect())) == want
    for i, b in enumerate(batches):  # a replay of any batch, also of those a base holds
        table.merge(b, i)
        assert set(map(tuple, table.read(spark).collect())) == want


def test_word_records_round_trip(spark):
    rows = [(0, b, 5, 7340, 117029, 1, 2, 3, 65536, -7, 9, *[[(k - 32) * (b + 1) for k in range(64)] for _ in range(3)]) for b in range(3)]
    names = "quant scale_q16 inv_qac_q16 inv_dc_x_q16 inv_dc_y_q16 inv_dc_b_q16 x_qm_q16 ytox ytob".split()
    schema = "frame_id bigint, block bigint, " + ", ".join(f"{n} bigint" for n in names) + ", x array<bigint>, y array<bigint>, b array<bigint>"
    blocks = spark.createDataFrame(rows, schema)
    back = T.unpack_prepared_words(T.pack_prepared_words(blocks)).orderBy("block").collect()
    assert [tuple(r[c] for c in blocks.columns) for r in back] == rows and all(r["complete"] for r in back)
