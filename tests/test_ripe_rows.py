"""Rows whose hour the watermark has passed are handled when they come; trips carry the time that orders them."""

import pandas as pd

from driftgrid.streaming.state import SLOT_MS, Moves, Trips


class Kept:
    """Map and list state of one key, and the number of writes."""

    def __init__(self):
        self.rows, self.memo, self.writes, self.timers = {}, [], 0, set()

    def containsKey(self, k): return k in self.rows
    def getValue(self, k): return self.rows[k]
    def keys(self): return list(self.rows)
    def removeKey(self, k): del self.rows[k]
    def get(self): return list(self.memo)
    def put(self, rows): self.memo = rows
    def registerTimer(self, t): self.timers.add(t)
    def deleteTimer(self, t): self.timers.discard(t)

    def updateValue(self, k, v):
        self.rows[k], self.writes = v, self.writes + 1

    def getMapState(self, *_): return self
    def getListState(self, *_): return self


class Now:
    def __init__(self, hours): self.at = hours * SLOT_MS
    def getCurrentWatermarkInMs(self): return self.at


def started(processor):
    kept = Kept()
    processor.init(kept)
    return processor, kept


def moves(*rows):
    frame = pd.DataFrame(rows, columns=["agent_id", "hour", "cell"])
    return frame.assign(ts=pd.to_datetime(frame["hour"], unit="h"), event_id=frame["hour"], alive=True).drop(columns="hour")


def test_ripe_rows_are_not_stored_and_waiting_ones_go_before_them():
    p, kept = started(Moves())
    assert list(p.handleInputRows(0, iter([moves((1, 5, 10))]), Now(2))) == [] and kept.writes == 1
    out = pd.concat(p.handleInputRows(0, iter([moves((1, 6, 11), (1, 7, 12))]), Now(8)))
    assert kept.writes == 1 and not kept.rows and not kept.timers
    assert sorted(zip(out["event_id"], out["cell_id"], out["d"], strict=True)) == [(6, 10, -1), (6, 11, 1), (7, 11, -1), (7, 12, 1)]


def test_a_step_without_waypoint_comes_after_the_last_waypoint():
    p, _ = started(Trips())
    def step(hour, x, behavior):
        return pd.DataFrame([(1, pd.Timestamp(hour * 3600, unit="s"), hour, True, x, x, behavior)], columns=["agent_id", "ts", "event_id", "alive", "x", "y", "behavior"])
    first = pd.concat(p.handleInputRows(0, iter([step(1, 0.0, 0), step(2, 1.0, 0)]), Now(3)))
    then = pd.concat(p.handleInputRows(0, iter([step(4, None, 3)]), Now(5)))
    assert first["us"].iloc[0] == then["us"].iloc[0] and first["at"].iloc[0] < then["at"].iloc[0]
    assert then["behavior"].iloc[0] == 3 and then["moved"].iloc[0]
