"""Per-individual state on a position stream, in columns.

Individuals are dealt into buckets, and a bucket is the key of the state: one call handles all rows of a
bucket whose time has come as one ordered frame, with vector steps. Rows of hours that the watermark has passed are
handled when they come, as those of `hourly_steps` always are; others wait in a map from hour to rows until it has, so a
timer reads only the rows that are ripe. Hours are handled in order, so results do not depend on
arrival order within the watermark delay. Rows older than the watermark are dropped by Spark and
counted in numRowsDroppedByWatermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftgrid.plans.lineage import ship

TRAIL = 40              # waypoints of a trip unless the caller says otherwise
SLOT_MS = 3_600_000     # rows wait by the hour

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _fields(ddl: str) -> list[tuple[str, T.DataType]]:
    """Names and types of "name type, ..."; workers have no session to parse DDL with."""
    out = []
    for part in ddl.split(","):
        name, kind = part.strip().split(" ")
        out.append((name, T.ArrayType(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind]))
    return out


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


class InOrder(StatefulProcessor):
    """Buffers the rows of a bucket and hands them on in (individual, ts, event_id) order once the watermark has passed their hour.

    Subclasses give the carried columns, the memo kept per individual, the output, and advance(), which gets the ripe rows and the
    memo of every individual in them, and returns output rows and the new memo.
    """

    carry: str = ""
    memo: str = ""
    schema: str = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = ["agent_id", "us", "event_id", *[n for n, _ in _fields(self.carry)]]
        rows = _fields("agent_id long, us long, event_id long, " + self.carry)
        self.pending = handle.getMapState("pending", _struct([("slot", T.LongType())]), _struct([(n, T.ArrayType(t)) for n, t in rows]))
        self.kept = handle.getListState("memo", _struct(_fields("agent_id long, " + self.memo)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        frame["us"] = frame["ts"].astype("datetime64[us]").astype("int64")
        slots, open_ = frame["us"] // (SLOT_MS * 1000), timerValues.getCurrentWatermarkInMs() // SLOT_MS
        ripe, frame = frame.loc[slots < open_, self.columns], frame[slots >= open_]
        for slot, part in frame.groupby(slots[slots >= open_], sort=False):
            new = [part[c].tolist() for c in self.columns]
            at = (int(slot),)
            if self.pending.containsKey(at):
                new = [[*old, *more] for old, more in zip(self.pending.getValue(at), new, strict=True)]
            else:
                self.handle.registerTimer((int(slot) + 1) * SLOT_MS)
            self.pending.updateValue(at, tuple(new))
        if len(ripe):
            yield from self.settle(open_, ripe)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # After a jump of the watermark many hours are ripe at once: the first timer takes them all and ends the others.
        yield from self.settle(timerValues.getCurrentWatermarkInMs() // SLOT_MS, None, expiredTimerInfo.getExpiryTimeInMs())

    def settle(self, open_: int, new: pd.DataFrame | None, fired: int | None = None) -> Iterator[pd.DataFrame]:
        """Output of all rows of hours before open_, those that wait and the new ones together; fired is the timer that ends by itself."""
        slots = sorted(slot for slot, in self.pending.keys() if slot < open_)
        parts = [pd.DataFrame(dict(zip(self.columns, self.pending.getValue((slot,)), strict=True))) for slot in slots]
        parts += [new] if new is not None else []
        if not parts:
            return
        for slot in slots:
            self.pending.removeKey((slot,))
            if (slot + 1) * SLOT_MS != fired:
                self.handle.deleteTimer((slot + 1) * SLOT_MS)
        ripe = pd.concat(parts, ignore_index=True)
        ripe = ripe.sort_values(["agent_id", "us", "event_id"], ignore_index=True)
        names = ["agent_id", *[n for n, _ in _fields(self.memo)]]
        memo = pd.DataFrame([tuple(r) for r in self.kept.get()], columns=names)
        here = memo["agent_id"].isin(ripe["agent_id"].unique())
        out, new = self.advance(ripe, memo[here].set_index("agent_id"))
        both = pd.concat([f for f in (memo[~here], new.reset_index()[names]) if len(f)])
        self.kept.put(list(zip(*[both[c].tolist() for c in names], strict=True)))
        if len(out):
            yield out[[n for n, _ in _fields(self.schema)]]

    def advance(self, rows: pd.DataFrame, memo: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _before(rows: pd.DataFrame, memo: pd.DataFrame, column: str, start) -> pd.Series:
    """The memo of each row's individual, or the start value."""
    known = memo[column] if len(memo) else pd.Series(dtype="float64")
    return rows["agent_id"].map(known).where(rows["agent_id"].isin(memo.index), start)


def _carried(rows: pd.DataFrame, value: pd.Series, at: pd.Series, before: pd.Series) -> pd.Series:
    """value where `at` holds, else the last one of the individual before, else what it had before these rows."""
    return value.where(at).groupby(rows["agent_id"]).ffill().where(at.groupby(rows["agent_id"]).cummax(), before)


def _last(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.drop_duplicates("agent_id", keep="last").set_index("agent_id")


class RollingMean(InOrder):
    """Mean of the last three active values, frozen while dead or arrived."""
    carry, memo = "value double, active boolean", "a double, b double, mean double"
    schema = "agent_id long, event_id long, mean3 double"

    def advance(self, rows, memo):
        a, b, mean = (_before(rows, memo, c, 15.0).astype("float64") for c in ("a", "b", "mean"))
        on = rows["active"].astype(bool)
        act = rows[on]
        nth = act.groupby("agent_id").cumcount()
        one = act.groupby("agent_id")["value"].shift(1).where(nth > 0, a[on])
        two = act.groupby("agent_id")["value"].shift(2).where(nth > 1, a[on].where(nth == 1, b[on]))
        rows = rows.assign(a=_carried(rows, rows["value"], on, a), b=_carried(rows, one.reindex(rows.index), on, b),
                           mean=_carried(rows, ((act["value"] + one + two) / 3.0).reindex(rows.index), on, mean))
        return rows.assign(mean3=rows["mean"]), _last(rows)


class Residence(InOrder):
    """Steps in a state and since it."""
    carry, memo = "in_state boolean, active boolean", "hours long, since long"
    schema = "agent_id long, event_id long, hours_in long, steps_since long"

    def advance(self, rows, memo):
        hours, since = _before(rows, memo, "hours", 0).astype("int64"), _before(rows, memo, "since", 999).astype("int64")
        on, inside = rows["active"].astype(bool), rows["in_state"].astype(bool)
        n = on.astype("int64").groupby(rows["agent_id"]).cumsum()
        left = n.where(on & ~inside, 0).groupby(rows["agent_id"]).cummax()
        been = n.where(on & inside, 0).groupby(rows["agent_id"]).cummax()
        h = (n - left + hours.where(left == 0, 0)).where(inside, 0)
        s = (n - been + since.where(been == 0, 0)).where(~inside, 0)
        rows = rows.assign(hours=_carried(rows, h, on, hours).astype("int64"), since=_carried(rows, s, on, since).astype("int64"))
        return rows.assign(hours_in=rows["hours"], steps_since=rows["since"]), _last(rows)


class Sticky(InOrder):
    """First touch, ever-in and arrival of one pass. Region, the taggable region (-1 = none),
    at_sea and upper (far enough up its region) come with the row; the first row's region is natal."""
    carry = "alive boolean, region int, tag_region int, at_sea boolean, upper boolean"
    memo = "natal int, tag int, ever boolean, arrived boolean"
    schema = "agent_id long, event_id long, tag int, ever_in boolean, arrived boolean"

    def advance(self, rows, memo):
        who, alive = rows["agent_id"], rows["alive"].astype(bool)
        first = rows.groupby("agent_id")["region"].transform("first")
        known = who.isin(memo.index)
        natal = _before(rows, memo, "natal", -2).astype("int64").where(known, first)
        tag, ever, arrived = (_before(rows, memo, c, start) for c, start in (("tag", -1), ("ever", False), ("arrived", False)))
        tag, ever, arrived = tag.astype("int64"), ever.astype(bool), arrived.astype(bool)
        hit = alive & (rows["tag_region"] >= 0)
        own = rows["tag_region"].where(hit).groupby(who).transform("first")
        tag = tag.where(tag != -1, own.where(hit.groupby(who).cummax(), -1)).astype("int32")
        ever = ever | (alive & rows["at_sea"].astype(bool)).groupby(who).cummax()
        up = alive & ever & (natal >= 0) & (rows["region"] == natal) & rows["upper"].astype(bool)
        rows = rows.assign(natal=natal.astype("int32"), tag=tag, ever=ever, arrived=arrived | up.groupby(who).cummax())
        return rows.assign(ever_in=rows["ever"]), _last(rows)


class Trips(InOrder):
    """The last `length` waypoints of a living individual; one row per individual whenever it advanced.

    at is the time of the row that advanced it, which need not be a waypoint; moved says whether the waypoints differ.
    """
    carry, memo = "alive boolean, x double, y double, behavior int", "us array<long>, xs array<double>, ys array<double>, behavior int"
    schema = "agent_id long, at long, moved boolean, us array<long>, xs array<double>, ys array<double>, behavior int"

    def __init__(self, length: int = TRAIL):
        self.length = length

    def advance(self, rows, memo):
        alive = rows[rows["alive"].astype(bool)]
        behavior = alive.groupby("agent_id")["behavior"].last()
        old = memo.reset_index()[["agent_id", "us", "xs", "ys"]].explode(["us", "xs", "ys"]).dropna(subset=["us"])
        new = alive[alive["x"].notna()].rename(columns={"x": "xs", "y": "ys"})[["agent_id", "us", "xs", "ys"]]
        points = pd.concat([f for f in (old, new) if len(f)]).astype({"us": "int64", "xs": "float64", "ys": "float64"}) if len(old) + len(new) else new
        points = points.groupby("agent_id", sort=False).tail(self.length).sort_values("agent_id", kind="stable")
        who = np.sort(rows["agent_id"].unique())
        cut = np.searchsorted(points["agent_id"].to_numpy(), who)
        lists = {c: [p.tolist() for p in np.split(points[c].to_numpy(), cut)[1:]] for c in ("us", "xs", "ys")}
        out = pd.DataFrame({"agent_id": who, **lists}).set_index("agent_id")
        out["behavior"] = behavior.reindex(who).fillna(memo["behavior"].reindex(who)).fillna(-1).astype("int32")
        spread = points.groupby("agent_id")[["xs", "ys"]].agg(["min", "max"])
        moved = (spread[("xs", "min")] != spread[("xs", "max")]) | (spread[("ys", "min")] != spread[("ys", "max")])
        at = rows.groupby("agent_id")["us"].last().reindex(who)
        return out.assign(at=at, moved=moved.reindex(who, fill_value=False)).reset_index(), out


class Moves(InOrder):
    """Arrivals (+1) and departures (-1) per cell of living movers."""
    carry, memo = "alive boolean, cell long", "cell long"
    schema = "agent_id long, event_id long, cell_id long, d int"

    def advance(self, rows, memo):
        before = _before(rows, memo, "cell", -2).astype("int64")
        old = rows.groupby("agent_id")["cell"].shift(1, fill_value=-2).where(rows.groupby("agent_id").cumcount() > 0, before)
        hit = rows["alive"].astype(bool) & (old != -2) & (old != rows["cell"])
        came = rows[hit].assign(cell_id=rows.loc[hit, "cell"], d=1)
        return pd.concat([came, came.assign(cell_id=old[hit], d=-1)]).astype({"d": "int32"}), _last(rows)


def keyed(stream: DataFrame, processor: InOrder, buckets: int | None = None) -> DataFrame:
    """Run a processor in event time over buckets of individuals, four for each shuffle partition unless given.

    The number of buckets is part of a checkpoint: a query that goes on from one must keep it.
    """
    ship(type(processor))
    n = buckets or 4 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (stream.withColumn("bucket", F.pmod(F.xxhash64("agent_id"), F.lit(n)).cast("int")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.schema, outputMode="append", timeMode="EventTime"))


def active():
    return F.col("alive") & ~F.col("arrived")


def rolling_mean(positions: DataFrame, value: str) -> DataFrame:
    return keyed(positions.select("agent_id", "event_id", "ts", F.col(value).alias("value"), active().alias("active")), RollingMean())


def residence(positions: DataFrame, in_state) -> DataFrame:
    return keyed(positions.select("agent_id", "event_id", "ts", in_state.alias("in_state"), active().alias("active")), Residence())


def sticky(positions: DataFrame, cells: DataFrame, thresholds: DataFrame, tag_regions, at_sea) -> DataFrame:
    """Joins the static cells and thresholds, then carries the flags."""
    thr = thresholds.select("region_id", "threshold")
    static = (cells.select(F.col("cell_id").alias("cell"), "region_id", "dist").join(thr, "region_id", "left")
              .select("cell", "region_id", F.coalesce(F.col("dist") >= F.col("threshold"), F.lit(False)).alias("upper")))
    p = positions.join(static, "cell", "left")
    region = F.coalesce("region_id", F.lit(-1)).cast("int")
    return keyed(p.select("agent_id", "event_id", "ts", "alive", region.alias("region"),
                          F.when(region.isin(list(tag_regions)), region).otherwise(-1).alias("tag_region"), region.isin(list(at_sea)).alias("at_sea"),
                          F.coalesce("upper", F.lit(False)).alias("upper")), Sticky())


def trips(positions: DataFrame, centroids: DataFrame, length: int = TRAIL) -> DataFrame:
    """Trails of the last `length` waypoints as they advance; the row with the largest `at` is the current one."""
    xy = centroids.select(F.col("cell_id").alias("cell"), "x", "y")
    p = positions.join(xy, "cell", "left")
    return keyed(p.select("agent_id", "event_id", "ts", "alive", "x", "y", "behavior"), Trips(length))


def moves(positions: DataFrame) -> DataFrame:
    return keyed(positions.select("agent_id", "event_id", "ts", "alive", "cell"), Moves())
