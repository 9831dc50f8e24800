"""Per-individual time series: rolling values, counters, sticky flags, trips.

Row-level results come from span scans (plans.ordered); per-individual results are plain
groupBy aggregates, so neither needs a whole individual in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.operators.filters import active_mask
from driftgrid.plans.ordered import STEP_SPAN, previous, ranked, running, scan

KEY, T = "agent_id", "time"


def rolling_mean3(tracks: DataFrame, value: str, initial: float = 15.0, span: int = STEP_SPAN) -> DataFrame:
    """Mean of the last three samples of active rows; missing history counts as initial.

    Rows that are dead or arrived keep the mean of their last active row.
    """
    v = F.when(active_mask(), F.col(value))

    def history(rows, w):
        """__v, and on active rows the two values before it in __p1 and __p2."""
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("__p1", F.last("__v", ignorenulls=True).over(before))
        older = F.when(F.col("__seed"), F.col("__seed_b")).otherwise(F.col("__p1")) if "__seed_b" in rows.columns else F.col("__p1")
        pair = F.when(F.col("__v").isNotNull(), F.struct("__v", older.alias("p")))
        return rows.withColumn("__p2", F.last(pair, ignorenulls=True).over(before)["p"])

    def last_three(spans, cw):
        """The last three active values before each span, from the last three within each span."""
        a = F.last("t1", ignorenulls=True).over(cw)
        spans = spans.withColumn("pa", a).withColumn("b", F.when(F.col("t1").isNotNull(), F.coalesce("t2", "pa")))
        spans = spans.withColumn("pb", F.last(F.when(F.col("t1").isNotNull(), F.struct("b")), ignorenulls=True).over(cw)["b"])
        third = F.coalesce("t3", F.when(F.col("t2").isNull(), F.col("pb")).otherwise(F.col("pa")))
        spans = spans.withColumn("s", F.when(F.col("t1").isNotNull(), F.struct(F.col("t1").alias("a"), "b", third.alias("c"))))
        s = F.last("s", ignorenulls=True).over(cw)
        return spans.withColumn("s", s).select(KEY, "__span", F.col("s.a").alias("__v"), F.col("s.b").alias("__seed_b"), F.col("s.c").alias("__seed_c"))

    def means(rows, w):
        rows = history(rows, w)
        def or_start(c):
            return F.coalesce(c, F.lit(initial))
        p1 = F.when(F.col("__seed"), F.col("__seed_b")).otherwise(F.col("__p1"))
        p2 = F.when(F.col("__seed"), F.col("__seed_c")).otherwise(F.col("__p2"))
        own = F.when(F.col("__v").isNotNull(), (F.col("__v") + or_start(p1) + or_start(p2)) / 3.0)
        rows = rows.withColumn("__m", own)
        return rows.withColumn("mean3", or_start(F.last("__m", ignorenulls=True).over(w)))

    newest = F.when(F.col("__v").isNotNull(), F.col(T))
    out = scan(tracks.withColumn("__v", v), [KEY], T, local=history, state=last_three, apply=means, span=span,
               totals=[F.max_by(c, newest).alias(n) for n, c in (("t1", "__v"), ("t2", "__p1"), ("t3", "__p2"))])
    return out.select(*tracks.columns, "mean3")


def residence_counters(tracks: DataFrame, in_state: Column, start: int = 999, span: int = STEP_SPAN) -> DataFrame:
    """hours in the state and steps since it, counted over active rows and frozen otherwise."""
    act, on = F.col("__act"), F.col("__on")

    def local(rows, w):
        return rows.withColumn("__rn", F.sum(act.cast("long")).over(w))

    def state(spans, cw):
        spans = spans.withColumn("base", F.coalesce(F.sum("n").over(cw), F.lit(0)))
        return spans.select(KEY, "__span", F.col("base").alias("__seed_rn"), F.max(F.col("base") + F.col("li")).over(cw).alias("__seed_in"),
                            F.max(F.col("base") + F.col("lo")).over(cw).alias("__seed_out"), F.last("st", ignorenulls=True).over(cw).alias("__seed_st"))

    def apply(rows, w):
        seed = F.col("__seed")
        rows = rows.withColumn("__rn", F.sum(F.when(seed, F.col("__seed_rn")).otherwise(act.cast("long"))).over(w))
        return rows.withColumns({
            "__in": F.max(F.when(seed, F.col("__seed_in")).when(act & on, F.col("__rn"))).over(w),
            "__out": F.max(F.when(seed, F.col("__seed_out")).when(act & ~on, F.col("__rn"))).over(w),
            "__st": F.last(F.when(seed, F.col("__seed_st")).when(act, on), ignorenulls=True).over(w)})

    rows = scan(tracks.withColumns({"__act": active_mask(), "__on": in_state}), [KEY], T, local=local, state=state, apply=apply, span=span,
                totals=[F.sum(act.cast("long")).alias("n"), F.max(F.when(act & on, F.col("__rn"))).alias("li"),
                        F.max(F.when(act & ~on, F.col("__rn"))).alias("lo"), F.max_by(on, F.when(act, F.col(T))).alias("st")])
    inside = F.coalesce("__st", F.lit(False))
    hours = F.when(inside, F.col("__rn") - F.coalesce("__out", F.lit(0))).otherwise(0)
    since = (F.when(inside, 0).when(F.col("__in").isNull(), F.lit(start) + F.col("__rn")).otherwise(F.col("__rn") - F.col("__in")))
    return rows.select(*tracks.columns, hours.alias("hours_in"), since.alias("steps_since"))


def step_timers(tracks: DataFrame, countdown: int, span: int = STEP_SPAN) -> DataFrame:
    """steps: active rows so far; left: the countdown minus them, not below zero."""
    out = running(tracks, [KEY], T, {"steps": ("sum", active_mask().cast("long"))}, span=span)
    return out.withColumn("left", F.greatest(F.lit(countdown) - F.col("steps"), F.lit(0)))


def field_rate(field: DataFrame, value: str, key: str = "cell_id", t: str = "t", span: int = STEP_SPAN) -> DataFrame:
    """value minus the previous value of the cell; 0 on its first step."""
    out = previous(field, [key], t, {"__before": value}, span=span)
    return out.withColumn("rate", F.coalesce(F.col(value) - F.col("__before"), F.lit(0.0))).drop("__before")


def with_region(tracks: DataFrame, cells: DataFrame, *extra: str) -> DataFrame:
    """Region (and other cell columns) at each row; null off the mesh, so -1 never matches a cell."""
    return tracks.join(cells.select(F.col("cell_id").alias("cell"), "region_id", *extra), "cell", "left")


def _visit(regions) -> Column:
    return F.coalesce(F.col("alive") & (F.col("cell") >= 0) & F.col("region_id").isin(list(regions)), F.lit(False))


def first_touch(tracks: DataFrame, cells: DataFrame, regions) -> DataFrame:
    """First region of the set that a living individual touched: (agent_id, region_id, time)."""
    hit = with_region(tracks, cells).filter(_visit(regions))
    return (hit.groupBy(KEY).agg(F.min_by("region_id", T).alias("region_id"), F.min(T).alias(T)))


def first_touch_rows(tracks: DataFrame, cells: DataFrame, regions, span: int = STEP_SPAN) -> DataFrame:
    """The sticky tag on every row, -1 before the first touch."""
    rows = with_region(tracks, cells)
    out = running(rows, [KEY], T, {"tag": ("first", F.when(_visit(regions), F.col("region_id")))}, span=span)
    return out.select(*tracks.columns, F.coalesce("tag", F.lit(-1)).alias("tag"))


def ever_in(tracks: DataFrame, cells: DataFrame, regions, name: str = "ever_in", span: int = STEP_SPAN) -> DataFrame:
    """Sticky flag: true from the first living visit on."""
    out = running(with_region(tracks, cells), [KEY], T, {name: ("max", _visit(regions))}, span=span)
    return out.select(*tracks.columns, name)


def arrival(tracks: DataFrame, cells: DataFrame, natal: DataFrame, thresholds: DataFrame, at_sea) -> DataFrame:
    """First row in the upper part of the natal region after a sea visit: (agent_id, time, cell).

    A sea visit in the same step counts; a region without a threshold is never reached.
    """
    rows = running(with_region(tracks, cells, "dist"), [KEY], T, {"__sea": ("max", _visit(at_sea))})
    goal = natal.select(KEY, "natal").join(thresholds.select(F.col("region_id").alias("natal"), "threshold"), "natal")
    hit = (rows.filter(F.col("alive") & (F.col("cell") >= 0) & F.col("__sea")).join(goal, KEY)
           .filter((F.col("region_id") == F.col("natal")) & (F.col("dist") >= F.col("threshold"))))
    return hit.groupBy(KEY).agg(F.min(T).alias(T), F.min_by("cell", T).alias("cell"))


def natal_region(tracks: DataFrame, cells: DataFrame) -> DataFrame:
    """Region of the first row's cell, -1 off the mesh."""
    first = tracks.groupBy(KEY).agg(F.min_by("cell", T).alias("cell"))
    return with_region(first, cells).select(KEY, F.coalesce("region_id", F.lit(-1)).cast("int").alias("natal"))


def trips(tracks: DataFrame, centroids: DataFrame, length: int = 40, sample: DataFrame | None = None) -> DataFrame:
    """Paths of the last `length` steps as arrays of (x, y, t) for every individual that starts alive.

    An array holds at most `length` points. `sample` (agent_id) restricts the individuals, if given. Dead
    rows are left out; fewer than two points or no movement gives no trip.
    """
    tracked = tracks.groupBy(KEY).agg(F.min_by("alive", T).alias("alive")).filter("alive").select(KEY)
    if sample is not None:
        tracked = tracked.join(sample.select(KEY), KEY, "left_semi")
    end = tracks.agg(F.max(T)).scalar()
    last = (tracks.filter("alive").groupBy(KEY).agg(F.max_by("behavior", T).alias("behavior")))
    pts = (tracks.filter("alive").withColumn("__t", F.col(T) - (end - length + 1)).filter(F.col("__t") >= 0)
           .join(centroids.select(F.col("cell_id").alias("cell"), "x", "y"), "cell")
           .join(tracked, KEY, "left_semi"))
    # At most `length` rows per individual are gathered here.
    path = pts.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(F.col("__t").alias("t"), "x", "y"))).alias("p"))
    moved = F.exists("p", lambda q: (q["x"] != F.col("p")[0]["x"]) | (q["y"] != F.col("p")[0]["y"]))
    return (path.filter((F.size("p") >= 2) & moved).join(last, KEY)
            .select(KEY, F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["t"].alias("t"))).alias("path"), "behavior"))


def assign_ids(df: DataFrame, order: str, next_id: Column, name: str = "agent_id", ties=()) -> DataFrame:
    """Consecutive ids from next_id on, in order, by distributed rank."""
    out = ranked(df, [], order, "__rank", ties=ties)
    return out.withColumn(name, (next_id + F.col("__rank") - 1).cast("long")).drop("__rank")
