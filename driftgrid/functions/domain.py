"""Formulas of energy, salinity, oxygen, behaviour and distance as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgrid.functions import num
from driftgrid.functions.rand import count_le_row, cumulative

# Behaviour codes.
HOLD, RANDOM, TO_REFUGE, UPSTREAM, DOWNSTREAM = 0, 1, 2, 3, 4

# Respiration and energy parameters.
RA, RB, RQ = 0.00264, -0.217, 0.06818
OXYCAL = 13560.0
ED_TISSUE = 36.0
ED_MORTAL = 4.0
MASS_FLOOR = 0.5
T_MAX = 26.0

# Earth radius in metres; metres per degree.
EARTH_RADIUS = 6371000.0
M_PER_DEG_LON_EQUATOR = 111320.0
M_PER_DEG_LAT = 110540.0


def hourly_respiration(mass: Column, temp: Column, activity: Column, ra=RA, rb=RB, rq=RQ) -> Column:
    """Energy used in one hour, in joules; mass is floored at 1e-6 g."""
    m = num.maximum(mass, 1e-6)
    daily = F.lit(ra) * F.pow(m, F.lit(rb)) * F.exp(F.lit(rq) * temp) * activity
    return daily * F.lit(OXYCAL) * m / F.lit(24.0)


def update_energy(ed: Column, mass: Column, temp: Column, activity: Column, cost: Column,
                  ed_tissue=ED_TISSUE, ed_mortal=ED_MORTAL, mass_floor=MASS_FLOOR) -> Column:
    """struct(ed, mass, dead) after one hour of respiration."""
    total = ed * 1000.0 * mass
    left = F.greatest(total - hourly_respiration(mass, temp, activity) * cost, F.lit(0.0))
    new_mass = F.greatest(mass - (total - left) / F.lit(ed_tissue * 1000.0), mass * F.lit(mass_floor))
    new_ed = F.when(new_mass > 0, left / (F.greatest(new_mass, F.lit(1e-12)) * 1000.0)).otherwise(0.0)
    return F.struct(new_ed.alias("ed"), new_mass.alias("mass"), (new_ed < F.lit(ed_mortal)).alias("dead"))


def salinity_cost(sal: Column, iso=10.0, hyper=0.30, hypo=0.05) -> Column:
    """Energy multiplier, exactly 1 at the iso-osmotic point; NaN counts as that point."""
    s = F.greatest(F.least(F.when(F.isnan(sal), F.lit(float(iso))).otherwise(sal), F.lit(35.0)), F.lit(0.0))
    above = F.lit(float(hyper)) * F.greatest(s - iso, F.lit(0.0)) / F.lit(max(35.0 - iso, 1.0))
    below = F.lit(float(hypo)) * F.greatest(F.lit(float(iso)) - s, F.lit(0.0)) / F.lit(max(float(iso), 1.0))
    return F.lit(1.0) + above + below


def oxygen_state(do: Column, lethal: float, high: float) -> Column:
    """0 normal, 1 avoided, 2 lethal; NaN is normal."""
    if lethal > high:
        raise ValueError("the lethal threshold is above the avoidance threshold")
    return F.when(F.isnan(do), 0).when(do < lethal, 2).when(do < high, 1).otherwise(0)


def surge_pause(rate_per_hour: Column, threshold: float, per_quarter_hour: bool = False) -> Column:
    """|rate| above the threshold; a threshold per 15 minutes is scaled to an hour."""
    return num.gt(F.abs(rate_per_hour), threshold * (4.0 if per_quarter_hour else 1.0))


def thermal_death(temp: Column, acute: float | None = None) -> Column:
    return num.ge(temp, T_MAX if acute is None else acute)


def pick_behaviour(t3h: Column, hours_to_spawn: Column, u: Column, table,
                   temp_bins=(16.0, 18.0, 20.0), time_bins=(360.0, 720.0)) -> Column:
    """Draw a behaviour from table[time bin][temperature bin][behaviour].

    The table is a bounded parameter and travels as literal arrays of cumulative probabilities.
    """
    def bin_of(v, bounds):
        total = F.lit(0)
        for b in bounds:
            total = total + F.when(v >= F.lit(float(b)), 1).otherwise(0)
        return total
    idx = bin_of(hours_to_spawn, time_bins) * (len(temp_bins) + 1) + bin_of(t3h, temp_bins)
    return count_le_row(u, [cumulative(p)[:-1] for plane in table for p in plane], idx).cast("int")


def behaviour_overrides(behaviour: Column, steps: Column, refuge_hours: Column, since_refuge: Column,
                        max_refuge=48, avoid_for=12) -> Column:
    """First step, then too long in a refuge, then too soon back: all go upstream, in that order."""
    b = F.when(steps == 0, F.lit(UPSTREAM)).otherwise(behaviour)
    b = F.when(refuge_hours > max_refuge, F.lit(UPSTREAM)).otherwise(b)
    return F.when((b == TO_REFUGE) & (since_refuge < avoid_for), F.lit(UPSTREAM)).otherwise(b)


def estuary_overrides(behaviour: Column, alive: Column, pause: Column, oxygen: Column) -> Column:
    """struct(behavior, alive): hold on a surge, then flee low oxygen, then die of none."""
    b = F.when(alive & pause, F.lit(HOLD)).otherwise(behaviour)
    b = F.when(alive & (oxygen == 1), F.lit(DOWNSTREAM)).otherwise(b)
    return F.struct(b.alias("behavior"), (alive & (oxygen != 2)).alias("alive"))


def flag_survival(acc: Column) -> Column:
    """False (dies) below 1; NaN survives."""
    return ~num.lt(acc, 1.0)


def haldane(cm: Column) -> Column:
    """Recombination fraction at a map distance in centimorgans."""
    return F.lit(0.5) * (F.lit(1.0) - F.exp(F.lit(-2.0) * cm / F.lit(100.0)))


def haversine(lat1, lon1, lat2, lon2, radius=EARTH_RADIUS) -> Column:
    p1, p2 = num.radians(lat1), num.radians(lat2)
    dp, dl = num.radians(lat2 - lat1), num.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def metric_scale(lat: Column) -> Column:
    """struct(mx, my): metres per degree of longitude and latitude."""
    return F.struct((F.lit(M_PER_DEG_LON_EQUATOR) * F.cos(num.radians(lat))).alias("mx"),
                    F.lit(M_PER_DEG_LAT).alias("my"))


def energy_density(weight_g: Column) -> Column:
    """Joules per gram by body weight, two linear pieces."""
    return F.when(weight_g > 4000.0, F.lit(7598.0) + F.lit(0.527) * weight_g).otherwise(
        F.lit(5763.0) + F.lit(0.986) * weight_g)


# Weight- and temperature-dependent activity of the reference respiration model.
ACT, BACT, RTO, RK4 = 9.7, 0.0405, 0.0234, 0.13


def weight_respiration(weight_g: Column, temp: Column) -> Column:
    """struct(mass_loss_g, joules) of one hour, with activity rising with weight and warmth."""
    ed = energy_density(weight_g)
    activity = F.exp(F.lit(RTO * ACT) * F.pow(weight_g, F.lit(RK4)) * F.exp(F.lit(BACT) * temp))
    fraction = F.lit(RA * OXYCAL) / ed * F.pow(weight_g, F.lit(RB)) * F.exp(F.lit(RQ) * temp) * activity / F.lit(24.0)
    return F.struct((weight_g * fraction).alias("mass_loss_g"), (weight_g * fraction * ed).alias("joules"))


def daily_to_hourly(survival: Column) -> Column:
    """Hourly survival probability whose 24th power is the daily one."""
    return F.pow(survival, F.lit(1.0 / 24.0))


def affine(px: Column, py: Column, a, b, c, d, e, f) -> Column:
    """struct(x, y) of a six-parameter world-file transform."""
    return F.struct((F.lit(a) * px + F.lit(b) * py + F.lit(c)).alias("x"),
                    (F.lit(d) * px + F.lit(e) * py + F.lit(f)).alias("y"))


def seasonal_discharge(date: Column) -> Column:
    """Bell-shaped yearly discharge around day 115."""
    return F.lit(400.0) + F.lit(1500.0) * F.exp(-F.pow((F.dayofyear(date) - F.lit(115.0)) / F.lit(35.0), F.lit(2.0)))


def depth_from_elevation(z: Column) -> Column:
    return F.when(F.isnan(z), 0.0).otherwise(F.greatest(-z, F.lit(0.0)))
