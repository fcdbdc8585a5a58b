"""Column functions of rainfall risk, impact and decisions. No I/O, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def id_threshold(hours: Column) -> Column:
    """Intensity (mm/h) that rain of this duration needs to start slides."""
    return C.ID_COEFFICIENT * F.pow(hours, F.lit(C.ID_EXPONENT))


def ed_threshold(hours: Column) -> Column:
    """Event depth (mm) for durations strictly between one and sixty days, else null."""
    return F.when((hours > C.ED_MIN_HOURS) & (hours < C.ED_MAX_HOURS), C.ED_OFFSET + C.ED_SLOPE * hours)


def exceedance_ratio(rain: dict[int, Column]) -> Column:
    """The worst ratio of rain to threshold over accumulation windows (hours to depth)."""
    ratios = [mm / hours / id_threshold(F.lit(float(hours))) for hours, mm in rain.items()]
    ratios += [mm / ed_threshold(F.lit(float(hours))) for hours, mm in rain.items() if C.ED_MIN_HOURS < hours < C.ED_MAX_HOURS]
    return F.greatest(*ratios)


def fuse(model_p: Column, exceedance: Column) -> Column:
    return F.greatest(model_p, clamp01(exceedance))


def entropy_confidence(p: Column) -> Column:
    """One minus the binary entropy of p in bits."""
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return 1.0 + q * F.log2(q) + (1.0 - q) * F.log2(1.0 - q)


def stage(p: Column) -> Column:
    return F.when(p >= C.RED, "RED").when(p >= C.ORANGE, "ORANGE").when(p >= C.YELLOW, "YELLOW").otherwise("GREEN")


def level_label(p: Column) -> Column:
    return F.when(p >= C.RED, "VERY HIGH").when(p >= C.ORANGE, "HIGH").when(p >= C.YELLOW, "MODERATE").otherwise("LOW")


def runout_triangle(x: Column, y: Column, aspect: Column, relief: Column, p: Column, reach_deg: float = C.REACH_ANGLE_DEG, spread_deg: float = C.SPREAD_HALF_ANGLE_DEG) -> Column:
    """Apex and two far corners of a slide's reach; null where nothing runs out."""
    length = relief / F.tan(F.radians(F.lit(reach_deg)))
    half = length * F.tan(F.radians(F.lit(spread_deg)))
    bearing = F.radians(aspect)
    ux, uy = F.sin(bearing), F.cos(bearing)
    tip_x, tip_y = x + length * ux, y + length * uy
    found = F.struct(
        x.alias("ax"), y.alias("ay"), (tip_x + half * uy).alias("lx"), (tip_y - half * ux).alias("ly"), (tip_x - half * uy).alias("rx"), (tip_y + half * ux).alias("ry")
    )
    return F.when((p >= C.RUNOUT_P_FAIL) & aspect.isNotNull() & (relief > 0), found)


def shelter_access(isolated: Column, distance_km: Column) -> Column:
    near = clamp01(1.0 - distance_km / C.EPS_SHELTER_REF_KM)
    return F.when(isolated | distance_km.isNull(), 0.0).otherwise(near)


def eps_score(p: Column, population: Column, isolation: Column, access: Column) -> Column:
    return C.EPS_P * p + C.EPS_POP * F.least(population / C.EPS_POP_REF, F.lit(1.0)) + C.EPS_RII * isolation + C.EPS_SHELTER * (1.0 - access)


def eps_tier(eps: Column) -> Column:
    return F.when(eps >= C.EPS_P1, "P1").when(eps >= C.EPS_P2, "P2").otherwise("P3")


def demographics(population: Column) -> dict[str, Column]:
    """Shares of a population, rounded half to even."""
    children, elderly = F.bround(population * 0.30), F.bround(population * 0.08)
    whole = lambda c: c.cast("long")
    return {"children": whole(children), "elderly": whole(elderly), "adults": whole(population - children - elderly), "assisted": whole(F.bround(population / 4.8 * 0.05))}


def walk_minutes(metres: Column) -> Column:
    return F.when(metres <= 0, 0).otherwise(F.bround(metres / 1000.0 / C.WALK_KMH * 60.0)).cast("long")


def urgency(severity: Column, relevance: Column, quality: Column, hotspots: Column, p: Column, duplicate: Column) -> Column:
    score = severity * 10 + F.bround(relevance * 12) + F.bround(quality * 8) + F.least(F.lit(15), F.greatest(F.lit(0), hotspots - 1) * 3)
    score = score + F.coalesce(F.bround(p * 20), F.lit(0)) - F.when(duplicate, 8).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")


def image_quality(n_bytes: Column, width: Column, height: Column) -> Column:
    """Evidence quality of a photo: points for size and resolution, at most 1; unknown sides earn none."""
    # Fixed values: (least, points) in bytes, on the shorter side, on the longer side.
    score = F.lit(0.15)
    for least, points in ((20_000, 0.2), (100_000, 0.15)):
        score = score + F.when(n_bytes >= least, points).otherwise(0.0)
    short, long = F.least(width, height), F.greatest(width, height)
    sides = F.when(short >= 480, 0.25).when(short >= 320, 0.12).otherwise(0.0)
    for least, points in ((640, 0.15), (960, 0.25)):
        sides = sides + F.when(long >= least, points).otherwise(0.0)
    known = (width > 0) & (height > 0)
    return F.round(F.least(F.lit(1.0), score + F.when(known, sides).otherwise(0.0)), 3)


def uniform_storm(depth_mm: Column, hours: Column, window_hours: int) -> Column:
    """Depth that a storm of even intensity leaves in a window."""
    return depth_mm / hours * F.least(F.lit(float(window_hours)), hours)


def clearance_hours(road_class: Column, is_bridge: Column, p: Column) -> Column:
    base = F.lit(C.CLEARANCE_DEFAULT_HOURS)
    for name, hours in C.CLEARANCE_HOURS.items():
        base = F.when(road_class == name, hours).otherwise(base)
    return base * F.when(is_bridge, C.BRIDGE_CLEARANCE_FACTOR).otherwise(1.0) * (1.0 + p)


def twi(accumulation: Column, pixel_m: Column, slope_deg: Column) -> Column:
    """Topographic wetness index; slopes below 0.1 degree count as that."""
    return F.ln(accumulation * pixel_m / F.tan(F.radians(F.greatest(slope_deg, F.lit(0.1)))))


def compass(aspect: Column) -> Column:
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(names, (F.floor((F.pmod(aspect, F.lit(360.0)) + 22.5) / 45.0) % 8 + 1).cast("int"))
