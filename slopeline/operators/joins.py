"""Spatial and space-time joins, rewritten as equi-joins on grid cells with an exact condition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.geo import cell_of, haversine, km_cells, point_segment
from ..session import cut, written


def _around(cell: Column) -> Column:
    return F.explode(F.array(cell - 1, cell, cell + 1))


def _lon_cells(band: Column, dlat: float) -> Column:
    """Cells around the earth in a band of latitude, each wide enough in it and in the bands beside it."""
    far = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * dlat), F.abs((band + 2) * dlat)))
    n = F.floor(360.0 / 1.01 * F.cos(F.radians(far)) / dlat)
    return F.when(n < 30, F.lit(1)).otherwise(n).cast("long")


def _lon_cell(lon: Column, n: Column) -> Column:
    return F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("long")


def within_km(left: DataFrame, right: DataFrame, km: float, also: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of rows within ``km``, with the distance as ``km_apart``, anywhere on earth; of columns
    ``also``, which both tables have, only pairs with equal values.

    ``left`` has lat and lon, ``right`` has r_lat and r_lon (other names must differ). Cells are bands
    of latitude cut into as many parts as their width allows; near the poles a band is one cell, and
    cells go on across the date line. Each right row is sent to the cells around it, so every pair
    meets once, in the left row's cell.
    """
    dlat = km_cells(km, 0.0)[0]
    own = _lon_cells(F.col("_cy"), dlat)
    a = left.withColumn("_cy", cell_of(F.col("lat"), dlat)).withColumn("_cx", F.pmod(_lon_cell(F.col("lon"), own), own))
    bands = right.withColumn("_cy", _around(cell_of(F.col("r_lat"), dlat))).withColumn("_n", _lon_cells(F.col("_cy"), dlat))
    at = bands.withColumn("_at", _lon_cell(F.col("r_lon"), F.col("_n")))
    b = at.withColumn("_cx", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_at") + i, F.col("_n")) for i in (-1, 0, 1)])))).drop("_n", "_at")
    d = haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    return a.join(b, ["_cy", "_cx", *also]).withColumn("km_apart", d).where(F.col("km_apart") <= km).drop("_cy", "_cx")


_FINE = 4  # cells along the distance that pairs of one table may be apart


def pairs_within_km(rows: DataFrame, key: str, km: float) -> DataFrame:
    """Every pair of rows within ``km`` once, anywhere on earth: (``key``, other_id, km_apart), ``key`` < other_id.

    ``rows`` has lat and lon. As in ``within_km``, but cells are a part of the distance, so little more is compared than
    what is returned, and a row is sent only to its own band and those to the south, so that a pair does not meet twice. The
    number of pairs can grow with the square of the rows; memory does not: a row is sent to at most 45 cells, dealt over all
    tasks. What a row alone tells is computed once a row, and most pairs too far apart go by the haversine's sum of squares.
    """
    dlat = km_cells(km, 0.0)[0]
    cy = cell_of(F.col("lat"), dlat / _FINE)
    far = F.least(F.lit(90.0), F.greatest(F.abs((F.col("_cy") - _FINE) * dlat), F.abs((F.col("_cy") + _FINE + 1) * dlat)) / _FINE)
    n = F.floor(_FINE * 360.0 / 1.01 * F.cos(F.radians(far)) / dlat)
    n = F.when(n < 30 * _FINE, F.lit(1)).otherwise(n).cast("long")
    own = rows.select(key, "lat", "lon", F.cos(F.radians("lat")).alias("_cos"), cy.alias("_cy"))
    a = own.withColumn("_n", n).withColumn("_cx", F.pmod(_lon_cell(F.col("lon"), F.col("_n")), F.col("_n"))).drop("_n")
    b = own.select(F.col(key).alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("_cos").alias("_c"), F.col("_cy").alias("_y"))
    b = b.withColumn("_cy", F.explode(F.sequence(F.col("_y") - _FINE, "_y"))).withColumn("_n", n).withColumn("_at", _lon_cell(F.col("_lon"), F.col("_n")))
    b = b.withColumn("_cx", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_at") + i, F.col("_n")) for i in range(-_FINE, _FINE + 1)])))).drop("_n", "_at")
    half = lambda x, y: F.pow(F.sin(F.radians(F.col(y) - F.col(x)) / 2), F.lit(2))
    h = half("lat", "_lat") + F.col("_cos") * F.col("_c") * half("lon", "_lon")
    apart = 2 * C.EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    once = ((F.col("_cy") < F.col("_y")) & (F.col(key) != F.col("_id"))) | (F.col(key) < F.col("_id"))
    near = (h <= math.sin(min(km / C.EARTH_KM, math.pi) / 2) ** 2 * (1 + 1e-9)) & (apart <= km)
    met = _dealt(a, "_cy", "_cx").join(_dealt(b, "_cy", "_cx"), ["_cy", "_cx"]).where(once & near)
    return met.select(F.least(key, "_id").alias(key), F.greatest(key, "_id").alias("other_id"), apart.alias("km_apart"))


_FAN = 4  # cells along one side that a cell of the next level holds
_TOP = 16  # at most so many cells are on the top level
_SMALL = 50_000  # rows of a level that may be broadcast
_FULL = 64  # things in one cell, beyond which cells are made smaller


def _box() -> list[Column]:
    return [F.min("lx").alias("lx"), F.max("hx").alias("hx"), F.min("ly").alias("ly"), F.max("hy").alias("hy")]


def _levels(things: DataFrame, cell: float, slack: float = 0.0) -> tuple[float, list[DataFrame]]:
    """(size of the finest cells, their levels from fine to coarse): the occupied cells, each with the box of its things.

    ``things`` has x and y, each place once, and the box (lx, hx, ly, hy) of what stands there. Cells begin at ``cell``
    and are made smaller while one of them holds more than ``_FULL`` things; levels grow coarser until few cells are left.
    """
    if "lx" not in things.columns:
        things = things.select("x", "y", *[(F.col(c) + by).alias(f"{name}{c}") for c in "xy" for name, by in (("l", -slack), ("h", slack))])
    for _ in range(12):
        most = things.groupBy(cell_of(F.col("x"), cell), cell_of(F.col("y"), cell)).count().agg(F.max("count")).first()[0]
        if most is None or most <= _FULL:
            break
        cell /= _FAN
    level = things.groupBy(cell_of(F.col("x"), cell).alias("cx"), cell_of(F.col("y"), cell).alias("cy")).agg(*_box())
    found = [cut(level)]
    while found[-1].count() > _TOP:
        up = found[-1].groupBy(F.floor(F.col("cx") / _FAN).alias("cx"), F.floor(F.col("cy") / _FAN).alias("cy"))
        found.append(cut(up.agg(*_box())))
    return cell, found


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows over all shuffle partitions: few bytes, but much work for each of them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _gap(low: Column, high: Column, a: Column, b: Column) -> Column:
    """How far two intervals lie apart."""
    return F.greatest(F.lit(0.0), low - b, a - high)


def _candidates(points: DataFrame, things: DataFrame, cell: float, slack: float = 0.0) -> tuple[float, DataFrame]:
    """(cell size, qx, qy, cx, cy): for each occupied cell of points the cells of things that can hold the
    nearest thing of one of its points.

    Down a pyramid of occupied cells, by the boxes of what is in them: the gap between two boxes bounds what is
    nearest from below. From above, each side of a box of things is touched by one of them, so none of the points
    is farther from it than from the side's farther end. Only cells whose gap is within the best bound are opened.
    However far all things lie, those of a cell of points look alike only as far as its own box is wide. Levels
    that are small are broadcast by their counted size and opened without a shuffle. Things without boxes reach
    ``slack`` beyond their place.
    """
    cell, levels = _levels(things, cell, slack)
    asked = points.groupBy(cell_of(F.col("x"), cell).alias("qx"), cell_of(F.col("y"), cell).alias("qy"))
    asked = asked.agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"))
    query = ["qx", "qy", "ax", "bx", "ay", "by"]
    top = [[r[c] for c in ("cx", "cy", "lx", "hx", "ly", "hy")] for r in levels[-1].collect()]  # at most _TOP rows
    if not top:
        return cell, asked.select("qx", "qy", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")).limit(0)
    first = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r, ("cx", "cy", "lx", "hx", "ly", "hy"))]) for r in top])
    at = _dealt(asked, "qx", "qy").select(*query, F.inline(first))
    for depth in range(len(levels) - 1, -1, -1):
        ax, bx, ay, by, lx, hx, ly, hy = map(F.col, ("ax", "bx", "ay", "by", "lx", "hx", "ly", "hy"))
        near = F.hypot(_gap(ax, bx, lx, hx), _gap(ay, by, ly, hy))
        to = lambda side, a, b: F.greatest(F.abs(side - a), F.abs(side - b))
        wide, high = F.greatest(hx - ax, bx - lx), F.greatest(hy - ay, by - ly)
        far = F.least(F.hypot(F.least(to(lx, ax, bx), to(hx, ax, bx)), high), F.hypot(wide, F.least(to(ly, ay, by), to(hy, ay, by))))
        bound = F.min(far).over(Window.partitionBy("qx", "qy"))
        # Rounding must not lose a cell.
        kept = at.withColumns({"_near": near, "_bound": bound}).where(F.col("_near") <= (F.col("_bound") + 2 * slack) * (1 + 1e-9) + cell * 1e-9).select(*query, "cx", "cy")
        if not depth:
            return cell, kept.select("qx", "qy", "cx", "cy")
        below = levels[depth - 1].withColumns({"_cx": F.col("cx"), "_cy": F.col("cy")}).withColumns({"cx": F.floor(F.col("cx") / _FAN), "cy": F.floor(F.col("cy") / _FAN)})
        small = below.count() <= _SMALL
        at = kept.join(F.broadcast(below) if small else below, ["cx", "cy"]).drop("cx", "cy").withColumnsRenamed({"_cx": "cx", "_cy": "cy"})


def nearest(points: DataFrame, sites: DataFrame, *, key: str, site: str, cell: float) -> DataFrame:
    """(key, site, dist): the nearest site of every point in planar distance of lon and lat.

    ``points`` has (key, lon, lat), ``sites`` (site, s_lon, s_lat); ties go to the smaller site. ``cell``
    is where the size of cells begins; it does not change the result. Points or sites without a place
    have no match, and without any site there are no rows.
    """
    p = points.select(key, F.col("lon").alias("x"), F.col("lat").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    # Of sites at one place only the smallest can be told.
    s = cut(sites.where("s_lon IS NOT NULL AND s_lat IS NOT NULL").groupBy(F.col("s_lon").alias("x"), F.col("s_lat").alias("y")).agg(F.min(site).alias(site)))
    cell, cells = _candidates(p, s, cell)
    a = _dealt(p.withColumns({"qx": cell_of(F.col("x"), cell), "qy": cell_of(F.col("y"), cell)}), "qx", "qy").join(cells, ["qx", "qy"])
    b = s.select(cell_of(F.col("x"), cell).alias("cx"), cell_of(F.col("y"), cell).alias("cy"), F.col("x").alias("s_x"), F.col("y").alias("s_y"), site)
    d = F.sqrt(F.pow(F.col("x") - F.col("s_x"), F.lit(2)) + F.pow(F.col("y") - F.col("s_y"), F.lit(2)))
    best = a.join(b, ["cx", "cy"]).groupBy(key).agg(F.min(F.struct(d.alias("dist"), site)).alias("b"))
    return best.select(key, f"b.{site}", "b.dist")


def nearest_segment(points: DataFrame, segments: DataFrame, *, key: str, cell: float) -> DataFrame:
    """(key, dist): the planar distance of every point (key, x, y) to the nearest segment (ux, uy, vx, vy).

    Segments are cut into pieces of at most ``cell``, which stand at their middle: a long one is as many
    pieces as it is cells long, not the cells of its box.
    """
    whole = segments.select("ux", "uy", "vx", "vy").where("ux IS NOT NULL AND uy IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL").distinct()
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")) / cell)).cast("int")
    part = whole.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    along = lambda u, v, k: F.col(u) + (F.col(v) - F.col(u)) * (F.col("_i") + k) / F.col("_n")
    box = {f"{name}{c}": of(along(f"u{c}", f"v{c}", 0.0), along(f"u{c}", f"v{c}", 1.0)) for c in "xy" for name, of in (("l", F.least), ("h", F.greatest))}
    pieces = cut(part.select("ux", "uy", "vx", "vy", *[along(f"u{c}", f"v{c}", 0.5).alias(c) for c in "xy"], *[v.alias(k) for k, v in box.items()]))
    p = points.select(key, "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    size, cells = _candidates(p, pieces.groupBy("x", "y").agg(*_box()), cell)
    a = _dealt(p.withColumns({"qx": cell_of(F.col("x"), size), "qy": cell_of(F.col("y"), size)}), "qx", "qy").join(cells, ["qx", "qy"])
    b = pieces.select(cell_of(F.col("x"), size).alias("cx"), cell_of(F.col("y"), size).alias("cy"), "ux", "uy", "vx", "vy").distinct()
    d = point_segment(F.col("x"), F.col("y"), F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
    return a.join(b, ["cx", "cy"]).groupBy(key).agg(F.min(d).alias("dist"))


def _chord(low: Column, high: Column, cos: Column) -> Column:
    """The haversine's argument for a latitude and a longitude difference in degrees and a product of cosines."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2))
    return half(low) + cos * half(high)


def _nearest_chord(a: str, b: str) -> Column:
    """Lower bound of the haversine's argument between any points of two boxes."""
    v = {c: F.col(c) for side in (a, b) for c in (f"{side}ly", f"{side}hy", f"{side}lx", f"{side}hx")}
    wide = F.greatest(v[f"{a}hx"], v[f"{b}hx"]) - F.least(v[f"{a}lx"], v[f"{b}lx"])
    across = F.least(_gap(v[f"{a}lx"], v[f"{a}hx"], v[f"{b}lx"], v[f"{b}hx"]), F.greatest(F.lit(0.0), 360.0 - wide))
    far = F.greatest(*[F.abs(v[f"{side}{c}y"]) for side in (a, b) for c in "lh"])
    return _chord(_gap(v[f"{a}ly"], v[f"{a}hy"], v[f"{b}ly"], v[f"{b}hy"]), across, F.pow(F.cos(F.radians(far)), F.lit(2)))


def _farthest_chord(a: str, b: str) -> Column:
    """Upper bound of the haversine's argument between any points of two boxes."""
    v = {c: F.col(c) for side in (a, b) for c in (f"{side}ly", f"{side}hy", f"{side}lx", f"{side}hx")}
    high = F.greatest(v[f"{a}hy"], v[f"{b}hy"]) - F.least(v[f"{a}ly"], v[f"{b}ly"])
    wide = F.least(F.lit(180.0), F.greatest(v[f"{a}hx"], v[f"{b}hx"]) - F.least(v[f"{a}lx"], v[f"{b}lx"]))
    close = lambda side: F.when((v[f"{side}ly"] <= 0) & (v[f"{side}hy"] >= 0), 0.0).otherwise(F.least(F.abs(v[f"{side}ly"]), F.abs(v[f"{side}hy"])))
    return _chord(high, wide, F.cos(F.radians(close(a))) * F.cos(F.radians(close(b))))


_CROWD = 4.0  # pairs of things that two finest cells hold, beyond which cells are made smaller


def totals_within(left: DataFrame, right: DataFrame, km: float, *values: str) -> DataFrame:
    """(lat, lon, n, ...): for each distinct place (lat, lon) of ``left`` the number of rows of ``right`` (r_lat, r_lon)
    within ``km`` and the sums of their ``values``; places without any are absent. Anywhere on earth.

    Pairs are not formed where they need not be told apart: cells of both sides are opened from coarse to fine, by
    quarters. A cell that lies wholly within ``km`` of a whole cell of places is added as one sum, one that lies
    wholly outside is dropped, and only those on the rim are opened. In the finest cells places are compared one by one.
    """
    sums = ["n", *values]
    here, there = ["lat", "lon"], ["r_lat", "r_lon"]
    turned = lambda c: F.pmod(F.col(c) + 180.0, F.lit(360.0)) - 180.0
    asked = written(left.where("lat IS NOT NULL AND lon IS NOT NULL").select(*here).distinct().withColumns({"y": F.col("lat"), "x": turned("lon")}))
    told = right.where("r_lat IS NOT NULL AND r_lon IS NOT NULL").groupBy(*there).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values])
    told = written(told.withColumns({"y": F.col("r_lat"), "x": turned("r_lon")}))
    size = km_cells(km, 0.0)[0]

    def crowd(rows: DataFrame) -> float:
        """How many places a place shares its cell with, itself included, on average."""
        n = rows.groupBy(cell_of(F.col("y"), size), cell_of(F.col("x"), size)).count()
        return n.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0.0

    for _ in range(12):
        if crowd(asked) * crowd(told) <= _CROWD:
            break
        size /= 2

    def leaves(rows: DataFrame, side: str, kept: list[str]) -> DataFrame:
        box = [f(c).alias(f"{side}{h}{c}") for c in "yx" for h, f in (("l", F.min), ("h", F.max))]
        added = [F.sum(c).alias(c) for c in sums if c in kept]
        return written(rows.groupBy(cell_of(F.col("y"), size).alias(f"{side}y"), cell_of(F.col("x"), size).alias(f"{side}x")).agg(*box, *added, F.collect_list(F.struct(*kept)).alias(f"{side}kids")))

    def above(cells: DataFrame, side: str) -> DataFrame:
        kid = F.struct(*[c for c in cells.columns if c != f"{side}kids"]).alias("kid")
        up = cells.select(kid, F.floor(F.col(f"{side}y") / 2).alias("_y"), F.floor(F.col(f"{side}x") / 2).alias("_x")).groupBy(F.col("_y").alias(f"{side}y"), F.col("_x").alias(f"{side}x"))
        box = [f(f"kid.{side}{h}{c}").alias(f"{side}{h}{c}") for c in "yx" for h, f in (("l", F.min), ("h", F.max))]
        added = [F.sum(f"kid.{c}").alias(c) for c in sums if c in cells.columns]
        return written(up.agg(*box, *added, F.collect_list("kid").alias(f"{side}kids")))

    levels = [(leaves(asked, "q", here), leaves(told, "s", [*there, *sums]))]
    while len(levels) < 40 and any(cells.count() > _TOP for cells in levels[-1]):
        levels.append((above(levels[-1][0], "q"), above(levels[-1][1], "s")))
    most = math.sin(min(km / (2 * C.EARTH_KM), math.pi / 2)) ** 2
    cell = ["qy", "qx"]
    pairs = levels[-1][0].select(*cell).crossJoin(levels[-1][1].select("sy", "sx"))  # the coarsest cells
    whole = None
    for depth in range(len(levels) - 1, -1, -1):
        q, s = levels[depth]
        opened = _dealt(pairs, *cell).join(q.select(*cell, "qkids"), cell).join(s.select("sy", "sx", "skids"), ["sy", "sx"])
        opened = opened.select("skids", F.inline("qkids")).select("*", F.inline("skids")).drop("skids")
        if not depth:
            break
        met = opened.withColumn("_near", _nearest_chord("q", "s")).where(F.col("_near") <= most * (1 + 1e-9)).withColumn("_whole", _farthest_chord("q", "s") <= most * (1 - 1e-9))
        got = written(met.where("_whole").groupBy(*cell).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("_depth", F.lit(depth - 1)))
        whole = got if whole is None else whole.unionByName(got)
        pairs = written(met.where("NOT _whole").select(*cell, "sy", "sx"))
    rim = opened.where(haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= km).groupBy(*here).agg(*[F.sum(c).alias(c) for c in sums])
    if whole is not None:
        up = F.inline(F.array(*[F.struct(F.lit(d).alias("_depth"), F.floor(cell_of(F.col("y"), size) / 2**d).alias("qy"), F.floor(cell_of(F.col("x"), size) / 2**d).alias("qx")) for d in range(len(levels) - 1)]))
        rim = rim.unionByName(asked.select(*here, up).join(whole, ["_depth", *cell]).select(*here, *sums))
    return rim.groupBy(*here).agg(*[F.sum(c).alias(c) for c in sums])


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def _near_places(places: DataFrame, others: DataFrame, km: float) -> DataFrame:
    """(lat, lon, r_lat, r_lon, km_apart): the pairs of distinct places within ``km``.

    Rows that share a place share its pairs, so that tables which grow at the same places have no more of them.
    """
    right = others.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).distinct()
    return within_km(places.select("lat", "lon").distinct(), right, km).select("lat", "lon", "r_lat", "r_lon", "km_apart")


def nearest_places(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """(lat, lon, r_lat, r_lon, km_apart): for each distinct place (lat, lon) of ``left`` the nearest places (r_lat, r_lon)
    of ``right`` within ``km``, all of them if several are equally near. Places without one are absent.

    Small circles are searched first and only places that found nothing go on to circles twice as wide: a
    search begins where no cell is crowded, whatever ``km`` is.
    """
    sites = cut(right.select("r_lat", "r_lon").where("r_lat IS NOT NULL AND r_lon IS NOT NULL").distinct())
    rest = cut(left.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct())
    halvings = 0
    while halvings < 12:
        size = km_cells(km / 2**halvings, 0.0)[0]
        most = sites.groupBy(cell_of(F.col("r_lat"), size), cell_of(F.col("r_lon"), size)).count().agg(F.max("count")).first()[0]
        if most is None or most <= _FULL:
            break
        halvings += 1
    found = None
    for i in range(halvings, -1, -1):
        pairs = within_km(rest, sites, km / 2**i)
        best = pairs.groupBy("lat", "lon").agg(F.min("km_apart").alias("_least"))
        # Of equally near places each stays: at most as many as lie on one circle.
        got = cut(pairs.join(best, ["lat", "lon"]).where("km_apart = _least").select("lat", "lon", "r_lat", "r_lon", "km_apart"))
        found = got if found is None else found.unionByName(got)
        if i:
            rest = cut(rest.join(got.select("lat", "lon"), ["lat", "lon"], "left_anti"))
            if rest.isEmpty():
                break
    return found


def duplicates(reports: DataFrame, *, km: float = C.DEDUP_KM, hours: int = C.DEDUP_HOURS) -> DataFrame:
    """(id, duplicate_of, km_apart): the nearest earlier open report of the same category in space and time.

    Reports are not paired: two places have one distance, so of a place's open reports only the smallest id in
    the time counts. Time is cut into spans of ``hours``. The hours before a report are what its own span holds
    before it and the end of the span before; both are running minima, the second one backwards over reports
    moved on by a span.
    """
    span = hours * 3_600_000_000
    near = cut(_near_places(reports, reports.where(~F.col("status").isin(*C.CLOSED)), km))
    r = reports.where("category IS NOT NULL AND t IS NOT NULL").select("id", "category", _micros(F.col("t")).alias("_t"), "lat", "lon", F.coalesce(~F.col("status").isin(*C.CLOSED), F.lit(False)).alias("_open"))
    place = ["lat", "lon", "r_lat", "r_lon", "category", "_span"]
    asks = r.join(near, ["lat", "lon"]).select(*place[:-1], F.floor(F.col("_t") / span).alias("_span"), "_t", F.col("id").alias("_ask"), F.lit(None).cast("long").alias("_own"), F.lit(None).cast("long").alias("_last"), "km_apart")
    early = r.where("_open").select(F.col("id").alias("_r"), "category", "_t", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).join(near, ["r_lat", "r_lon"])
    at = F.floor(F.col("_t") / span)
    none = F.lit(None).cast(reports.schema["id"].dataType)
    told = lambda span_of, t, own, last: early.select(*place[:-1], span_of.alias("_span"), t.alias("_t"), none.alias("_ask"), own.alias("_own"), last.alias("_last"), "km_apart")
    asks = asks.withColumns({"_own": none, "_last": none})
    rows = asks.unionByName(told(at, F.col("_t"), F.col("_r"), none)).unionByName(told(at + 1, F.col("_t") + span, none, F.col("_r")))
    on = Window.partitionBy(*place).orderBy("_t")
    before, same = F.min("_own").over(on.rangeBetween(Window.unboundedPreceding, -1)), F.min("_own").over(on.rangeBetween(0, 0))
    ended = F.min("_last").over(Window.partitionBy(*place).orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0))
    seen = rows.withColumns({"_before": before, "_same": same}).withColumn("_ended", ended).where("_ask IS NOT NULL")
    # At one instant the smaller ids are the earlier ones.
    first = F.least("_before", "_ended", F.when(F.col("_same") < F.col("_ask"), F.col("_same")))
    best = seen.select(F.col("_ask").alias("id"), "km_apart", first.alias("r_id")).where("r_id IS NOT NULL").groupBy("id").agg(F.min(F.struct("km_apart", "r_id")).alias("b"))
    return best.select("id", F.col("b.r_id").alias("duplicate_of"), F.col("b.km_apart").alias("km_apart"))


def hotspots(reports: DataFrame, *, km: float = C.HOTSPOT_KM, days: int = C.HOTSPOT_DAYS) -> DataFrame:
    """(id, hotspot_count): earlier reports of any category nearby within some days, plus one.

    Reports are first counted by place and time, so places with many reports don't pair up: a
    place is a distinct pair of coordinates. Each count comes in at its time and goes out after the days, so
    that a running sum tells how many are within them.
    """
    place, span = ["lat", "lon"], days * 86_400_000_000
    near = cut(_near_places(reports, reports, km)).select(*place, "r_lat", "r_lon")
    instant = reports.where("t IS NOT NULL").groupBy(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), _micros(F.col("t")).alias("_t")).agg(F.count(F.lit(1)).alias("n"))
    own = (F.col("lat") == F.col("r_lat")) & (F.col("lon") == F.col("r_lon"))
    around = near.join(instant, ["r_lat", "r_lon"]).select(*place, "_t", "n", own.alias("_own")).repartition(*place)
    moved = around.select(*place, F.inline(F.array(F.struct("_t", "n", "_own"), F.struct((F.col("_t") + span).alias("_t"), (-F.col("n")).alias("n"), F.lit(False).alias("_own")))))
    before = F.sum("n").over(Window.partitionBy(*place).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1))
    counted = moved.withColumn("before", F.coalesce(before, F.lit(0))).where("_own").select(*place, "_t", "before")
    late = reports.select("id", *place, _micros(F.col("t")).alias("_t"))
    return late.join(counted, [*place, "_t"]).select("id", (F.col("before") + 1).cast("long").alias("hotspot_count"))


def outside_events(rows: DataFrame, events: DataFrame, *, km: float = C.HOLDOUT_KM, days: int = C.HOLDOUT_DAYS) -> DataFrame:
    """Rows that no event excludes: within ``km`` and ``days``, or, for events without a place, in the
    same state and within ``days``. ``rows``: id, lat, lon, t, state; ``events``: e_lat, e_lon, e_t, e_state.

    Time is cut into spans as long as an event reaches. An event of a row's own span is within reach; of the span
    before only the last one can matter, of the span behind it only the first.
    """
    seconds = lambda c: c.cast("timestamp").cast("double")
    gap = lambda a, b: F.floor(F.abs(seconds(a) - seconds(b)) / 86400) <= days
    span = lambda c: F.floor(_micros(c) / ((days + 1) * 86_400_000_000))
    ends = [F.min("e_t").alias("_first"), F.max("e_t").alias("_last")]

    def hit(asked: DataFrame, told: DataFrame, key: list[str]) -> DataFrame:
        """Of ``asked`` (key, t) those that an event of ``told`` (key, _span, _first, _last) reaches."""
        near = told.select(*key, "_first", "_last", F.explode(F.array(*[F.col("_span") + i for i in (-1, 0, 1)])).alias("_span"))
        near = near.groupBy(*key, "_span").agg(F.collect_list(F.struct("_first", "_last")).alias("_told"))  # three at most
        reached = F.exists("_told", lambda e: gap(F.col("t"), e["_first"]) | gap(F.col("t"), e["_last"]))
        return asked.withColumn("_span", span(F.col("t"))).join(near, [*key, "_span"]).where(reached).select("id")

    placed = events.where("e_lat is not null and e_lon is not null").select(F.col("e_lat").alias("lat"), F.col("e_lon").alias("lon"), "e_t")
    per_place = placed.groupBy(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), span(F.col("e_t")).alias("_span")).agg(*ends)
    told = _near_places(rows.where("lat is not null and lon is not null"), placed, km).join(per_place, ["r_lat", "r_lon"])
    told = told.groupBy("lat", "lon", "_span").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    by_place = hit(rows.select("id", "lat", "lon", "t"), told, ["lat", "lon"])
    vague = events.where("e_lat is null or e_lon is null").groupBy(F.col("e_state").alias("state"), span(F.col("e_t")).alias("_span")).agg(*ends)
    by_state = hit(rows.select("id", "state", "t"), vague, ["state"])
    return rows.join(by_place.unionByName(by_state).distinct(), "id", "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and of ``stored`` those whose key ``new`` lacks."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
