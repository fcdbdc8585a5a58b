"""Feeds, map elements and grids as DataFrames: granules, agency envelopes, exposure, roads, cells.

Downloads are left to the cluster's landing jobs; what lands (long-form granules, JSON text, element
rows) is read from tables here. Constants that must match are marked as fixed values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import inside
from ..operators import joins as J
from ..session import cut

Box = tuple[float, float, float, float]

#: The schema that every source of observations returns, ordered by t.
OBSERVATION = """t timestamp, aoi_id string, cell_id string, rain_1h double, rain_6h double, rain_24h double, rain_72h double, antecedent_7d double,
    antecedent_15d double, antecedent_30d double, soil_moisture double, source string, is_reconstructed boolean"""

# Fill values, minutes of a granule, and the flag bit of a recommended retrieval.
FILL, GRANULE_MINUTES, RECOMMENDED_BIT = -9999.9, 30, 1
SMAP_FILL = -9999.0


def rain_granule(rows: DataFrame, box: Box) -> DataFrame:
    """(ts, pixel_id, lon, lat, precip_mm): depth of a half hour per pixel in a box.

    ``rows``: ts, lon, lat, rate_mm_hr. Fill values go; depths below zero count as zero.
    """
    depth = F.greatest(F.col("rate_mm_hr") * (GRANULE_MINUTES / 60.0), F.lit(0.0))
    near = rows.where(inside(F.col("lon"), F.col("lat"), box) & (F.col("rate_mm_hr") != FILL))
    return near.select("ts", F.format_string("%.2f_%.2f", "lon", "lat").alias("pixel_id"), "lon", "lat", depth.alias("precip_mm"))


def soil_granule(rows: DataFrame, box: Box) -> DataFrame:
    """(date, pass_name, pixel_id, lon, lat, soil_moisture, recommended): both passes' readings in a box.

    ``rows``: date, pass_name, row, col, lon, lat, soil_moisture, qual_flag. Readings of lower quality stay.
    """
    known = (F.col("soil_moisture") != SMAP_FILL) & (F.col("lat") != SMAP_FILL) & (F.col("lon") != SMAP_FILL)
    pixel = F.concat_ws("_", F.lit("ease"), F.col("row").cast("string"), F.col("col").cast("string"))
    out = rows.where(known & inside(F.col("lon"), F.col("lat"), box) & F.col("pass_name").isin("AM", "PM"))
    return out.select("date", "pass_name", pixel.alias("pixel_id"), "lon", "lat", "soil_moisture", (F.col("qual_flag").bitwiseAND(RECOMMENDED_BIT) == 0).alias("recommended"))


def both_passes(morning: DataFrame, evening: DataFrame) -> DataFrame:
    """Readings of the two passes in one table."""
    return morning.withColumn("pass_name", F.lit("AM")).unionByName(evening.withColumn("pass_name", F.lit("PM")))


def best_readings(readings: DataFrame) -> DataFrame:
    """One reading per pixel: recommended ones first, then the morning's; ties to the lower moisture."""
    order = F.struct((~F.col("recommended")).alias("poor"), (F.col("pass_name") != "AM").alias("late"), F.col("soil_moisture"))
    return readings.groupBy("pixel_id").agg(F.min_by(F.struct("soil_moisture", "pass_name", "recommended"), order).alias("b")).select("pixel_id", "b.*")


def cells_to_pixels(cells: DataFrame, pixels: DataFrame, degrees: float = 0.1) -> DataFrame:
    """(cell_id, pixel_id): the nearest pixel of every cell in degrees; ties to the smaller name.

    ``cells``: cell_id, lon, lat; ``pixels``: pixel_id, lon, lat. Without pixels it fails.
    """
    if pixels.isEmpty():
        raise ValueError("no pixels to map cells onto")
    near = pixels.select("pixel_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    return J.nearest(cells, near, key="cell_id", site="pixel_id", cell=degrees).select("cell_id", "pixel_id")


_RAIN = ("rain_1h", "rain_6h", "rain_24h", "rain_72h", "antecedent_7d", "antecedent_15d", "antecedent_30d")


def rain_observations(cells: DataFrame, features: DataFrame, source: str = "imerg") -> DataFrame:
    """Every mapped cell (cell_id, pixel_id) with its pixel's trailing sums; pixels without rain count 0."""
    out = cells.join(features.select("pixel_id", *_RAIN), "pixel_id", "left")
    return out.select("cell_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _RAIN], F.lit(None).cast("double").alias("soil_moisture"), F.lit(source).alias("source"), F.lit(False).alias("is_reconstructed"))


def soil_observations(cells: DataFrame, latest: DataFrame, source: str = "smap") -> DataFrame:
    """Every mapped cell with its pixel's latest soil moisture (null without one) and no rain."""
    out = cells.join(latest.select("pixel_id", "soil_moisture"), "pixel_id", "left")
    return out.select("cell_id", *[F.lit(0.0).alias(c) for c in _RAIN], "soil_moisture", F.lit(source).alias("source"), F.lit(False).alias("is_reconstructed"))


def latest_available(days: DataFrame, now: Column, lookback: int = 5) -> DataFrame:
    """(day): the newest catalogued day from ``now`` back to ``lookback`` days before; null if none."""
    return days.where(F.col("day").between(F.date_sub(now, lookback), F.to_date(now))).agg(F.max("day").alias("day"))


def search_url(base: str, short_name: str, version: str, day: Column, box: Box) -> Column:
    """The catalogue query of a day's granules over a box."""
    span = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z,"), F.date_format(day, "yyyy-MM-dd"), F.lit("T23:59:59Z"))
    pairs = [("short_name", F.lit(short_name)), ("version", F.lit(version)), ("temporal", span), ("bounding_box", F.lit(",".join(map(str, box)))), ("page_size", F.lit("5"))]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in pairs]))


def data_link(found: Column) -> Column:
    """The first link of a catalogue answer (JSON) that leads to data in HDF5; null if none."""
    entries = F.from_json(found, "feed struct<entry:array<struct<links:array<struct<rel:string,href:string>>>>>")["feed"]["entry"]
    links = F.flatten(F.transform(entries, lambda e: F.coalesce(e["links"], F.array().cast("array<struct<rel:string,href:string>>"))))
    return F.try_element_at(F.filter(links, lambda x: F.endswith(x["rel"], F.lit("/data#")) & F.endswith(x["href"], F.lit(".h5"))), F.lit(1))["href"]


def feed_records(payload: Column) -> Column:
    """Records (JSON texts) of an agency's answer: a list, {data: list}, {data: record} or a bare record; else an error."""
    text = F.trim(payload)
    data = F.get_json_object(text, "$.data")
    bare = F.arrays_overlap(F.json_object_keys(text), F.array(*map(F.lit, ("Station", "District", "Obj_id"))))
    many = lambda c: F.from_json(c, "array<string>")
    known = F.when(F.startswith(text, F.lit("[")), many(text)).when(F.startswith(data, F.lit("[")), many(data)).when(F.startswith(data, F.lit("{")), F.array(data)).when(bare, F.array(text))
    return known.otherwise(F.raise_error(F.lit("unrecognised envelope of records")).cast("array<string>"))


def district_record(records: Column, field: str, district: Column, required: tuple[str, ...]) -> Column:
    """The first record of a district by a field, whatever its case; null if none, an error if it lacks a required field."""
    target = F.lower(F.trim(district))
    found = F.try_element_at(F.filter(records, lambda r: F.lower(F.trim(F.coalesce(F.get_json_object(r, f"$.{field}"), F.lit("")))) == target), F.lit(1))
    lacks = F.size(F.array_except(F.array(*map(F.lit, required)), F.json_object_keys(found))) > 0
    return F.when(found.isNotNull() & lacks, F.raise_error(F.lit("a record lacks expected fields")).cast("string")).otherwise(found)


def _corner(value: Column, step: int, width: int, names: tuple[str, str]) -> Column:
    low = (F.floor(value / step) * step).cast("int")
    return F.when(low >= 0, F.format_string(f"{names[0]}%0{width}d", low)).otherwise(F.format_string(f"{names[1]}%0{width}d", -low))


def cover_tile(lat: Column, lon: Column) -> Column:
    """Name of the land-cover tile of 3 degrees that holds a point, by its south-west corner."""
    return F.concat(F.lit("ESA_WorldCover_10m_2021_v200_"), _corner(lat, 3, 2, ("N", "S")), _corner(lon, 3, 3, ("E", "W")), F.lit("_Map.tif"))


def height_tile(lat: Column, lon: Column) -> Column:
    """Path of the elevation tile of one degree that holds a point."""
    name = F.concat(F.lit("Copernicus_DSM_COG_10_"), _corner(lat, 1, 2, ("N", "S")), F.lit("_00_"), _corner(lon, 1, 3, ("E", "W")), F.lit("_00_DEM"))
    return F.concat(name, F.lit("/"), name, F.lit(".tif"))


def safe_int(text: Column) -> Column:
    """A whole number that may have thousands separators; null if it is none."""
    return F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("long")


ELEMENT = "type string, id long, lon double, lat double, center struct<lon:double,lat:double>, coords array<struct<lon:double,lat:double>>, tags map<string,string>"


def exposure(elements: DataFrame, kind: str, box: Box, amenity: str = ".*") -> DataFrame:
    """(osm_id, name, lon, lat, place_type, amenity, population) of map elements of a kind in a box.

    ``elements`` follow ``ELEMENT``. Villages are nodes placed as village or hamlet; amenities match a
    pattern from their start; bridges are marked as such. A way lies at the mean of its points.
    """
    mean = lambda f: F.aggregate("coords", F.lit(0.0), lambda a, c: a + c[f]) / F.size("coords")
    at = lambda f: F.coalesce(F.when(F.col("type") == "node", F.col(f)), F.col(f"center.{f}"), F.when(F.size("coords") > 0, mean(f)))
    tag = lambda k: F.col("tags")[k]
    wanted = {
        "villages": (F.col("type") == "node") & tag("place").isin("village", "hamlet"),
        "amenity": (F.length(tag("amenity")) > 0) & tag("amenity").rlike(f"^(?:{amenity})"),
        "bridges": tag("man_made") == "bridge",
    }
    if kind not in wanted:
        raise ValueError(f"unknown kind: {kind}")
    out = elements.where(wanted[kind]).select(
        F.col("id").alias("osm_id"), F.coalesce(tag("name"), F.lit("unnamed")).alias("name"), at("lon").alias("lon"), at("lat").alias("lat"), tag("place").alias("place_type"), tag("amenity").alias("amenity"), safe_int(tag("population")).alias("population")
    )
    return out.where(inside(F.col("lon"), F.col("lat"), box))


def exposure_layer(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows of an exposure layer with ids such as v_17; names that are empty count as missing."""
    return rows.withColumn("id", F.concat(F.lit(prefix), F.col("osm_id").cast("string"))).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("unnamed")))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the analysis grid with ``has_terrain``: only cells with slope and elevation are scored."""
    rows = spark.read.parquet(path)
    return rows.withColumn("has_terrain", F.col("slope_mean_deg").isNotNull() & F.col("elevation_m").isNotNull())


def has_terrain(rows: DataFrame, slope: str = "slope_mean_deg", elevation: str = "elevation_m") -> DataFrame:
    return rows.where(F.col(slope).isNotNull() & F.col(elevation).isNotNull())


def road_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (u, v, edge_id, highway_class, is_bridge, geometry) with defaults filled in; without a geometry
    a straight line between the end nodes (node, x, y). Edges whose nodes are unknown go."""
    u = nodes.select(F.col("node").alias("u"), F.struct("x", "y").alias("_u"))
    v = nodes.select(F.col("node").alias("v"), F.struct("x", "y").alias("_v"))
    line = F.coalesce("geometry", F.array("_u", "_v"))
    out = edges.join(u, "u").join(v, "v")
    return out.withColumns({"geometry": line, "highway_class": F.coalesce("highway_class", F.lit("unclassified")), "is_bridge": F.coalesce("is_bridge", F.lit(False))}).drop("_u", "_v")


def tagged_edges(edges: DataFrame) -> DataFrame:
    """(u, v, key, edge_id, highway_class, is_bridge, classes) of raw map edges whose tags are arrays:
    the first class counts; any bridge tag that is neither missing nor "no" makes a bridge."""
    bridge = F.exists(F.coalesce("bridge", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "no"))
    return edges.select("u", "v", "key", F.concat_ws("_", "u", "v", "key").alias("edge_id"), F.try_element_at("highway", F.lit(1)).alias("highway_class"), bridge.alias("is_bridge"), F.col("highway").alias("classes"))


# Ways that no vehicle drives.
UNROUTABLE = ("bridleway", "construction", "corridor", "cycleway", "footway", "path", "pedestrian", "proposed", "raceway", "steps", "track")


def drivable(edges: DataFrame, excluded: tuple[str, ...] = UNROUTABLE) -> DataFrame:
    """Edges with a class (column classes) outside the excluded set; edges without any class go."""
    return edges.where(F.size(F.array_except(F.coalesce("classes", F.array().cast("array<string>")), F.array(*map(F.lit, excluded)))) > 0)


def without_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_semi")


def map_tiles(spark: SparkSession, box: Box, divisions: int = 3) -> DataFrame:
    """(label, west, south, east, north): a box cut into divisions x divisions tiles."""
    dx, dy = (box[2] - box[0]) / divisions, (box[3] - box[1]) / divisions
    grid = spark.range(divisions).select(F.col("id").alias("r")).join(spark.range(divisions).select(F.col("id").alias("c")), how="cross")
    at = lambda low, i, d: low + F.col(i) * d
    return grid.select(F.concat_ws("-", "r", "c").alias("label"), at(box[0], "c", dx).alias("west"), at(box[1], "r", dy).alias("south"), (at(box[0], "c", dx) + dx).alias("east"), (at(box[1], "r", dy) + dy).alias("north"))


def tile_tree(points: DataFrame, box: Box, *, most: Column | float, divisions: int = 3, depth: int = 3) -> DataFrame:
    """(label, n): points (lon, lat) by tile, where tiles of more than ``most`` points are quartered again and
    again, at most ``depth`` times. Points outside the box and tiles without points are left out.

    Every point is counted once, under the name of its smallest possible tile; there are at most
    divisions**2 * 4**depth of them, and from their counts it is told level by level which tiles are
    split. No point meets a tile in a join. ``most`` may be a column of one row's aggregates over n.
    """
    west, south, east, north = box
    step_x, step_y = (east - west) / divisions, (north - south) / divisions
    at = points.where((F.col("lon") >= west) & (F.col("lon") < east) & (F.col("lat") >= south) & (F.col("lat") < north)).select("lon", "lat")
    edge = lambda c, start, step: sum(((F.col(c) >= start + i * step).cast("int") for i in range(1, divisions)), F.lit(0))
    at = at.withColumns({"_c": edge("lon", west, step_x), "_r": edge("lat", south, step_y)})
    at = at.withColumns({"_w": west + F.col("_c") * step_x, "_s": south + F.col("_r") * step_y}).withColumns({"_e": F.col("_w") + step_x, "_n": F.col("_s") + step_y, "_0": F.concat_ws("-", "_r", "_c")})
    for i in range(1, depth + 1):
        x, y = (F.col("_w") + F.col("_e")) / 2, (F.col("_s") + F.col("_n")) / 2
        right, upper = F.col("lon") >= x, F.col("lat") >= y
        at = at.withColumns({
            "_w": F.when(right, x).otherwise(F.col("_w")), "_e": F.when(right, F.col("_e")).otherwise(x), "_s": F.when(upper, y).otherwise(F.col("_s")), "_n": F.when(upper, F.col("_n")).otherwise(y),
            f"_{i}": F.concat_ws("-", f"_{i - 1}", right.cast("int") + 2 * upper.cast("int")),
        })
    names = [f"_{i}" for i in range(depth + 1)]
    counts = at.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    # From here on there are at most divisions**2 * 4**depth rows.
    held = {f"{name}n": F.sum("n").over(Window.partitionBy(name)) for name in names}
    limit = most if isinstance(most, Column) else F.lit(float(most))
    leaf = F.col(names[-1])
    for name in reversed(names[:-1]):
        leaf = F.when(F.col(f"{name}n") <= F.col("_most"), F.col(name)).otherwise(leaf)
    counts = counts.withColumns(held)
    bound = counts.agg(limit.alias("_most"))
    return counts.join(F.broadcast(bound)).groupBy(leaf.alias("label")).agg(F.sum("n").alias("n"))


def split_tiles(tiles: DataFrame) -> DataFrame:
    """The four quarters of each tile, for those a server refuses as too dense."""
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    part = lambda i, w, s, e, n: F.struct(F.concat(F.col("label"), F.lit(f"-{i}")).alias("label"), w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    w, s, e, n = (F.col(k) for k in ("west", "south", "east", "north"))
    return tiles.select(F.explode(F.array(part(0, w, s, x, y), part(1, x, s, e, y), part(2, w, y, x, n), part(3, x, y, e, n))).alias("t")).select("t.*")


def compose(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several map exports, each key once; of different rows of a key any may stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(key)


def make_grid(spark: SparkSession, aoi_id: str, bounds: Box, size: float = 500.0) -> DataFrame:
    """(cell_id, row, col, x0, y0, x1, y1): squares that cover projected bounds."""
    n_col, n_row = math.ceil((bounds[2] - bounds[0]) / size), math.ceil((bounds[3] - bounds[1]) / size)
    c, r = F.col("id") % n_col, F.floor(F.col("id") / n_col)
    out = spark.range(n_col * n_row).select(r.cast("long").alias("row"), c.alias("col"))
    x0, y0 = bounds[0] + F.col("col") * size, bounds[1] + F.col("row") * size
    return out.select(F.format_string(f"{aoi_id}_%03d_%03d", "row", "col").alias("cell_id"), "row", "col", x0.alias("x0"), y0.alias("y0"), (x0 + size).alias("x1"), (y0 + size).alias("y1"))


def grid_label(x: Column, y: Column, bounds: Box, size: float = 500.0) -> Column:
    """Number of the grid cell that holds a projected point, -1 outside."""
    n_col, n_row = math.ceil((bounds[2] - bounds[0]) / size), math.ceil((bounds[3] - bounds[1]) / size)
    c, r = F.floor((x - bounds[0]) / size), F.floor((y - bounds[1]) / size)
    return F.when((c >= 0) & (c < n_col) & (r >= 0) & (r < n_row), r * n_col + c).otherwise(-1).cast("long")


# Neighbours of a pixel in the order in which equal drops are taken.
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def flow_accumulation(pixels: DataFrame) -> DataFrame:
    """(row, col, accumulation): pixels that drain through each, itself included, along steepest descent.

    ``pixels``: row, col, elevation (null: no data). Every pixel points to the neighbour with the
    largest drop per distance. Counts double their reach each round: a pixel adds the count of all
    whose pointer of 2**k steps ends in it, so rounds are logarithmic in the longest way.
    """
    valid = pixels.where("elevation is not null").select("row", "col", "elevation")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(math.sqrt(2.0) if r and c else 1.0).alias("far")) for i, (r, c) in enumerate(NEIGHBOURS)])
    asked = valid.select("row", "col", F.col("elevation").alias("high"), F.explode(steps).alias("s")).select("row", "col", "high", "s.i", "s.far", (F.col("row") + F.col("s.dr")).alias("to_row"), (F.col("col") + F.col("s.dc")).alias("to_col"))
    near = valid.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), "elevation")
    drop = (F.col("high") - F.col("elevation")) / F.col("far")
    met = asked.join(near, ["to_row", "to_col"]).withColumn("drop", drop).where("drop > 0")
    down = met.groupBy("row", "col").agg(F.min_by(F.struct("to_row", "to_col"), F.struct(-F.col("drop"), F.col("i"))).alias("to"))
    state = cut(valid.select("row", "col").join(down, ["row", "col"], "left").select("row", "col", "to", F.lit(1).cast("long").alias("n")))
    while not state.where("to is not null").isEmpty():
        given = state.where("to is not null").groupBy(F.col("to.to_row").alias("row"), F.col("to.to_col").alias("col")).agg(F.sum("n").alias("got"))
        jump = state.select(F.struct(F.col("row").alias("to_row"), F.col("col").alias("to_col")).alias("to"), F.col("to").alias("next"))
        moved = state.join(jump, "to", "left").join(given, ["row", "col"], "left")
        state = cut(moved.select("row", "col", F.col("next").alias("to"), (F.col("n") + F.coalesce("got", F.lit(0))).alias("n")))
    return state.select("row", "col", F.col("n").alias("accumulation"))


def utm_to_lonlat(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude of UTM coordinates, by the series of the transverse Mercator projection
    in the third flattening (millimetres within a zone)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
    xi, eta = (y - (0.0 if north else 1e7)) / (0.9996 * a), (x - 500000.0) / (0.9996 * a)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


# The states of the inventory and its columns.
NER_STATES = ("Assam", "Arunachal Pradesh", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Sikkim", "Tripura")
INVENTORY = (
    "objectid", "event_id", "event_date_ms", "event_dt", "event_title", "location_description", "landslide_category", "landslide_trigger", "landslide_size", "landslide_setting",
    "fatality_count", "injury_count", "latitude", "longitude", "location_accuracy", "country_code", "admin_division_name", "event_import_source",
)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; columns are text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def regional_events(raw: DataFrame, country: str = "IN", states: tuple[str, ...] = NER_STATES) -> DataFrame:
    """Events of a country's states that have coordinates."""
    return raw.where((F.col("country_code") == country) & F.col("admin_division_name").isin(*states) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def clean_events(events: DataFrame) -> DataFrame:
    """The inventory's columns by time, events without a readable date last."""
    at = F.timestamp_millis(F.col("event_date").try_cast("long"))
    return events.withColumn("event_dt", at).withColumnRenamed("event_date", "event_date_ms").select(*INVENTORY).orderBy(F.asc_nulls_last("event_dt"))


def funnel(raw: DataFrame, box: Box, trusted: tuple[str, ...], country: str = "IN", states: tuple[str, ...] = NER_STATES) -> DataFrame:
    """(raw_rows, country_rows, state_rows, box_rows, trusted_rows): what each filter leaves, in one pass."""
    here = F.col("country_code") == country
    state = here & F.col("admin_division_name").isin(*states) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    boxed = state & inside(F.col("longitude"), F.col("latitude"), box)
    return raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(here).alias("country_rows"), F.count_if(state).alias("state_rows"), F.count_if(boxed).alias("box_rows"), F.count_if(boxed & F.col("location_accuracy").isin(*trusted)).alias("trusted_rows"))


def in_holdout(cells: DataFrame, events: DataFrame, km: float) -> DataFrame:
    """Cells (cell_id, lat, lon) with ``in_holdout``: whether a held-out event with a place (e_lat, e_lon) lies within ``km``."""
    placed = events.where("e_lat is not null and e_lon is not null").select(F.col("e_lat").alias("r_lat"), F.col("e_lon").alias("r_lon"))
    hit = J.nearest_places(cells, placed, km).select("lat", "lon").distinct().withColumn("in_holdout", F.lit(True))
    return cells.join(hit, ["lat", "lon"], "left").select(*cells.columns, F.coalesce("in_holdout", F.lit(False)).alias("in_holdout"))


def buffered_density(places: DataFrame, pixels: DataFrame, km: float) -> DataFrame:
    """(place_id, value): the mean of the pixels (lat, lon, value) within ``km`` of each place times the circle's area
    in square kilometres; 0 without pixels."""
    near = pixels.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("value").alias("r_value")).where("r_value IS NOT NULL")
    found = J.totals_within(places, near, km, "r_value").select("lat", "lon", (F.col("r_value") / F.col("n")).alias("mean"))
    return places.select("place_id", "lat", "lon").join(found, ["lat", "lon"], "left").select("place_id", (F.coalesce("mean", F.lit(0.0)) * math.pi * km * km).alias("value"))
