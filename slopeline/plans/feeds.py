"""Feeds, exposure, roads and grids over the driver's tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wkb as W
from ..session import shared_dir
from ..sources import feeds as X
from ..sources import geometry as Y
from ..sources import tables as T
from .risk import _FEATURES, _features

BOX = (92.62, 23.62, 92.8, 23.8)


def rain_granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour depths per pixel from events as granule rows with fill values, inside a box."""
    e = T.table(spark, sf_dir, "events")
    rate = F.when(F.col("event_id") % 13 == 0, X.FILL).otherwise(F.col("value") - 20)
    rows = e.select("ts", (92.6 + F.col("user_id") % 30 / 100).alias("lon"), (23.6 + F.col("user_id") % 23 / 100).alias("lat"), rate.alias("rate_mm_hr"))
    return X.rain_granule(rows, BOX).groupBy("pixel_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("precip_mm"), 4).alias("mm"), F.min("precip_mm").alias("least"))


def _soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    k = F.col("user_id")
    moisture = F.when(F.col("event_id") % 17 == 0, X.SMAP_FILL).otherwise(F.col("event_id") % 50 / 100)
    return e.select(
        F.to_date("ts").alias("date"), F.when(F.hour("ts") < 12, "AM").otherwise("PM").alias("pass_name"), (k % 40).alias("row"), (k % 7).alias("col"), (92.6 + k % 30 / 100).alias("lon"), (23.6 + k % 23 / 100).alias("lat"),
        moisture.alias("soil_moisture"), (F.col("event_id") % 4).cast("int").alias("qual_flag"),
    )


def soil_granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best soil reading per pixel of both passes."""
    rows = _soil(spark, sf_dir)
    one = lambda p: X.soil_granule(rows.where(F.col("pass_name") == p), BOX)
    return X.best_readings(X.both_passes(one("AM"), one("PM")))


def live_rain_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every terrain cell with the trailing sums of its pixel; cells without rain have 0."""
    cells = T.terrain(spark, sf_dir).select("cell_id", (F.col("cell_id") % 400).cast("string").alias("pixel_id"))
    out = X.rain_observations(cells, _features(spark, sf_dir))
    return out.select("cell_id", F.round("rain_72h", 6).alias("rain_72h"), F.round("antecedent_30d", 6).alias("antecedent_30d"), "source", "is_reconstructed")


def live_soil_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every terrain cell with the best soil reading of its pixel, null without one."""
    cells = T.terrain(spark, sf_dir).select("cell_id", F.concat_ws("_", F.lit("ease"), (F.col("cell_id") % 45).cast("string"), (F.col("cell_id") % 7).cast("string")).alias("pixel_id"))
    return X.soil_observations(cells, soil_granules(spark, sf_dir)).select("cell_id", "soil_moisture", "rain_1h", "source")


def cells_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a few pixels of every village."""
    v = T.villages(spark, sf_dir).select(F.col("village_id").alias("cell_id"), "lon", "lat")
    return X.cells_to_pixels(v, T.sites(spark, sf_dir).where("site_id % 3 = 0").select(F.col("site_id").alias("pixel_id"), "lon", "lat"))


def latest_granule_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day with an order of a kind, looking back five days from a date."""
    days = T.table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.to_date("o_orderdate").alias("day"))
    return X.latest_available(days, F.to_date(F.lit("1996-07-15"))).select(F.col("day").cast("string").alias("day"))


def catalogue_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order a catalogue answer with a link per line: its query and the first link to data."""
    kind = F.element_at(F.array(*map(F.lit, ("metadata#", "data#", "browse#"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    link = F.struct("l_linenumber", F.concat(F.lit("http://rel/"), kind).alias("rel"), F.concat(F.lit("http://g/"), "l_orderkey", F.lit("-"), "l_linenumber", F.when(F.col("l_suppkey") % 2 == 0, ".h5").otherwise(".xml")).alias("href"))
    o = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(link)).alias("links"), F.max(F.to_date("l_shipdate")).alias("day"))
    entries = F.transform("links", lambda x: F.struct(F.array(F.struct(x["rel"].alias("rel"), x["href"].alias("href"))).alias("links")))
    js = o.select("l_orderkey", "day", F.to_json(F.struct(F.struct(entries.alias("entry")).alias("feed"))).alias("js"))
    return js.select("l_orderkey", X.search_url("https://catalogue/granules.json", "SPL3SMP_E", "006", F.col("day"), BOX).alias("url"), X.data_link(F.col("js")).alias("href"))


def district_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation an agency answer in one of four shapes: its records, and the first record of a district."""
    rec = F.to_json(F.struct(F.concat(F.lit(" D"), (F.col("c_custkey") % 9).cast("string"), F.lit(" ")).alias("District"), F.col("c_custkey").alias("Obj_id"), F.col("c_mktsegment").alias("Warning")))
    g = T.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", rec.alias("r")).groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "r"))).alias("rs"))
    texts = F.transform("rs", lambda x: x["r"])
    every, first = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), F.element_at(texts, 1)
    wrap = lambda x: F.concat(F.lit('{"status": 1, "data": '), x, F.lit("}"))
    payload = F.when(F.col("c_nationkey") % 4 == 0, every).when(F.col("c_nationkey") % 4 == 1, wrap(every)).when(F.col("c_nationkey") % 4 == 2, wrap(first)).otherwise(first)
    rows = g.select("c_nationkey", X.feed_records(payload).alias("records"))
    found = X.district_record(F.col("records"), "District", F.lit("d3"), ("District", "Obj_id", "Warning"))
    return rows.select("c_nationkey", F.size("records").cast("long").alias("records"), F.get_json_object(found, "$.Obj_id").cast("long").alias("obj_id"))


def tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per land-cover and elevation tile, all over the earth."""
    lat, lon = (F.col("c_custkey") * 37 % 1780 - 890) / 10.0, (F.col("c_custkey") * 91 % 3600 - 1800) / 10.0
    c = T.table(spark, sf_dir, "customer").select(X.cover_tile(lat, lon).alias("cover"), X.height_tile(lat, lon).alias("height"))
    return c.groupBy("cover", "height").agg(F.count(F.lit(1)).alias("n"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as map elements: nodes, ways with a centre, and ways of three points."""
    k = F.col("c_custkey")
    place = F.element_at(F.array(*map(F.lit, ("village", "hamlet", "town"))), (k % 3 + 1).cast("int"))
    amenity = F.element_at(F.array(*map(F.lit, ("school", "hospital", "community_centre", "old_school", ""))), (k % 5 + 1).cast("int"))
    people = F.when(k % 4 == 0, F.format_number(k * 13, 0)).when(k % 4 == 1, F.lit("many"))
    tags = F.create_map(F.lit("place"), place, F.lit("amenity"), amenity, F.lit("man_made"), F.when(k % 6 == 0, "bridge"), F.lit("name"), F.when(k % 2 == 0, F.col("c_name")), F.lit("population"), people)
    at = F.struct((92.6 + k % 271 / 1000).alias("lon"), (23.6 + k % 263 / 1000).alias("lat"))
    pair = lambda i: F.struct((92.6 + k % 271 / 1000 + i / 1000).alias("lon"), (23.6 + k % 263 / 1000 - i / 1000).alias("lat"))
    node, way = k % 5 < 3, k % 5 == 3
    return T.table(spark, sf_dir, "customer").select(
        F.when(node, "node").otherwise("way").alias("type"), k.alias("id"), F.when(node, at["lon"]).alias("lon"), F.when(node, at["lat"]).alias("lat"), F.when(way, at).alias("center"),
        F.when(~node & ~way, F.array(pair(0), pair(1), pair(5))).alias("coords"), tags.alias("tags"),
    )


def exposure_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Villages, schools and hospitals, and bridges of map elements inside a box."""
    e = _elements(spark, sf_dir)
    layer = lambda kind, prefix, pattern=".*": X.exposure_layer(X.exposure(e, kind, (92.6203, 23.6203, 92.8003, 23.8003), pattern), prefix).withColumn("layer", F.lit(kind))
    out = layer("villages", "v_").unionByName(layer("amenity", "s_", "school|hospital")).unionByName(layer("bridges", "b_"))
    return out.select("layer", "id", "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "population")


def _raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as raw map edges between suppliers' and parts' nodes, with tags as arrays."""
    mode = lambda i: F.element_at(F.array(*map(F.lit, ("trunk", "track", "steps", "primary", "path", "service"))), ((F.col("l_linenumber") + i) % 6 + 1).cast("int"))
    highway = F.when(F.col("l_partkey") % 11 == 0, F.array().cast("array<string>")).when(F.col("l_partkey") % 2 == 0, F.array(mode(0))).otherwise(F.array(mode(F.col("l_suppkey")), mode(1)))
    bridge = F.when(F.col("l_suppkey") % 5 == 0, F.array(F.lit(None).cast("string"), F.lit("no"))).when(F.col("l_suppkey") % 5 == 1, F.array(F.lit("no"), F.lit("viaduct")))
    return T.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("u"), (F.col("l_partkey") * 2 + 1).alias("v"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), highway.alias("highway"), bridge.alias("bridge"))


def drivable_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges a vehicle can use per class, and the nodes they touch; two overlapping exports count once."""
    e = X.tagged_edges(_raw_edges(spark, sf_dir))
    both = X.compose([e.where("key % 3 <> 0"), e.where("key % 3 <> 1")], ["u", "v", "key"])
    kept = X.drivable(both)
    nodes = T.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("node")).unionByName(T.table(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("node")))
    ends = X.without_isolates(nodes, kept.where("key % 5 = 0")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("bridges")).withColumn("highway_class", F.lit("nodes"))
    return kept.groupBy("highway_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_bridge").alias("bridges")).unionByName(ends)


def road_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations as road edges; two thirds lack a geometry and become straight lines."""
    n = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") * 10.0).alias("x"), (F.col("n_nationkey") * F.col("n_nationkey") * 1.0).alias("y"))
    point = lambda i: F.struct((F.col("u") * i * 1.0).alias("x"), (F.col("v") * i * 1.0).alias("y"))
    e = T.roads(spark, sf_dir).select("u", "v", "edge_id", F.when(F.col("u") % 4 != 0, F.col("class")).alias("highway_class"), F.when(F.col("v") % 2 == 0, F.col("is_bridge")).alias("is_bridge"), F.when(F.col("u") % 3 == 0, F.array(point(1), point(2), point(3))).alias("geometry"))
    line = F.concat_ws(" ", F.transform("geometry", lambda p: F.concat_ws(",", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))))
    return X.road_edges(n, e).select("edge_id", "highway_class", "is_bridge", line.alias("line"))


def geometry_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as polygons, suppliers' roads as lines and villages as points, written as binary geometries and read
    back from the files: what each geometry says."""
    base = f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}"
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    t = T.terrain(spark, sf_dir)
    x, y, d = F.col("x"), F.col("y"), 100.0 + F.col("cell_id") % 9 * 50.0
    cells = t.select(F.lit("cell").alias("layer"), F.col("cell_id").alias("id"), F.array(p(x, y), p(x + d, y), p(x + d, y + 2 * d), p(x, y + d), p(x, y)).alias("at"))
    k = F.col("s_suppkey")
    bend = F.array(p(k * 1.0, k * 2.0), p(k * 1.0 + 3 * (k % 11), k * 2.0 + 4 * (k % 11)), p(k * 1.0 + 3 * (k % 11), k * 2.0 + 4 * (k % 11) + k % 5))
    roads = T.table(spark, sf_dir, "supplier").select(F.lit("road").alias("layer"), k.alias("id"), bend.alias("at"))
    spots = T.villages(spark, sf_dir).select(F.lit("village").alias("layer"), F.col("village_id").alias("id"), F.when(F.col("village_id") % 17 != 0, F.array(p(F.col("lon"), F.col("lat")))).alias("at"))
    for name, rows, kind in (("cells", cells, W.POLYGON), ("roads", roads, W.LINE), ("villages", spots, W.POINT)):
        Y.encoded(rows.select("layer", "id", "at"), F.col("at"), kind).drop("at").write.parquet(f"{base}/{name}")
    found = [Y.layer(spark, f"{base}/{name}") for name in ("cells", "roads", "villages")]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.select("layer", "id", "kind", *[F.round(c, 5).alias(c) for c in ("x", "y", "area", "length")])


_MAP = (92.6, 23.6, 92.9, 23.9)


def map_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Villages per map tile; tiles with more than a twelfth of them are split once."""
    return X.tile_tree(T.villages(spark, sf_dir), _MAP, most=F.sum("n") / 12, depth=1)


def map_tile_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Villages and suppliers' sites per map tile; tiles with more than a hundredth of them are quartered up to
    three times."""
    v, s = T.villages(spark, sf_dir).select("lon", "lat"), T.sites(spark, sf_dir).select("lon", "lat")
    # Sites crowd in one corner.
    crowd = s.select((92.61 + (F.col("lon") - 92.6) / 40).alias("lon"), (23.61 + (F.col("lat") - 23.6) / 40).alias("lat"))
    return X.tile_tree(v.unionByName(s).unionByName(crowd), _MAP, most=F.sum("n") / 100, depth=3)


_GRID = (10.0, 20.0, 25010.0, 200020.0)


def grid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a grid of 1 km that hold terrain points, with the number of points and their corner."""
    t = T.terrain(spark, sf_dir).select(X.grid_label(F.col("x"), F.col("y"), _GRID, 1000.0).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    g = X.make_grid(spark, "demo", _GRID, 1000.0)
    return t.join(g, F.col("label") == F.col("row") * 25 + F.col("col"), "left").select("label", "n", "cell_id", "x0", "y1")


def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that drain through each terrain cell by steepest descent; a few cells have no data."""
    t = T.terrain(spark, sf_dir)
    high = F.when(F.col("cell_id") % 37 != 0, F.round(F.col("elevation") + F.col("x") / 100, 2))
    return X.flow_accumulation(t.select((F.col("y") / 500).cast("long").alias("row"), (F.col("x") / 500).cast("long").alias("col"), high.alias("elevation")))


def utm_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain cells' positions in zone 46 as longitude and latitude."""
    lon, lat = X.utm_to_lonlat(F.col("x") * 8 + 400000, F.col("y") * 4 + 2600000, 46)
    return T.terrain(spark, sf_dir).select("cell_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    blank = {c: F.lit(None).cast("string").alias(c) for c in X.INVENTORY if c not in ("event_date_ms", "event_dt")}
    own = {
        "objectid": k.alias("objectid"), "event_id": k.alias("event_id"), "latitude": F.when(k % 29 != 0, 23.6 + k % 97 / 400).alias("latitude"), "longitude": (92.6 + k % 89 / 400).alias("longitude"),
        "location_accuracy": pick(("exact", "1km", "5km", "25km", "unknown"), k).alias("location_accuracy"), "country_code": F.when(k % 3 != 0, "IN").otherwise("MM").alias("country_code"),
        "admin_division_name": pick((*X.NER_STATES, "Kerala"), F.floor(k / 3)).alias("admin_division_name"),
    }
    when = F.when(k % 31 == 0, "unknown").otherwise((F.unix_millis(F.col("ts").cast("timestamp"))).cast("string"))
    return T.table(spark, sf_dir, "events").select(*(blank | own).values(), when.alias("event_date"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned events of the region's states."""
    out = X.clean_events(X.regional_events(_inventory(spark, sf_dir)))
    return out.select("event_id", F.col("event_dt").cast("timestamp_ntz").alias("event_dt"), "admin_division_name", "latitude")


def inventory_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.funnel(_inventory(spark, sf_dir), BOX, ("exact", "1km", "5km"))


def holdout_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Villages with and without a held-out settlement within 3 km, settlements without a place left out."""
    s = T.sites(spark, sf_dir).where("site_id % 4 = 0").select(F.when(F.col("site_id") % 8 == 0, F.col("lat")).alias("e_lat"), F.col("lon").alias("e_lon"))
    v = T.villages(spark, sf_dir).select(F.col("village_id").alias("cell_id"), "lat", "lon")
    return X.in_holdout(v, s, 3.0).select("cell_id", "in_holdout")


def buffered_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People around every settlement: the mean of villages within 1.5 km times the area."""
    p = T.villages(spark, sf_dir).select("lat", "lon", F.col("pop").cast("double").alias("value"))
    out = X.buffered_density(T.sites(spark, sf_dir).select(F.col("site_id").alias("place_id"), "lat", "lon"), p, 1.5)
    return out.select("place_id", F.round("value", 4).alias("people"))


def terrain_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that can be scored, of terrain where every ninth lacks a slope and every eleventh a height."""
    k = F.col("cell_id")
    t = T.terrain(spark, sf_dir).select("cell_id", F.when(k % 9 != 0, F.col("slope")).alias("slope_mean_deg"), F.when(k % 11 != 0, F.col("elevation")).alias("elevation_m"))
    return X.has_terrain(t)


QUERIES = {f.__name__: f for f in (
    rain_granules, soil_granules, live_rain_cells, live_soil_cells, cells_to_pixels, latest_granule_day, catalogue_links, district_feeds, tile_names, exposure_layers, drivable_roads, road_edge_lines,
    map_tile_counts, map_tile_tree, geometry_layers, grid_labels, flow_accumulation, utm_positions, inventory, inventory_funnel, holdout_cells, buffered_population, terrain_cells,
)}

_SOIL = """g AS (SELECT 'ease_' || (user_id % 40) || '_' || (user_id % 7) AS pixel_id, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS pass_name, (event_id % 50) / 100.0::DOUBLE AS soil_moisture, event_id % 4 % 2 = 0 AS recommended
        FROM events WHERE event_id % 17 <> 0 AND 92.6::DOUBLE + (user_id % 30) / 100.0::DOUBLE BETWEEN 92.62 AND 92.8 AND 23.6::DOUBLE + (user_id % 23) / 100.0::DOUBLE BETWEEN 23.62 AND 23.8),
    best AS (SELECT pixel_id, soil_moisture, pass_name, recommended FROM g QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY NOT recommended, pass_name <> 'AM', soil_moisture) = 1)"""
_WKM = "6371.0088 * 2 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"
_INV = """inv AS (SELECT event_id, CASE WHEN event_id % 29 <> 0 THEN 23.6::DOUBLE + (event_id % 97) / 400.0::DOUBLE END AS latitude, 92.6::DOUBLE + (event_id % 89) / 400.0::DOUBLE AS longitude, event_id % 3 <> 0 AS here,
    (event_id // 3) % 9 AS s, event_id % 5 < 3 AS trusted, CASE WHEN event_id % 31 <> 0 THEN date_trunc('millisecond', ts) END AS event_dt FROM events)"""


def _utm_sql() -> str:
    """The projection's series as nested expressions, over columns e (x) and n (y)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
    d = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
    lit = lambda v: f"{v!r}::DOUBLE"
    xi1 = " - ".join(["xi", *(f"{lit(v)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(b, 1))])
    eta1 = " - ".join(["eta", *(f"{lit(v)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(b, 1))])
    lat = " + ".join(["chi", *(f"{lit(v)} * sin({2 * j} * chi)" for j, v in enumerate(d, 1))])
    return f"""s AS (SELECT cell_id, (y * 4 + 2600000) / {lit(0.9996 * a)} AS xi, (x * 8 + 400000 - 500000) / {lit(0.9996 * a)} AS eta FROM terrain), s1 AS (SELECT cell_id, {xi1} AS xi1, {eta1} AS eta1 FROM s),
        s2 AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM s1) SELECT cell_id, round(93 + degrees(atan2(sinh(eta1), cos(xi1))), 6) AS lon, round(degrees({lat}), 6) AS lat FROM s2"""


def _layer(kind: str, prefix: str, where: str) -> str:
    return f"""SELECT '{kind}' AS layer, '{prefix}' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'unnamed' END AS name, round(lon, 6) AS lon, round(lat, 6) AS lat,
        CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 13 END AS population FROM el WHERE lon BETWEEN 92.6203 AND 92.8003 AND lat BETWEEN 23.6203 AND 23.8003 AND {where}"""


ORACLES = {
    "rain_granules": """WITH g AS (SELECT 92.6::DOUBLE + (user_id % 30) / 100.0::DOUBLE AS lon, 23.6::DOUBLE + (user_id % 23) / 100.0::DOUBLE AS lat, greatest((value - 20) * 0.5, 0) AS mm FROM events WHERE event_id % 13 <> 0)
        SELECT printf('%.2f_%.2f', lon, lat) AS pixel_id, count(*) AS n, round(sum(mm), 4) AS mm, min(mm) AS least FROM g WHERE lon BETWEEN 92.62 AND 92.8 AND lat BETWEEN 23.62 AND 23.8 GROUP BY 1""",
    "soil_granules": f"WITH {_SOIL} SELECT * FROM best",
    "live_rain_cells": f"""{T.with_tables('rain', 'terrain')}, {_FEATURES} SELECT cell_id, round(coalesce(rain_72h, 0), 6) AS rain_72h, round(coalesce(antecedent_30d, 0), 6) AS antecedent_30d, 'imerg' AS source, false AS is_reconstructed
        FROM terrain LEFT JOIN features ON pixel_id = CAST(cell_id % 400 AS VARCHAR)""",
    "live_soil_cells": f"{T.with_tables('terrain')}, {_SOIL} SELECT cell_id, soil_moisture, 0.0::DOUBLE AS rain_1h, 'smap' AS source FROM terrain LEFT JOIN best ON pixel_id = 'ease_' || (cell_id % 45) || '_' || (cell_id % 7)",
    "cells_to_pixels": f"""{T.with_tables('villages', 'sites')} SELECT village_id AS cell_id, arg_min(site_id, (sqrt(pow(v.lon - s.lon, 2) + pow(v.lat - s.lat, 2)), site_id)) AS pixel_id FROM villages v, sites s WHERE site_id % 3 = 0 GROUP BY 1""",
    "latest_granule_day": "SELECT CAST(max(o_orderdate::DATE) AS VARCHAR) AS day FROM orders WHERE o_orderkey % 5 = 0 AND o_orderdate::DATE BETWEEN DATE '1996-07-10' AND DATE '1996-07-15'",
    "catalogue_links": """WITH d AS (SELECT l_orderkey, strftime(max(l_shipdate::DATE), '%Y-%m-%d') AS day, min(l_linenumber) FILTER (l_partkey % 3 = 1 AND l_suppkey % 2 = 0) AS n FROM lineitem GROUP BY 1)
        SELECT l_orderkey, 'https://catalogue/granules.json?short_name=SPL3SMP_E&version=006&temporal=' || day || 'T00%3A00%3A00Z%2C' || day || 'T23%3A59%3A59Z&bounding_box=92.62%2C23.62%2C92.8%2C23.8&page_size=5' AS url,
            'http://g/' || l_orderkey || '-' || n || '.h5' AS href FROM d""",
    "district_feeds": """SELECT c_nationkey, CASE WHEN c_nationkey % 4 < 2 THEN count(*) ELSE 1 END AS records, CASE WHEN c_nationkey % 4 < 2 THEN min(c_custkey) FILTER (c_custkey % 9 = 3) WHEN min(c_custkey) % 9 = 3 THEN min(c_custkey) END AS obj_id
        FROM customer GROUP BY 1""",
    "tile_names": """WITH p AS (SELECT (c_custkey * 37 % 1780 - 890) / 10.0::DOUBLE AS lat, (c_custkey * 91 % 3600 - 1800) / 10.0::DOUBLE AS lon FROM customer),
        q AS (SELECT floor(lat / 3)::INT * 3 AS a3, floor(lon / 3)::INT * 3 AS o3, floor(lat)::INT AS a1, floor(lon)::INT AS o1 FROM p),
        c AS (SELECT CASE WHEN a3 >= 0 THEN printf('N%02d', a3) ELSE printf('S%02d', -a3) END || CASE WHEN o3 >= 0 THEN printf('E%03d', o3) ELSE printf('W%03d', -o3) END AS c,
            'Copernicus_DSM_COG_10_' || CASE WHEN a1 >= 0 THEN printf('N%02d', a1) ELSE printf('S%02d', -a1) END || '_00_' || CASE WHEN o1 >= 0 THEN printf('E%03d', o1) ELSE printf('W%03d', -o1) END || '_00_DEM' AS h FROM q)
        SELECT 'ESA_WorldCover_10m_2021_v200_' || c || '_Map.tif' AS cover, h || '/' || h || '.tif' AS height, count(*) AS n FROM c GROUP BY 1, 2""",
    "exposure_layers": f"""WITH el AS (SELECT *, 92.6::DOUBLE + (c_custkey % 271) / 1000.0::DOUBLE + CASE WHEN c_custkey % 5 = 4 THEN 0.002::DOUBLE ELSE 0 END AS lon, 23.6::DOUBLE + (c_custkey % 263) / 1000.0::DOUBLE - CASE WHEN c_custkey % 5 = 4 THEN 0.002::DOUBLE ELSE 0 END AS lat FROM customer)
        {_layer('villages', 'v_', 'c_custkey % 5 < 3 AND c_custkey % 3 < 2')} UNION ALL {_layer('amenity', 's_', 'c_custkey % 5 < 2')} UNION ALL {_layer('bridges', 'b_', 'c_custkey % 6 = 0')}""",
    "drivable_roads": """WITH m AS (SELECT ['trunk', 'track', 'steps', 'primary', 'path', 'service'] AS names), e AS (SELECT DISTINCT l_suppkey * 2 AS u, l_partkey * 2 + 1 AS v, l_orderkey * 8 + l_linenumber AS k, l_suppkey % 5 = 1 AS is_bridge,
            CASE WHEN l_partkey % 11 = 0 THEN [] WHEN l_partkey % 2 = 0 THEN [names[l_linenumber % 6 + 1]] ELSE [names[(l_linenumber + l_suppkey) % 6 + 1], names[(l_linenumber + 1) % 6 + 1]] END AS h FROM lineitem, m),
        d AS (SELECT * FROM e WHERE len(list_filter(h, lambda x: x IN ('trunk', 'primary', 'service'))) > 0)
        SELECT h[1] AS highway_class, count(*) AS n, count(*) FILTER (is_bridge) AS bridges FROM d GROUP BY 1
        UNION ALL SELECT 'nodes', (SELECT count(*) FROM supplier WHERE s_suppkey * 2 IN (SELECT u FROM d WHERE k % 5 = 0)) + (SELECT count(*) FROM part WHERE p_partkey * 2 + 1 IN (SELECT v FROM d WHERE k % 5 = 0)), 0""",
    "road_edge_lines": f"""{T.with_tables('roads')} SELECT edge_id, CASE WHEN u % 4 <> 0 THEN class ELSE 'unclassified' END AS highway_class, v % 2 = 0 AND is_bridge AS is_bridge,
        CASE WHEN u % 3 = 0 THEN u || ',' || v || ' ' || 2 * u || ',' || 2 * v || ' ' || 3 * u || ',' || 3 * v ELSE 10 * u || ',' || u * u || ' ' || 10 * v || ',' || v * v END AS line FROM roads""",
    "map_tile_counts": f"""{T.with_tables('villages')}, t AS (SELECT r || '-' || c AS label, 92.6::DOUBLE + c * ((92.9::DOUBLE - 92.6::DOUBLE) / 3) AS west, 23.6::DOUBLE + r * ((23.9::DOUBLE - 23.6::DOUBLE) / 3) AS south, (92.9::DOUBLE - 92.6::DOUBLE) / 3 AS w, (23.9::DOUBLE - 23.6::DOUBLE) / 3 AS h FROM range(3) a(r), range(3) b(c)),
        k AS (SELECT label, west, south, w, h, lon, lat, count(*) OVER (PARTITION BY label) > (SELECT count(*) / 12.0::DOUBLE FROM villages) AS dense FROM t JOIN villages ON lon >= west AND lon < west + w AND lat >= south AND lat < south + h)
        SELECT CASE WHEN dense THEN label || '-' || (CASE WHEN lon >= (west + (west + w)) / 2 THEN 1 ELSE 0 END + CASE WHEN lat >= (south + (south + h)) / 2 THEN 2 ELSE 0 END) ELSE label END AS label, count(*) AS n FROM k GROUP BY 1""",
    "geometry_layers": f"""{T.with_tables('terrain', 'villages')}, c AS (SELECT *, 100 + (cell_id % 9) * 50.0::DOUBLE AS d FROM terrain)
        SELECT 'cell' AS layer, cell_id AS id, 3::BIGINT AS kind, round((d * d * (x + d / 2) + d * d / 2 * (x + 2 * d / 3)) / (1.5 * d * d), 5) AS x, round((d * d * (y + d / 2) + d * d / 2 * (y + 4 * d / 3)) / (1.5 * d * d), 5) AS y,
            round(1.5 * d * d, 5) AS area, NULL::DOUBLE AS length FROM c
        UNION ALL SELECT 'road', s_suppkey, 2, s_suppkey, s_suppkey * 2, NULL, 5 * (s_suppkey % 11) + s_suppkey % 5 FROM supplier
        UNION ALL SELECT 'village', village_id, CASE WHEN village_id % 17 <> 0 THEN 1 END, CASE WHEN village_id % 17 <> 0 THEN round(lon, 5) END, CASE WHEN village_id % 17 <> 0 THEN round(lat, 5) END, NULL, NULL FROM villages""",
    "map_tile_tree": f"""{T.with_tables('villages', 'sites')}, q AS (SELECT lon, lat FROM villages UNION ALL SELECT lon, lat FROM sites UNION ALL SELECT 92.61::DOUBLE + (lon - 92.6::DOUBLE) / 40, 23.61::DOUBLE + (lat - 23.6::DOUBLE) / 40 FROM sites),
        p AS (SELECT lon, lat FROM q WHERE lon >= 92.6::DOUBLE AND lon < 92.9::DOUBLE AND lat >= 23.6::DOUBLE AND lat < 23.9::DOUBLE),
        t AS (SELECT r || '-' || c AS label, 92.6::DOUBLE + c * ((92.9::DOUBLE - 92.6::DOUBLE) / 3) AS w, 23.6::DOUBLE + r * ((23.9::DOUBLE - 23.6::DOUBLE) / 3) AS s, (92.9::DOUBLE - 92.6::DOUBLE) / 3 AS dx, (23.9::DOUBLE - 23.6::DOUBLE) / 3 AS dy FROM range(3) a(r), range(3) b(c)),
        h0 AS (SELECT label, w, s, w + dx AS e, s + dy AS n, lon, lat FROM t JOIN p ON lon >= w AND lon < w + dx AND lat >= s AND lat < s + dy),
        b AS (SELECT count(*) / 100.0::DOUBLE AS most FROM p),
        {', '.join(f"""d{i} AS (SELECT *, count(*) OVER (PARTITION BY label) > (SELECT most FROM b) AS dense FROM h{i}),
        h{i + 1} AS (SELECT label || '-' || ((lon >= (w + e) / 2)::INT + 2 * (lat >= (s + n) / 2)::INT) AS label, CASE WHEN lon >= (w + e) / 2 THEN (w + e) / 2 ELSE w END AS w, CASE WHEN lat >= (s + n) / 2 THEN (s + n) / 2 ELSE s END AS s,
            CASE WHEN lon >= (w + e) / 2 THEN e ELSE (w + e) / 2 END AS e, CASE WHEN lat >= (s + n) / 2 THEN n ELSE (s + n) / 2 END AS n, lon, lat FROM d{i} WHERE dense)""" for i in range(3))}
        SELECT label, count(*) AS n FROM (SELECT label FROM d0 WHERE NOT dense UNION ALL SELECT label FROM d1 WHERE NOT dense UNION ALL SELECT label FROM d2 WHERE NOT dense UNION ALL SELECT label FROM h3) GROUP BY 1""",
    "grid_labels": f"""{T.with_tables('terrain')}, p AS (SELECT floor((x - 10) / 1000)::BIGINT AS c, floor((y - 20) / 1000)::BIGINT AS r FROM terrain), l AS (SELECT *, CASE WHEN c BETWEEN 0 AND 24 AND r BETWEEN 0 AND 199 THEN r * 25 + c ELSE -1 END AS label FROM p)
        SELECT label, count(*) AS n, CASE WHEN label >= 0 THEN printf('demo_%03d_%03d', label // 25, label % 25) END AS cell_id, CASE WHEN label >= 0 THEN 10.0::DOUBLE + (label % 25) * 1000 END AS x0, CASE WHEN label >= 0 THEN 20.0::DOUBLE + (label // 25) * 1000 + 1000 END AS y1 FROM l GROUP BY 1""",
    "flow_accumulation": f"""{T.with_tables('terrain', recursive=True)}, px AS (SELECT (y / 500)::BIGINT AS r, (x / 500)::BIGINT AS c, round(elevation + x / 100, 2) AS e FROM terrain WHERE cell_id % 37 <> 0),
        st AS (SELECT a.r, a.c, b.r AS tr, b.c AS tc, (a.e - b.e) / CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END AS drop_by FROM px a JOIN px b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.e > b.e),
        dn AS (SELECT r, c, tr, tc FROM st QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY drop_by DESC, tr - r, tc - c) = 1),
        wk AS (SELECT r, c, r AS at_r, c AS at_c FROM px UNION ALL SELECT wk.r, wk.c, tr, tc FROM wk JOIN dn ON dn.r = at_r AND dn.c = at_c)
        SELECT at_r AS row, at_c AS col, count(*) AS accumulation FROM wk GROUP BY 1, 2""",
    "utm_positions": f"{T.with_tables('terrain')}, {_utm_sql()}",
    "inventory": f"""WITH {_INV} SELECT event_id, event_dt, (['Assam', 'Arunachal Pradesh', 'Manipur', 'Meghalaya', 'Mizoram', 'Nagaland', 'Sikkim', 'Tripura'])[s + 1] AS admin_division_name, latitude FROM inv WHERE here AND s < 8 AND latitude IS NOT NULL""",
    "inventory_funnel": f"""WITH {_INV}, b AS (SELECT *, here AND s < 8 AND latitude IS NOT NULL AS st, latitude BETWEEN 23.62 AND 23.8 AND longitude BETWEEN 92.62 AND 92.8 AS bx FROM inv)
        SELECT count(*) AS raw_rows, count(*) FILTER (here) AS country_rows, count(*) FILTER (st) AS state_rows, count(*) FILTER (st AND bx) AS box_rows, count(*) FILTER (st AND bx AND trusted) AS trusted_rows FROM b""",
    "holdout_cells": f"""{T.with_tables('villages', 'sites')} SELECT a.village_id AS cell_id, EXISTS (SELECT 1 FROM sites b WHERE site_id % 8 = 0 AND {_WKM} <= 3.0) AS in_holdout FROM villages a""",
    "buffered_population": f"""{T.with_tables('villages', 'sites')} SELECT a.site_id AS place_id, round(coalesce(avg(b.pop), 0) * {math.pi * 1.5 * 1.5!r}, 4) AS people FROM sites a LEFT JOIN villages b ON {_WKM} <= 1.5 GROUP BY 1""",
    "terrain_cells": f"{T.with_tables('terrain')} SELECT cell_id, slope AS slope_mean_deg, elevation AS elevation_m FROM terrain WHERE cell_id % 9 <> 0 AND cell_id % 11 <> 0",
}
