"""Nearest things of points that lie far from all of them."""

from pyspark.sql import functions as F

from slopeline.operators import joins as J


def test_far_points_open_few_cells(spark):
    """Seen from far away a whole side of the things is about equally near; only cells that can win are opened."""
    k = F.col("id")
    sites = spark.range(4000).select(k.alias("site"), (k * 397 % 24000).cast("double").alias("x"), (k * 211 % 18000).cast("double").alias("y"))
    points = spark.range(400).select(k.alias("id"), (k % 50 * 500.0).alias("x"), (1e6 + F.floor(k / 50) * 500.0).alias("y"))
    boxes = sites.select("x", "y", F.col("x").alias("lx"), F.col("x").alias("hx"), F.col("y").alias("ly"), F.col("y").alias("hy"))
    _, cells = J._candidates(points, boxes, 1500.0)
    assert cells.count() <= 4 * 400
    d = F.hypot(points.x - sites.x, points.y - sites.y)
    want = points.crossJoin(sites).groupBy("id").agg(F.min(F.struct(d.alias("d"), "site")).alias("b")).select("id", "b.site")
    got = J.nearest(points.select("id", F.col("x").alias("lon"), F.col("y").alias("lat")), sites.select("site", F.col("x").alias("s_lon"), F.col("y").alias("s_lat")), key="id", site="site", cell=1500.0)
    assert got.select("id", "site").exceptAll(want).isEmpty() and got.count() == 400
