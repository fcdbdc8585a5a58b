"""Statistics of grid pixels over polygons of any shape.

A polygon is cut into spans: on the middle line of each row of pixels it crosses, the places where its
edges cross the line, in order, two by two. Spans are cut once more at blocks of columns, so that
pixels meet spans by row and block, an equi-join whose keys are no hotter than a block of a row is
wide; what is compared is two numbers. Polygons are never compared with pixels elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64  # columns


def spans(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """(key, row, x0, x1): where each polygon lies on the middle lines of rows of pixels of ``size``.

    ``polygons`` has key and ring, an array of structs (x, y), closed or not; holes and parts may follow as
    rows of the same key: what an even number of rings cover is outside. An edge takes its lower end
    and not its upper one, so a corner on a line counts once; x0 belongs to a span, x1 does not.
    """
    ring = F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    closed = polygons.select(key, ring.alias("ring")).where(F.size("ring") > 2)
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    edges = closed.select(key, F.explode(F.arrays_zip(F.col("ring").alias("a"), after.alias("b"))).alias("e")).select(key, "e.a", "e.b").where("a.y <> b.y")
    upward = F.when(F.col("a.y") < F.col("b.y"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    up = edges.select(key, upward.alias("e")).select(key, F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    # Rows whose middle line y = (row + 0.5) * size lies in [a.y, b.y).
    first, end = F.ceil(F.col("a.y") / size - 0.5).cast("long"), F.ceil(F.col("b.y") / size - 0.5).cast("long")
    rows = up.where(first < end).withColumn("row", F.explode(F.sequence(first, end - 1)))
    y = (F.col("row") + 0.5) * size
    x = F.col("a.x") + (y - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y"))
    crossed = rows.groupBy(key, "row").agg(F.sort_array(F.collect_list(x)).alias("xs"))  # as many as edges of the polygon
    pair = F.transform(F.sequence(F.lit(1), F.floor(F.size("xs") / 2).cast("int")), lambda i: F.struct(F.element_at("xs", 2 * i - 1).alias("x0"), F.element_at("xs", 2 * i).alias("x1")))
    return crossed.where("size(xs) > 1").select(key, "row", F.inline(pair)).where("x0 < x1")


def pixels_in(polygons: DataFrame, pixels: DataFrame, key: str, size: float) -> DataFrame:
    """``pixels`` (row, col, ...) with the key of each polygon that holds their middle."""
    place = lambda x: F.ceil(x / size - 0.5).cast("long")  # noqa: E731 - the first column whose middle is not left of x
    s = spans(polygons, key, size).select(key, "row", place(F.col("x0")).alias("_first"), place(F.col("x1")).alias("_end")).where("_first < _end")
    block = lambda c: F.floor(c / _BLOCK)
    s = s.withColumn("_block", F.explode(F.sequence(block(F.col("_first")), block(F.col("_end") - 1))))
    met = pixels.withColumn("_block", block(F.col("col"))).join(s, ["row", "_block"])
    return met.where((F.col("col") >= F.col("_first")) & (F.col("col") < F.col("_end"))).drop("_block", "_first", "_end")


def zonal(polygons: DataFrame, pixels: DataFrame, key: str, size: float, **stats: Column) -> DataFrame:
    """(key, n, ...): ``stats`` over the pixels in each polygon; polygons without pixels have n = 0 and nulls."""
    found = pixels_in(polygons, pixels, key, size).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in stats.items()])
    return polygons.select(key).distinct().join(found, key, "left").na.fill(0, ["n"])
