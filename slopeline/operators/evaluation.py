"""Model evaluation and sampling tables over (y, p) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import cut


def calibration(rows: DataFrame) -> DataFrame:
    """(bin, n, mean_p, observed) for the bins that have rows; bins are open below, but for the first."""
    top = F.lit(None).cast("double")
    for edge in reversed(C.CALIBRATION_EDGES):
        top = F.when(F.col("p") <= edge, edge).otherwise(top)
    return rows.groupBy(top.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))


def confusion(rows: DataFrame, thresholds: tuple[float, ...] = C.OPERATING_THRESHOLDS) -> DataFrame:
    """(threshold, tp, fp, fn, tn, caught) in one pass: counts per threshold, then a row each."""
    yes = F.col("y") > 0
    counts = []
    for i, t in enumerate(thresholds):
        hit = F.col("p") >= t
        counts += [F.count_if(hit & yes).alias(f"tp{i}"), F.count_if(hit & ~yes).alias(f"fp{i}"), F.count_if(~hit & yes).alias(f"fn{i}"), F.count_if(~hit & ~yes).alias(f"tn{i}")]
    one = rows.agg(*counts)
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)])
    out = one.select(F.explode(each).alias("r")).select("r.*")
    return out.withColumn("caught", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))


_BUCKETS = 1024


def _by_score(rows: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, with those of lower buckets of scores (``pos0``, ``neg0``)
    and those of lower scores in the bucket (``pos1``, ``neg1``): running sums without one task for all."""
    s = rows.groupBy("p").agg(F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") <= 0).alias("neg"))
    s = s.withColumn("bucket", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "p")) * _BUCKETS))
    sums = s.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # at most _BUCKETS + 1 rows
    below = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("p").over(below), F.lit(0)).alias("pos0"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("neg0"))
    inside = Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({c + "1": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("pos", "neg")})
    return s.join(F.broadcast(sums), "bucket")


def roc_auc(rows: DataFrame) -> DataFrame:
    """(auc): the chance that a positive scores above a negative, ties half; null with one class."""
    s = _by_score(rows)
    wins = F.col("pos") * (F.col("neg0") + F.col("neg1") + F.col("neg") / 2)
    return s.withColumn("wins", wins).agg((F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(ap): precision at each distinct score, weighed by the recall it adds."""
    s = _by_score(rows)
    total = F.broadcast(rows.agg(F.count_if(F.col("y") > 0).alias("all_pos"), F.count_if(F.col("y") <= 0).alias("all_neg")))
    tp, fp = F.col("all_pos") - F.col("pos0") - F.col("pos1"), F.col("all_neg") - F.col("neg0") - F.col("neg1")  # at or above the score
    return s.join(total).withColumn("part", F.col("pos") * tp / (tp + fp)).agg((F.sum("part") / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"))


_BINS = 1024


def quantiles(rows: DataFrame, column: str, fractions: list[float]) -> list[float | None]:
    """Exact quantiles of a column with linear interpolation between neighbours, nulls left out.

    Ranks are found by refinement: a histogram of ``_BINS`` bins over a range, then one over the bin that
    holds the rank, until it holds a single value. A pass sends at most ``_BINS`` rows for each rank to
    the driver, and the number of passes follows the precision of a double, not the number of rows.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return [None] * len(fractions)
    places = [(n - 1) * f for f in fractions]
    ranks = sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))})
    # Of each rank: the range that holds it and how many values lie below the range.
    open_ = {r: (low, high, 0) for r in ranks}
    found: dict[int, float] = {}
    while open_:
        for r, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[r] = lo
                del open_[r]
        ranges = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        if not ranges:
            break
        # Halves keep the width of ranges over nearly all doubles finite.
        asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(1.0 if hi - lo < float("inf") else 0.5).alias("k")) for i, (lo, hi) in enumerate(ranges)])
        each = values.select("v", F.explode(F.filter(asked, lambda x: F.col("v").between(x["lo"], x["hi"]))).alias("x"))
        k = F.col("x.k")
        place = (F.col("v") * k - F.col("x.lo") * k) / (F.col("x.hi") * k - F.col("x.lo") * k) * _BINS
        bins = each.groupBy(F.col("x.i").alias("i"), F.least(F.floor(place), F.lit(_BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        told: dict[int, list] = {}
        for b in bins.orderBy("i", "bin").collect():
            told.setdefault(b["i"], []).append(b)
        for r, (lo, hi, below) in open_.items():
            for b in told[ranges.index((lo, hi))]:
                if r < below + b["n"]:
                    open_[r] = (b["lo"], b["hi"], below)
                    break
                below += b["n"]
    out = []
    for p in places:
        lower, upper = int(p), min(int(p) + 1, n - 1)
        out.append(found[lower] if p == lower or lower == upper else (upper - p) * found[lower] + (p - lower) * found[upper])
    return out


def quadrants(rows: DataFrame) -> DataFrame:
    """Rows with the quadrant of their place by the medians of lat and lon; on the median counts as north or east."""
    (mlat,), (mlon,) = quantiles(rows, "lat", [0.5]), quantiles(rows, "lon", [0.5])
    return rows.withColumn("block", F.concat(F.when(F.col("lat") >= F.lit(mlat).cast("double"), "N").otherwise("S"), F.when(F.col("lon") >= F.lit(mlon).cast("double"), "E").otherwise("W")))


def strata(rows: DataFrame, value: str) -> DataFrame:
    """Rows with stratum 0, 1 or 2 by exact tertiles of a value."""
    one, two = (F.lit(q).cast("double") for q in quantiles(rows, value, [1 / 3, 2 / 3]))
    return rows.withColumn("stratum", F.when(F.col(value) <= one, 0).when(F.col(value) <= two, 1).otherwise(2))


def stratified(candidates: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Per stratum the ``n`` candidates of smallest hash: a sample that is the same on every run.

    Few strata hold all rows, so rows are cut by a bound on the hash before they are ranked: the share
    that is wanted and some more. Where a stratum comes out short of what it can give, the bound is
    widened and the cut made again, so the sample is exact.
    """
    hashed = cut(candidates.withColumn("_hash", F.sha2(F.col(key).cast("string"), 256)))
    due = cut(hashed.groupBy("stratum").agg(F.count(F.lit(1)).alias("_all")).join(wanted, "stratum").withColumn("_due", F.least("n", "_all")))
    unit = F.conv(F.substring("_hash", 1, 12), 16, 10).cast("double") / float(16**12)
    more = 6.0
    while True:
        bound = (F.col("_due") + more * F.sqrt("_due") + more) / F.col("_all")
        near = cut(hashed.join(due, "stratum").where(unit <= bound).drop("_all"))
        short = due.join(near.groupBy("stratum").agg(F.count(F.lit(1)).alias("_got")), "stratum", "left").where(F.coalesce("_got", F.lit(0)) < F.col("_due"))
        if short.isEmpty():
            break
        more *= 8
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("_hash", key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_due")).select(*candidates.columns)


def attributions(rows: DataFrame, key: str, groups: dict[str, list[str]], top: int = 4) -> DataFrame:
    """(key, rank, grp, contribution, pct): the groups of columns that weigh most in each row."""
    parts = F.array(*[F.struct(F.lit(g).alias("grp"), sum((F.col(c) for c in cols), F.lit(0.0)).alias("x")) for g, cols in groups.items()])
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.abs(x["x"]))
    ranked = F.slice(F.array_sort("parts", lambda a, b: F.when(F.abs(a["x"]) > F.abs(b["x"]), -1).when(F.abs(a["x"]) < F.abs(b["x"]), 1).when(a["grp"] < b["grp"], -1).otherwise(1)), 1, top)
    out = rows.select(key, parts.alias("parts")).select(key, total.alias("total"), F.posexplode(ranked).alias("rank", "r"))
    pct = 100 * F.abs("r.x") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    return out.select(key, "rank", F.col("r.grp").alias("grp"), F.col("r.x").alias("contribution"), pct.alias("pct"))
