"""Trailing features, trends and other ordered computations over time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def trailing_sums(rain: DataFrame, now: Column, windows: dict[str, int] = C.FEATURE_WINDOWS_HOURS, upper_bound: bool = False) -> DataFrame:
    """Rain per pixel since ``now`` less each window, in one aggregation.

    Readings after ``now`` count too unless ``upper_bound`` is set; pixels without rain get 0.
    """
    ok = (F.col("ts") <= now) if upper_bound else F.lit(True)
    sums = [F.sum(F.when(ok & (F.col("ts") >= now - F.expr(f"INTERVAL {h} HOURS")), F.col("precip_mm")).otherwise(0.0)).alias(n) for n, h in windows.items()]
    return rain.groupBy("pixel_id").agg(*sums, F.min("ts").alias("first_ts"))


def hourly(rain: DataFrame) -> DataFrame:
    """Rain by pixel and hour; hours without a reading are absent."""
    return rain.groupBy("pixel_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("precip_mm").alias("mm"))


def rolling(series: DataFrame, key: str, order: str, value: str, hours: dict[str, int]) -> DataFrame:
    """Sums over the latest hours of each key, the current one included; hours without a row count 0."""
    w = Window.partitionBy(key).orderBy(F.col(order).cast("timestamp").cast("long"))
    return series.withColumns({n: F.sum(value).over(w.rangeBetween(-3600 * (k - 1), 0)) for n, k in hours.items()})


def soil_proxy(series: DataFrame, key: str, value: str) -> DataFrame:
    """Soil moisture from 0.22 to 0.92 by the share of the key's wettest value; values count to a nanometre."""
    near = F.round(value, 6)
    peak = F.max(near).over(Window.partitionBy(key))
    return series.withColumn("soil_moisture", F.when(peak > 0, F.round(0.22 + 0.70 * near / peak, 4)).otherwise(0.22))


def hyetograph(steps: DataFrame, total: str = "total_mm", n: str = "n_steps", peak: str = "peak") -> DataFrame:
    """A storm's depth by step: blocks of a power-law curve, the largest at the peak, then by turns
    after and before it, spilling to the side that is still open.

    A row of (storm, total_mm, n_steps, peak) becomes n_steps rows of (storm, step, mm).
    """
    power = 1.0 + C.ID_EXPONENT  # depth grows with duration to this power
    rows = steps.withColumn("step", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    k = F.col("step")
    away = k - F.col(peak)
    behind, ahead = F.col(peak), F.col(n) - 1 - F.col(peak)  # steps before and after the peak
    both = F.least(behind, ahead)
    turn = F.when(away == 0, 0).when(away > 0, F.when(away <= both, 2 * away - 1).otherwise(away + both)).otherwise(F.when(-away <= both, -2 * away).otherwise(-away + both))
    # The i-th largest block is the i-th increment of the curve, as the curve is concave.
    block = F.pow((turn + 1) / F.col(n), F.lit(power)) - F.pow(turn / F.col(n), F.lit(power))
    return rows.select("storm", "step", (F.col(total) * block).alias("mm"))


def trend(points: DataFrame, key: str, order: str, value: str, history: int = C.HISTORY) -> DataFrame:
    """Least squares of value against hours over each key's latest ``history`` points: one row per key."""
    late = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = points.withColumn("_late", late).where(F.col("_late") <= history)
    first = F.min(order).over(Window.partitionBy(key))
    x = (F.col(order).cast("timestamp").cast("double") - first.cast("timestamp").cast("double")) / 3600.0
    rows = rows.withColumn("_x", x)
    fit = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max("_x").alias("x_last"), F.max_by(value, order).alias("y_last"),
        F.regr_slope(value, "_x").alias("slope"), F.regr_intercept(value, "_x").alias("intercept"),
        F.when(F.var_pop(value) > 0, F.greatest(F.lit(0.0), F.regr_r2(value, "_x"))).otherwise(0.0).alias("r2"),
    )
    return fit


def safe_window(fit: DataFrame) -> DataFrame:
    """Hours until the trend crosses the critical ratio: lo_h, hi_h, confidence, basis."""
    slope = F.col("slope")
    cross = F.when(slope > 0, (C.WINDOW_CRITICAL - F.col("intercept")) / slope - F.col("x_last"))
    basis = (
        F.when(F.col("y_last") >= C.WINDOW_CRITICAL, "critical now")
        .when(F.col("n") < C.WINDOW_MIN_POINTS, "too few points")
        .when(F.col("x_last") == 0, "one timestamp")
        .when(F.coalesce(slope, F.lit(0.0)) <= 0, "flat or falling")
        .when(cross <= 0, "trend is past critical")
        .when(cross > C.WINDOW_MAX_HOURS, "beyond the horizon")
        .otherwise("projected")
    )
    rows = fit.withColumn("basis", basis).withColumn("cross", cross)
    at_once, projected = F.col("basis").isin("critical now", "trend is past critical"), F.col("basis") == "projected"
    margin = F.greatest(C.WINDOW_MARGIN * F.col("cross"), F.lit(C.WINDOW_MIN_MARGIN_HOURS))
    damp = F.least(F.lit(1.0), F.col("n") / (C.WINDOW_MIN_POINTS + 2))
    confidence = F.when(F.col("basis") == "critical now", 1.0).when(at_once, F.least(F.col("r2"), F.lit(0.95))).when(projected, F.least(F.lit(0.95), F.col("r2") * damp)).otherwise(0.0)
    return rows.withColumns({
        "lo_h": F.when(at_once, 0.0).when(projected, F.greatest(F.lit(0.0), F.col("cross") - margin)),
        "hi_h": F.when(at_once, C.WINDOW_NOW_HOURS).when(projected, F.col("cross") + margin),
        "confidence": confidence,
    })


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key, as an aggregation without a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def fill_gaps(stored: DataFrame, start: Column, end: Column, minutes: int = 30) -> DataFrame:
    """Time steps from start to end that ``stored`` (column ts) lacks."""
    spark = stored.sparkSession
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    due = spark.range(1).select(F.explode(F.sequence(start, end, step)).alias("slot"))
    have = stored.select(F.window("ts", f"{minutes} minutes").start.alias("slot")).distinct()
    return due.join(have, "slot", "left_anti")
