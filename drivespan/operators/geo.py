"""Positions and headings, and the analyses along roads and clocks that build on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions.vehicle import wrap_degrees

#: The WGS 84 ellipsoid, and the GPS epoch with the leap seconds since.
A, E2 = 6378137.0, 6.69437999014e-3
GPS_EPOCH, LEAP_S = 315964800, 18


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 5) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees; the latitude's iteration is unrolled."""
    p = F.hypot(x, y)
    lat = F.atan2(z, p * (1 - E2))
    for _ in range(rounds):
        n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
        lat = F.atan2(z + E2 * n * F.sin(lat), p)
    return F.degrees(lat), F.degrees(F.atan2(y, x))


def geodetic_to_ecef(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point of the ellipsoid at a latitude and longitude."""
    n = A / F.sqrt(1 - E2 * F.sin(F.radians(lat)) ** 2)
    return n * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), n * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), n * (1 - E2) * F.sin(F.radians(lat))


def local_plane(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin, good near it."""
    return F.radians(lon - lon0) * A * F.cos(F.radians(F.lit(lat0))), F.radians(lat - lat0) * A


def gps_to_unix(week: Column, tow: Column) -> Column:
    return week * 604800 + tow + GPS_EPOCH - LEAP_S


def circular_mean(heading: str) -> Column:
    """The mean direction of headings in degrees, 0 to 360."""
    r = F.radians(heading)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def unwrapped(heading: Column, block: str, order: str) -> Column:
    """Headings without jumps: the first one and the running sum of wrapped differences."""
    w = Window.partitionBy(block).orderBy(order)
    step = F.coalesce(wrap_degrees(heading - F.lag(heading).over(w)), F.lit(0.0))
    return F.struct(step.alias("step"), F.first(heading).over(w).alias("first"))


def course_rate(df: DataFrame, heading: str, v: str, block: str, order: str, dt: float, half: int, v_min: float) -> DataFrame:
    """df with course_rate in deg/s: the central difference of the smoothed unwrapped course, null below v_min."""
    w = Window.partitionBy(block).orderBy(order)
    d = df.withColumn("__u", unwrapped(F.col(heading), block, order))
    d = d.withColumn("__c", F.col("__u.first") + F.sum("__u.step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__s", F.avg("__c").over(w.rowsBetween(-half, half)))
    return d.withColumn("course_rate", F.when(F.col(v) >= v_min, (F.lead("__s").over(w) - F.lag("__s").over(w)) / (2 * dt))).drop("__u", "__c", "__s")


def translated_velocity(vx: Column, vy: Column, yaw_dps: Column, dx: float, dy: float) -> tuple[Column, Column, Column]:
    """(vx, vy, sideslip in degrees) at a point dx ahead and dy to the left of where the velocity was measured."""
    r = F.radians(yaw_dps)
    x, y = vx - r * dy, vy + r * dx
    return x, y, F.degrees(F.atan2(y, x))


def distance_along(v: Column, block: str, order: str, dt: float) -> Column:
    """Metres driven since the block's start."""
    return F.sum(F.coalesce(v, F.lit(0.0)) * dt).over(Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def pass_metrics(rows: DataFrame, keys: list[str], offset: str, x: str, inner: float, flank: float) -> DataFrame:
    """keys with the greatest |x| within inner of the site, its offset, and its ratio to the median |x| of the flanks between inner and flank."""
    near, side = F.abs(offset) <= inner, (F.abs(offset) > inner) & (F.abs(offset) <= flank)
    mag = F.abs(x)
    g = rows.groupBy(*keys).agg(F.max(F.when(near, mag)).alias("peak"), F.max_by(offset, F.when(near & F.col(x).isNotNull(), F.struct(mag, -F.abs(offset), F.col(offset)))).alias("peak_at"), F.percentile(F.when(side, mag), 0.5).alias("__f"))
    return g.select(*keys, "peak", "peak_at", F.try_divide(F.col("peak"), F.col("__f")).alias("contrast"))


def repeat_surprise(passes: DataFrame, site: str, hit: Column, score: str, rate: float) -> DataFrame:
    """(site, n, hits, surprise): binomial surprise of a site's hits against a null rate, its strongest pass left out."""
    from drivespan.functions.vehicle import log_binomial_tail

    w = Window.partitionBy(site).orderBy(F.desc_nulls_last(score))
    rest = passes.withColumn("__h", F.coalesce(hit, F.lit(False)).cast("int")).withColumn("__r", F.row_number().over(w)).filter("__r > 1")
    g = rest.groupBy(site).agg(F.count("*").cast("int").alias("n"), F.sum("__h").cast("int").alias("hits"))
    return g.withColumn("surprise", log_binomial_tail(F.col("hits"), F.col("n"), F.lit(rate)))


def exposed_scan(df: DataFrame, key: str, tick: str, exposed: Column, x: str, width: int) -> DataFrame:
    """(key, tick, exposed_share, mean): the window of `width` rows with the greatest mean of x among those that are wholly exposed; the earliest of equals."""
    w = Window.partitionBy(key).orderBy(tick).rowsBetween(0, width - 1)
    d = df.withColumn("__e", F.coalesce(exposed, F.lit(False)).cast("double")).withColumns({"exposed_share": F.avg("__e").over(w), "mean": F.avg(x).over(w), "__n": F.count(F.lit(1)).over(w)})
    d = d.filter((F.col("__n") == width) & (F.col("exposed_share") == 1.0) & F.col("mean").isNotNull())
    best = F.max_by(F.struct(F.col(tick), F.col("exposed_share"), F.col("mean")), F.struct(F.col("mean"), -F.col(tick)))
    return d.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def block_means(df: DataFrame, keys: list[str], t: str, width: float, x: str, y: str) -> DataFrame:
    """keys with the correlation of block means of x and y over blocks of `width` seconds, and their number."""
    b = df.groupBy(*keys, F.floor(F.col(t) / width).alias("b")).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    return b.groupBy(*keys).agg(F.count("*").alias("blocks"), F.corr("mx", "my").alias("r"))


def calibration_windows(df: DataFrame, key: str, t: str, width: float, excluded: DataFrame, margin: float, v: str, v_min: float, least: int, heading: str) -> DataFrame:
    """(key, win, n, slope): windows fast enough throughout, with enough rows, that touch no excluded interval (key, b_start, b_end) widened by margin; slope of the heading over time."""
    from drivespan.operators.joins import overlap_join

    g = df.groupBy(key, F.floor(F.col(t) / width).alias("win")).agg(F.count("*").alias("n"), F.min(v).alias("__v"), F.regr_slope(heading, t).alias("slope"))
    g = g.filter((F.col("n") >= least) & (F.col("__v") >= v_min)).drop("__v").withColumns({"a_start": F.col("win") * width, "a_end": (F.col("win") + 1) * width})
    return overlap_join(g, excluded, key, max(width, 1.0) * 4, "left_anti", pad=margin).drop("a_start", "a_end")


def aligned_streams(a: DataFrame, b: DataFrame, key: str, t: str) -> DataFrame:
    """(key, offset, shared_s): the later start of two streams less the first's, and the seconds that both cover."""
    x = a.groupBy(key).agg(F.min(t).alias("a0"), F.max(t).alias("a1"))
    y = b.groupBy(key).agg(F.min(t).alias("b0"), F.max(t).alias("b1"))
    return x.join(y, key).select(key, (F.greatest("a0", "b0") - F.col("a0")).alias("offset"), F.greatest(F.least("a1", "b1") - F.greatest("a0", "b0"), F.lit(0.0)).alias("shared_s"))


def horizontal_alignment(df: DataFrame, drive: str, x: str, y: str, rx: str, ry: str) -> DataFrame:
    """(drive, angle): the rotation that best turns (x, y) onto the reference (rx, ry), from two sums a drive."""
    g = df.groupBy(drive).agg(F.sum(F.col(x) * F.col(rx) + F.col(y) * F.col(ry)).alias("c"), F.sum(F.col(x) * F.col(ry) - F.col(y) * F.col(rx)).alias("s"))
    return g.select(drive, F.degrees(F.atan2("s", "c")).alias("angle"))
