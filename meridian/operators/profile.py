"""Accuracy, signal, latency and clock profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators.scan import SLICE, scan


def shape(n: Column, mean: Column, sigma: Column, skewness: Column, kurtosis: Column, kind: str = "standard") -> tuple[Column, Column]:
    """Third and fourth moment over n * sigma^k, from Spark's own aggregates of a column.

    Those are mergeable central moments, so nothing is lost where the mean is large against sigma. With deviations from
    another point, d = mean - point: sum((x - point)^3) = M3 + 3 d M2 + n d^3, and the fourth likewise.
    """
    m2 = sigma * sigma * (n - 1)
    m3, m4 = skewness * F.sqrt(m2 * m2 * m2 / n), (kurtosis + 3) * m2 * m2 / n
    d = F.lit(0.0) if kind == "standard" else mean - sigma
    third, fourth = m3 + 3 * d * m2 + n * d * d * d, m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d
    wide = sigma > 0.0001
    return F.when(wide, third / (n * sigma * sigma * sigma)), F.when(wide, fourth / (n * sigma * sigma * sigma * sigma))


def moments(x: str, kind: str = "standard") -> list[Column]:
    """Aggregates n, min, max, mean, sigma, skewness, kurtosis of a column, in one pass.

    kind="standard" centres the third and fourth power on the mean. kind="reference" centres them on sigma, the
    reading that some profile reports are written with; both divide by n * sigma^k and are null for sigma up to
    0.0001 and for fewer than two values.
    """
    c = F.col(x).cast("double")
    sigma, mean = F.stddev_samp(c), F.avg(c)
    third, fourth = shape(F.count(c).cast("double"), mean, sigma, F.skewness(c), F.kurtosis(c), kind)
    return [F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), mean.alias("mean"), sigma.alias("sigma"), third.alias("skewness"), fourth.alias("kurtosis")]


def stats_1d(df: DataFrame, x: str, by: tuple[str, ...] = (), kind: str = "standard") -> DataFrame:
    return df.groupBy(*by).agg(*moments(x, kind))


def centroids(tpv: DataFrame) -> DataFrame:
    return tpv.groupBy("device").agg(F.avg("lat").alias("lat_c"), F.avg("lon").alias("lon_c"), F.avg("altHAE").alias("alt_c"))


def with_centroid(tpv: DataFrame) -> DataFrame:
    """Each fix with its device's centroid; Spark broadcasts the centroids only if they are small."""
    return tpv.join(centroids(tpv), "device")


def space_profile(tpv: DataFrame, distance=geo.earth_distance_small) -> DataFrame:
    """Per device: centroid, spread east, north and up, and the derived error radii."""
    dx, dy = geo.meter_offset("lat_c", "lon_c", "lat", "lon", distance)
    spread = (
        with_centroid(tpv)
        .select("device", "lat_c", "lon_c", "alt_c", dx.alias("dx"), dy.alias("dy"), "altHAE")
        .groupBy("device")
        .agg(
            F.count("*").alias("n"),
            F.first("lat_c").alias("lat_c"),
            F.first("lon_c").alias("lon_c"),
            F.first("alt_c").alias("alt_c"),
            F.stddev_samp("dx").alias("sigma_x"),
            F.stddev_samp("dy").alias("sigma_y"),
            F.stddev_samp("altHAE").alias("sigma_z"),
        )
    )
    x, y, z = F.col("sigma_x"), F.col("sigma_y"), F.col("sigma_z")
    return spread.withColumns(
        {
            "cep": F.lit(0.5887) * (x + y),
            "two_drms": F.lit(2.0) * F.sqrt(x * x + y * y),
            "hep": F.lit(0.6745) * z,
            "sep": F.lit(0.51) * (x + y + z),
            "mrse": F.sqrt(x * x + y * y + z * z),
        }
    )


def at_ranks(rows: DataFrame, shares: dict[str, float], by: str, picked: str, order: str, chunk: int = 1 << 20, near: float = 0.005) -> DataFrame:
    """Per device the column picked of row int(n * p), counted from 0, of each share p, and of the last row; rows are
    ranked by the columns by and order (a number), nulls first. Ranks are exact, and no task sorts a whole device.

    1. A quantile sketch per device gives two cuts around each share. Cuts only choose who is sorted together.
    2. Rows are counted by their place among the cuts; rows equal to a cut, which may be many, by chunks of order too.
    3. The counts tell which places hold the wanted ranks: a hundredth of the rows for each share. Only these are ranked.
    """
    points = [min(max(p + s, 0.0), 1.0) for p in shares.values() for s in (-near, near)]
    sketch = F.percentile_approx(by, F.array(*[F.lit(p) for p in points]), 10000)
    whole = rows.groupBy("device").agg(F.count("*").alias("__n"), F.max_by(picked, F.struct(by, order)).alias("worst"), sketch.alias("__cuts"))
    cuts = [F.col("__cuts")[i] for i in range(len(points))]
    place, tied = F.lit(0), F.lit(False)
    for cut in cuts:
        place = place + F.when(F.col(by) > cut, 2).when(F.col(by) == cut, 1).otherwise(0)
        tied = tied | F.coalesce(F.col(by) == cut, F.lit(False))
    rows = rows.join(whole.select("device", "__n", "__cuts"), "device").withColumn("__place", F.when(F.col(by).isNull(), -1).otherwise(place))
    tied = tied | F.col(by).isNull()
    rows = rows.withColumn("__chunk", F.when(tied, F.coalesce(F.floor(F.col(order) / chunk), F.lit(-(1 << 62)))).otherwise(F.lit(0).cast("long"))).drop("__cuts")

    keys = ["device", "__place", "__chunk"]
    before = F.coalesce(F.sum("__c").over(W.partitionBy("device").orderBy("__place", "__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(*keys, "__n").agg(F.count("*").alias("__c")).withColumn("__before", before)
    wanted = {name: F.floor(F.col("__n") * F.lit(p)) for name, p in shares.items()}
    held = F.lit(False)
    for k in wanted.values():
        held = held | ((k >= F.col("__before")) & (k < F.col("__before") + F.col("__c")))
    k = F.col("__before") + F.row_number().over(W.partitionBy(*keys).orderBy(by, order)) - 1
    ranked = rows.join(counts.filter(held).select(*keys, "__before"), keys).withColumn("__k", k)
    # the nearest, should a mean in by come out a bit other in one of the passes
    picks = ranked.groupBy("device").agg(*[F.min_by(picked, F.abs(F.col("__k") - at)).alias(name) for name, at in wanted.items()])
    return whole.join(picks, "device").select("device", F.col("__n").alias("n"), *shares, "worst")


def cep_percentiles(tpv: DataFrame, distance=geo.earth_distance_small, order: str = "line_no") -> DataFrame:
    """Per device the distance in metres of the fixes at 50, 95 and 99 % and of the last, ranked by degrees from the
    centroid. Ranks are exact; cep_approx needs one pass less."""
    rows = with_centroid(tpv).select("device", order, geo.dist_2d("lat", "lon", "lat_c", "lon_c").alias("__d"), distance("lat", "lon", "lat_c", "lon_c").alias("__m"))
    return at_ranks(rows, {"cep50": 0.5, "cep95": 0.95, "cep99": 0.99}, "__d", "__m", order)


def cep_approx(tpv: DataFrame, distance=geo.earth_distance_small, accuracy: int = 10000) -> DataFrame:
    rows = with_centroid(tpv).withColumn("__m", distance("lat", "lon", "lat_c", "lon_c"))
    p = F.percentile_approx("__m", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), accuracy)
    return rows.groupBy("device").agg(F.count("*").alias("n"), p.alias("p")).select("device", "n", *[F.col("p")[i].alias(f"cep{q}") for i, q in enumerate((50, 95, 99))])


def altitude_ep(tpv: DataFrame, order: str = "line_no") -> DataFrame:
    """As cep_percentiles, of distances in altitude from the mean."""
    rows = with_centroid(tpv).select("device", order, F.abs(F.col("altHAE") - F.col("alt_c")).alias("__a"))
    return at_ranks(rows, {"ep50": 0.5, "ep95": 0.95, "ep99": 0.99}, "__a", "__a", order)


def max_3d(tpv: DataFrame) -> DataFrame:
    """Per device the largest ECEF distance from the ECEF centroid."""
    x, y, z = geo.lla2ecef("lat", "lon", "altHAE")
    ecef = tpv.select("device", x.alias("x"), y.alias("y"), z.alias("z"))
    centre = ecef.groupBy("device").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    return ecef.join(centre, "device").groupBy("device").agg(F.max(geo.dist_3d("x", "y", "z", "cx", "cy", "cz")).alias("max_3d"))


def used_stats(sky: DataFrame, used: str = "uSat") -> DataFrame:
    """Statistics of the number of satellites used, zeros left out."""
    return stats_1d(sky.filter(F.col(used) > 0), used)


def signal_profile(sats: DataFrame, which: str = "all", by: tuple[str, ...] = ("device",)) -> DataFrame:
    """Signal statistics of satellite rows, and how many were seen and used.

    Satellites without direction count as seen only. which: all, used or unused ones make the points.
    """
    placed = F.col("az").isNotNull() & F.col("el").isNotNull()
    point = placed & {"all": F.lit(True), "used": F.col("used"), "unused": ~F.col("used")}[which]
    ss = F.when(point, F.col("ss"))
    return sats.groupBy(*by).agg(
        F.count("*").alias("seen"),
        F.count(F.when(placed & F.col("used"), 1)).alias("used"),
        F.count(F.when(point, 1)).alias("points"),
        F.min(ss).alias("ss_min"),
        F.max(ss).alias("ss_max"),
        F.avg(ss).alias("ss_mean"),
        F.stddev_samp(ss).alias("ss_sigma"),
    )


def signal_points(sats: DataFrame, which: str = "all") -> DataFrame:
    rows = sats.filter("az is not null and el is not null")
    rows = rows if which == "all" else rows.filter(F.col("used") if which == "used" else ~F.col("used"))
    return rows.select("PRN", "ss", "az", "el", "used")


def sky_grid(sats: DataFrame, az_bin: int = 10, el_bin: int = 5) -> DataFrame:
    """Signal strength by cell of the sky."""
    cell = lambda c, b: (F.floor(F.col(c) / b) * b).cast("long")
    return sats.groupBy(cell("az", az_bin).alias("az"), cell("el", el_bin).alias("el")).agg(F.avg("ss").alias("ss"), F.count("*").alias("n"))


def latency_total(tpv: DataFrame, received: str = "rtime") -> DataFrame:
    """Reception less fix time, in seconds."""
    return tpv.withColumn("latency", F.col(received) - F.unix_micros(F.col("time").cast("timestamp")) / F.lit(1e6))


def latency_breakdown(tpv: DataFrame, devices: DataFrame, now: str = "recv") -> DataFrame:
    """Seconds from the fix to: start of report, its transmission (characters * 10 / bps), decoding, reception."""
    fix = F.unix_micros(F.col("time").cast("timestamp")) / F.lit(1e6)
    speeds = devices.select(F.col("path").alias("device"), "bps")
    kept = [c for c in ("line_no", "device", "time") if c in tpv.columns]
    return tpv.join(speeds, "device", "left").select(
        *kept,
        (F.col("sor") - fix).alias("start"),
        (F.col("sor") - fix + F.col("chars") * F.lit(10.0) / F.col("bps")).alias("sent"),
        (F.col("rtime") - fix).alias("decoded"),
        (F.col(now) - fix).alias("received"),
    )


def clock_drift(samples: DataFrame) -> DataFrame:
    """Real less clock time in whole nanoseconds."""
    return samples.withColumn("offset_ns", (F.col("real_sec") - F.col("clock_sec")) * F.lit(1_000_000_000) + F.col("real_nsec") - F.col("clock_nsec"))


def clock_offsets(samples: DataFrame, unit: str = "unit", order: str = "line_no", size: int = SLICE) -> DataFrame:
    """Each unit's series of offsets, numbered in order, with its length."""
    rows = scan(samples, (unit,), order, {"__one": F.lit(1)}, total=("k", "__one", lambda *_: F.lit(1)), whole="n", size=size)
    return rows.withColumn("k", F.col("k") - 1).drop("__one")


def obs_counts(obs: DataFrame, most: int | None = 99999) -> DataFrame:
    """Observations by satellite and code; header fields hold five digits, so counts stop at most. None: whole counts."""
    n = F.count("value")
    return obs.groupBy("gnssid", "svid", "code").agg((n if most is None else F.least(n, F.lit(most))).alias("n"))


def sorted_counts(counts: DataFrame) -> DataFrame:
    """Observation counts with k, their place by system and satellite; unused rows (satellite 0) come last. The table
    has a row per satellite and code."""
    unused = F.col("svid") == 0
    return counts.withColumn("k", F.row_number().over(W.orderBy(unused, F.when(~unused, F.col("gnssid")), "svid", "code")))


def sats_per_constellation(obs: DataFrame) -> DataFrame:
    """Distinct satellites of each system and in all (null system)."""
    pairs = obs.select("gnssid", "svid").distinct()
    return pairs.rollup("gnssid").agg(F.count("*").alias("n"))


def obs_span(raw: DataFrame, fixes: DataFrame) -> DataFrame:
    """First and last observation, smallest step between them, and the first 3D position in ECEF.

    Steps are sought within days; the step into a day is told from the last time of the day before that has any, from a
    table of one row a day."""
    times = raw.select("time").distinct().filter("time is not null").withColumn("day", F.floor(F.col("time") / 86400))
    steps = times.withColumn("step", F.col("time") - F.lag("time").over(W.partitionBy("day").orderBy("time")))
    days = steps.groupBy("day").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.min("step").alias("step"))
    days = days.withColumn("step", F.least("step", F.col("first") - F.lag("last").over(W.orderBy("day"))))
    span = days.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("step").alias("interval"))
    position = fixes.filter("mode = 3").agg(F.min_by(F.struct("ecefx", "ecefy", "ecefz"), "time").alias("position"))
    return span.crossJoin(position)  # one row each


def snr_avg_used(sats: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Mean signal of the used satellites of an epoch; 0 where none is used."""
    used = F.count(F.when(F.col("used"), 1))
    return sats.groupBy(*by).agg(F.when(used > 0, F.sum(F.when(F.col("used"), F.col("ss"))) / used).otherwise(0.0).alias("snr_avg"))


def mean_clock_offset(peers: DataFrame, refclock: str = "127.127.28.0") -> DataFrame:
    """Mean offset in milliseconds."""
    return peers.filter(F.col("peer") == refclock).agg(F.avg(F.col("offset") * 1000).alias("offset_ms"))


def min_packet_length(lines: DataFrame, kind: str = "type", line: str = "line") -> DataFrame:
    return lines.groupBy(kind).agg(F.min(F.length(line)).alias("length"))


def class_histogram(reports: DataFrame, by: tuple[str, ...] = ("class", "type")) -> DataFrame:
    return reports.groupBy(*by).agg(F.count("*").alias("n"))


def latest_state(reports: DataFrame, columns: tuple[str, ...], time: str = "time", tie: str = "line_no") -> DataFrame:
    """The last report of each device."""
    last = reports.groupBy("device").agg(F.max_by(F.struct(*columns), F.struct(time, tie)).alias("__last"))
    return last.select("device", "__last.*")


def first_pair(sky: DataFrame, tpv: DataFrame) -> DataFrame:
    """The first skyview with satellites beside the first fix."""
    s = sky.filter(F.size("satellites") > 0).agg(F.min_by(F.struct(*sky.columns), "time").alias("sky"))
    t = tpv.agg(F.min_by(F.struct(*tpv.columns), "time").alias("tpv"))
    return s.crossJoin(t)  # one row each
