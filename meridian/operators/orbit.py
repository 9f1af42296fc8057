"""Satellite orbits from broadcast ephemerides and almanacs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions import geo
from meridian.operators.sequence import asof

#: Fixed values of the GPS interface specification: gravitation, rotation, relativity, light; pi as it defines it.
MU, OMEGA_E, REL_F, LIGHT, GPS_PI = 3.986005e14, 7.2921151467e-5, -4.442807633e-10, 299792458.0, 3.1415926535898
L1_HZ = 1575.42e6
HALF_WEEK = 302400
ANGLES = ("deltan", "i0", "IDOT", "M0", "omega", "Omega0", "Omegad")
ORBIT = ("sqrtA", "e", "M0", "deltan", "omega", "Omega0", "Omegad", "i0", "IDOT", "Cuc", "Cus", "Crc", "Crs", "Cic", "Cis", "toe", "toc", "af0", "af1", "af2", "Tgd")


@F.pandas_udf(T.DoubleType())
def _kepler(e: pd.Series, m: pd.Series) -> pd.Series:
    e, m = e.to_numpy(float), m.to_numpy(float)
    x = m.copy()
    for _ in range(60):
        new = m + e * np.sin(x)
        if np.nanmax(np.abs(new - x), initial=0) < 1e-14:
            x = new
            break
        x = new
    return pd.Series(x)


def kepler(e: Column, m: Column) -> Column:
    """Eccentric anomaly of eccentricity and mean anomaly, by fixed-point iteration in Arrow batches."""
    return _kepler(e, m)


def kepler_unrolled(e: Column, m: Column, steps: int = 10) -> Column:
    """The same in the JVM: steps substitutions, enough for the nearly circular orbits of navigation satellites."""
    x = m
    for _ in range(steps):
        x = m + e * F.sin(x)
    return x


def _wrap(dt: Column) -> Column:
    return F.when(dt > HALF_WEEK, dt - 2 * HALF_WEEK).when(dt < -HALF_WEEK, dt + 2 * HALF_WEEK).otherwise(dt)


def sat_position(df: DataFrame, t: str = "t", solve=kepler_unrolled) -> DataFrame:
    """Adds x, y, z (ECEF, m) and clock (s) of the satellite at GPS time of week t. df has the columns of ORBIT, angles
    in radians; an almanac's missing harmonic terms are zero."""
    zero = F.lit(0.0)
    c = {k: F.coalesce(F.col(k), zero) if k in df.columns else zero for k in ORBIT}
    a = c["sqrtA"] * c["sqrtA"]
    tk = _wrap(F.col(t) - c["toe"])
    n = F.sqrt(F.lit(MU) / (a * a * a)) + c["deltan"]
    df = df.withColumns({"__tk": tk, "__m": c["M0"] + n * tk}).withColumn("__E", solve(c["e"], F.col("__m")))
    big, tk = F.col("__E"), F.col("__tk")
    nu = F.atan2(F.sqrt(F.lit(1.0) - c["e"] * c["e"]) * F.sin(big), F.cos(big) - c["e"])
    df = df.withColumn("__phi", nu + c["omega"])
    phi2 = F.lit(2.0) * F.col("__phi")
    u = F.col("__phi") + c["Cus"] * F.sin(phi2) + c["Cuc"] * F.cos(phi2)
    r = a * (F.lit(1.0) - c["e"] * F.cos(big)) + c["Crs"] * F.sin(phi2) + c["Crc"] * F.cos(phi2)
    i = c["i0"] + c["IDOT"] * tk + c["Cis"] * F.sin(phi2) + c["Cic"] * F.cos(phi2)
    node = c["Omega0"] + (c["Omegad"] - F.lit(OMEGA_E)) * tk - F.lit(OMEGA_E) * c["toe"]
    df = df.withColumns({"__u": u, "__r": r, "__i": i, "__node": node})
    px, py = F.col("__r") * F.cos("__u"), F.col("__r") * F.sin("__u")
    toc = _wrap(F.col(t) - c["toc"])
    clock = c["af0"] + c["af1"] * toc + c["af2"] * toc * toc + F.lit(REL_F) * c["e"] * c["sqrtA"] * F.sin(big) - c["Tgd"]
    return df.withColumns(
        {"x": px * F.cos("__node") - py * F.cos("__i") * F.sin("__node"), "y": px * F.sin("__node") + py * F.cos("__i") * F.cos("__node"), "z": py * F.sin("__i"), "clock": clock}
    ).drop("__tk", "__m", "__E", "__phi", "__u", "__r", "__i", "__node")


def _latest(parts: DataFrame, issue: str, order: str) -> DataFrame:
    """The newest part of each satellite."""
    kept = [c for c in parts.columns if c not in ("tSV", order)]
    return parts.groupBy("tSV").agg(F.max_by(F.struct(*kept), F.struct(order, issue)).alias("p")).select("tSV", "p.*")


def ephemeris(ephem1: DataFrame, ephem2: DataFrame, ephem3: DataFrame, order: str = "TOW17") -> DataFrame:
    """Whole ephemerides: the newest three parts of a satellite whose issues agree; angles from semicircles to radians."""
    one = _latest(ephem1, "IODC", order).withColumn("__iod", F.col("IODC") % 256)
    two, three = (_latest(p, "IODE", order) for p in (ephem2, ephem3))
    out = one.join(two.withColumnRenamed("IODE", "__iode2"), "tSV").join(three.withColumnRenamed("IODE", "__iode3"), "tSV").filter("__iod = __iode2 and __iod = __iode3")
    return out.withColumns({c: F.col(c) * F.lit(GPS_PI) for c in ANGLES if c in out.columns}).drop("__iod", "__iode2", "__iode3")


def ephemerides(ephem1: DataFrame, ephem2: DataFrame, ephem3: DataFrame, order: str = "TOW17", window: float = 7200) -> DataFrame:
    """All whole ephemerides of a log, not the newest alone: parts of a satellite whose issues (iod) agree and that were first
    heard within window of the first part; heard1 to heard3 say when. Angles from semicircles to radians.

    A part is sent again every half minute, so parts of equal content come down to one row before they are joined.
    """
    out = None
    for k, (part, issue) in enumerate(((ephem1, F.col("IODC") % 256), (ephem2, F.col("IODE")), (ephem3, F.col("IODE"))), 1):
        kept = [c for c in part.columns if c not in ("tSV", order)]
        once = part.withColumn("iod", issue).groupBy("tSV", "iod", *kept).agg(F.min(order).alias(f"heard{k}")).drop("IODC", "IODE")
        if out is None:
            out = once
            continue
        out = out.join(once, ["tSV", "iod"]).filter(F.abs(F.col(f"heard{k}") - F.col("heard1")) <= window)
    return out.withColumns({c: F.col(c) * F.lit(GPS_PI) for c in ANGLES if c in out.columns})


def orbits_at(times: DataFrame, orbits: DataFrame, by: str = "tSV", time: str = "t", epoch: str = "toe", valid: float = 7200.0) -> DataFrame:
    """Each time of a satellite with the columns of its orbit whose epoch is nearest, the earlier one of two, no further
    away than valid seconds; times without such an orbit are left out. Epochs and times are seconds of one count.

    The nearest orbit is the last one before or the first one after: two as-of joins, of which none has all of a
    satellite's rows in one task.
    """
    columns = [c for c in orbits.columns if c != by]
    nearest = orbits.select(by, F.col(epoch).cast("double").alias("__at"), F.struct(*columns).alias("__orbit")).groupBy(by, "__at").agg(F.max("__orbit").alias("__orbit"))
    rows = times.withColumn("__t", F.col(time).cast("double"))
    for side, sign in (("before", 1.0), ("after", -1.0)):
        other = nearest.select(by, (F.col("__at") * sign).alias("__t"), F.struct("__at", "__orbit").alias(side))
        rows = asof(rows.withColumn("__t", F.col(time).cast("double") * sign), other, (side,), (by,), "__t")
    early, late = F.col(time) - F.col("before.__at"), F.col("after.__at") - F.col(time)
    chosen = F.when(F.col("before").isNull() | (late < early), F.col("after")).otherwise(F.col("before"))
    rows = rows.withColumn("__chosen", chosen).filter(F.abs(F.col("__chosen.__at") - F.col(time)) <= valid)
    return rows.select(*times.columns, *[F.col(f"__chosen.__orbit.{c}") for c in columns])


def almanac_orbit(almanac: DataFrame) -> DataFrame:
    """Orbits of an almanac: toc = toe = toa, inclination about 0.30 semicircles, no rates or harmonics."""
    out = almanac.withColumns({"toe": F.col("toa"), "toc": F.col("toa"), "i0": (F.col("deltai") + 0.30) * F.lit(GPS_PI), "deltan": F.lit(0.0), "IDOT": F.lit(0.0), "Tgd": F.lit(0.0), "af2": F.lit(0.0)})
    return out.withColumns({c: F.col(c) * F.lit(GPS_PI) for c in ("M0", "omega", "Omega0", "Omegad")})


def merge_almanac(halves: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Almanac halves of one satellite and issue put together; the newest toa of a satellite counts."""
    whole = halves.groupBy("sv", "IODA").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
    return whole.groupBy("sv").agg(F.max_by(F.struct(*columns), "toa").alias("a")).select("sv", "a.*").filter("sqrtA > 0")


def sat_positions(orbits: DataFrame, start: int, stop: int, step: int, solve=kepler_unrolled) -> DataFrame:
    """Positions of every orbit over a grid of times, with latitude, longitude and altitude."""
    rows = orbits.withColumn("t", F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))).cast("double"))
    out = sat_position(rows, "t", solve)
    lat, lon, alt = geo.ecef2lla("x", "y", "z")
    return out.withColumns({"lat": lat, "lon": lon, "alt": alt})


def look_angles(df: DataFrame, lat: float, lon: float, alt: float) -> DataFrame:
    az, el, distance = geo.ecef2aer("x", "y", "z", lat, lon, alt)
    return df.withColumns({"az": az, "el": el, "range": distance})


def range_and_correction(orbits: DataFrame, t: str, x: float, y: float, z: float, iono: float = 0.0, dt: float = 1.0, rounds: int = 2, solve=kepler_unrolled) -> DataFrame:
    """Range from an antenna at ECEF (x, y, z) at reception time t, by iterating the time of sending; range rate over dt
    seconds and L1 Doppler, twice the rate over the wave length as two-way ranging counts it."""

    def at(df: DataFrame, time: str, name: str) -> DataFrame:
        df = df.withColumn("__send", F.col(time))
        for _ in range(rounds + 1):
            df = sat_position(df.drop("x", "y", "z", "clock"), "__send", solve)
            df = df.withColumn(name, F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 + (F.col("z") - z) ** 2))
            df = df.withColumn("__send", F.col(time) - (F.col(name) / F.lit(LIGHT) - F.lit(iono) - F.col("clock")))
        return df

    df = at(orbits.withColumn("__later", F.col(t) + F.lit(dt)), "__later", "__range2")
    df = at(df, t, "range")
    rate = (F.col("__range2") - F.col("range")) / F.lit(dt)
    lat, lon, alt = _antenna(x, y, z)
    az, el, _ = geo.ecef2aer("x", "y", "z", lat, lon, alt)
    return df.withColumns({"az": az, "el": el, "range_rate": rate, "doppler": F.lit(-2.0) * rate / F.lit(LIGHT / L1_HZ)}).drop("__send", "__later", "__range2")


def _antenna(x: float, y: float, z: float) -> tuple[float, float, float]:
    p, ep2 = math.hypot(x, y), (geo.WGS84_A**2 - geo.WGS84_B**2) / geo.WGS84_B**2
    theta = math.atan2(z * geo.WGS84_A, p * geo.WGS84_B)
    phi = math.atan2(z + ep2 * geo.WGS84_B * math.sin(theta) ** 3, p - geo.WGS84_E2 * geo.WGS84_A * math.cos(theta) ** 3)
    n = geo.WGS84_A / math.sqrt(1 - geo.WGS84_E2 * math.sin(phi) ** 2)
    return math.degrees(phi), math.degrees(math.atan2(y, x)), p / math.cos(phi) - n


def utc_correction(df: DataFrame, tow: str = "tow", week: str = "week") -> DataFrame:
    """Adds utc_offset: leap seconds and the polynomial of the ionosphere page."""
    c = F.col
    return df.withColumn("utc_offset", c("ls") + c("IONO.A0") + c("IONO.A1") * (c(tow) - c("IONO.tot") + 604800 * (c(week) - c("IONO.WNt"))))


def sv_summary(**parts: DataFrame) -> DataFrame:
    """Per satellite which of the named parts are present."""
    tagged = None
    for name, df in parts.items():
        one = df.select("tSV").distinct().withColumn("part", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy("tSV").agg(*[F.bool_or(F.col("part") == n).alias(n) for n in parts])
