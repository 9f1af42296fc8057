"""Joins: reports of an epoch, lookups, ranges, nearest stations, orbit parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.functions.gnss import PRN_RANGES
from meridian.operators.nmea import ranged


def join_reports(tpv: DataFrame, *others: DataFrame, by: tuple[str, ...] = ("device", "time"), how: str = "left") -> DataFrame:
    """Reports of the same device and epoch beside each other; a column already there gets the suffix of its place."""
    out = tpv
    for k, other in enumerate(others, 1):
        other = other.select(*by, *[F.col(c).alias(f"{c}_{k}" if c in out.columns else c) for c in other.columns if c not in by])
        out = out.join(other, list(by), how)
    return out


def lookup(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str, columns: tuple[str, ...]) -> DataFrame:
    """Labels from a dimension table; Spark broadcasts it if its size is small."""
    d = dimension.select(F.col(dimension_key).alias("__key"), *columns)
    return df.join(d, F.col(key) == F.col("__key"), "left").drop("__key")


def prn_range_join(sats: DataFrame, prn: str = "prn") -> DataFrame:
    """System and number within the system of a satellite number: the few fixed ranges are one expression, no join."""
    return sats.withColumns({"gnssid": ranged(F.col(prn), PRN_RANGES, 2), "svid": ranged(F.col(prn), PRN_RANGES, 3)})


def nearest_stations(fixes: DataFrame, stations: DataFrame, most: int = 12, within_m: float = 1_600_000.0, cell: float = 5.0, distance=geo.earth_distance_small, key: str = "line_no", listed: int = 256) -> DataFrame:
    """The stations nearest to each fix, nearest first, ties by server.

    Both sides are dealt to cells of latitude and longitude; a station goes to all cells that its circle touches, with
    those beyond 180 degrees (its longitude there is moved by a turn) and all longitudes near a pole, so the join is by
    cell and not with every station. Cells of up to listed stations join as a list, in which a fix's are sorted beside it:
    no pair of fix and station is shuffled or sorted among others. Pairs of fuller cells are rows, ranked by a window.
    """
    reach = within_m / 110_000.0
    cells = round(360 / cell)
    far = F.greatest(F.abs(F.col("s_lat") - reach), F.abs(F.col("s_lat") + reach))
    wide = F.when(far >= 89, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.lit(reach) / F.cos(F.radians(far))))
    floor = lambda c: F.floor(c / cell).cast("int")
    placed = stations.select("server", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    placed = placed.withColumn("band", F.explode(F.sequence(floor(F.col("s_lat") - reach), floor(F.col("s_lat") + reach))))
    placed = placed.withColumn("at", F.explode(F.sequence(floor(F.col("s_lon") - wide), F.least(floor(F.col("s_lon") + wide), floor(F.col("s_lon") - wide) + cells - 1))))
    placed = placed.withColumn("column", F.pmod("at", F.lit(cells)))
    here = fixes.withColumns({"band": floor(F.col("lat")), "column": F.pmod(floor(F.col("lon")), F.lit(cells))})
    turned = lambda lon: lon + F.lit(360.0) * F.floor((F.col("lon") - lon) / 360.0 + 0.5)
    full = placed.groupBy("band", "column").agg(F.count("*").alias("__n")).filter(F.col("__n") > listed).select("band", "column")

    rows = here.join(placed.join(full, ["band", "column"], "left_semi"), ["band", "column"]).withColumn("s_lon", turned(F.col("s_lon")))
    rows = rows.withColumn("distance", distance("lat", "lon", "s_lat", "s_lon")).filter(F.col("distance") <= within_m)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("distance", "server"))).filter(F.col("rank") <= most)

    lists = placed.join(full, ["band", "column"], "left_anti").groupBy("band", "column").agg(F.collect_list(F.struct("server", "s_lat", "s_lon")).alias("__stations"))
    far = lambda s: F.struct(distance(F.col("lat"), F.col("lon"), s["s_lat"], turned(s["s_lon"])).alias("distance"), s["server"].alias("server"))
    nearest = F.slice(F.array_sort(F.filter(F.transform("__stations", far), lambda s: s["distance"] <= within_m)), 1, most)
    ranked = here.join(lists, ["band", "column"]).select(*fixes.columns, F.posexplode(nearest).alias("__k", "__s"))
    out = ranked.select(*fixes.columns, "__s.server", "__s.distance", (F.col("__k") + 1).alias("rank"))
    return out.unionByName(rows.select(*out.columns))


def never_used(sats: DataFrame, by: tuple[str, ...] = ("device", "prn")) -> DataFrame:
    """Satellites seen but never used."""
    return sats.select(*by).distinct().join(sats.filter("used").select(*by).distinct(), list(by), "left_anti")


def without(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("device", "time")) -> DataFrame:
    """Epochs of the left that the right lacks."""
    return left.join(right.select(*by).distinct(), list(by), "left_anti")


def with_any(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("device", "time")) -> DataFrame:
    return left.join(right.select(*by).distinct(), list(by), "left_semi")


def timeline(*tables: DataFrame) -> DataFrame:
    """Reports of all classes in one table, absent columns null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with their multiplicity) that only one of two tables has; side tells which."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
