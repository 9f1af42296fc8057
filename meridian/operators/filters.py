"""Projections, filters and predicates on report tables. Null comparisons drop rows, as in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions import geo
from meridian.functions.gpstime import isotime

#: Fixed values. Default fields of the classes.
DEFAULT_FIELDS = {
    "TPV": ("time", "lat", "lon", "altHAE"),
    "SKY": ("time", "nSat", "uSat", "gdop", "hdop", "pdop", "vdop"),
    "GST": ("time", "rms", "major", "minor", "orient", "lat", "lon", "alt"),
    "ATT": ("time", "heading", "pitch", "roll"),
    "PPS": ("real_sec", "real_nsec", "clock_sec", "clock_nsec", "precision"),
    "TOFF": ("real_sec", "real_nsec", "clock_sec", "clock_nsec"),
}
MAX_SPEED, NO_ECEF = 9999.9, 10.0


def watch(df: DataFrame, device: str | None = None, classes: tuple[str, ...] | None = None) -> DataFrame:
    """Reports of a device (empty: all) and of classes."""
    if device:
        df = df.filter(F.col("device") == device)
    return df.filter(F.col("class").isin(*classes)) if classes else df


def types(df: DataFrame, wanted: tuple[int, ...]) -> DataFrame:
    """Of AIS and RTCM reports the wanted message types; other classes pass."""
    return df.filter(~F.col("class").isin("AIS", "RTCM2", "RTCM3") | F.col("type").isin(*wanted))


def unsplit24(df: DataFrame, split24: bool = False) -> DataFrame:
    """Hides unmatched halves of type 24 unless split24."""
    return df if split24 else df.filter((F.col("type") != 24) | (F.col("part") == "both"))


def with_fix(df: DataFrame, min_mode: int = 2) -> DataFrame:
    return df.filter(F.col("mode") >= min_mode)


def skip_warmup(df: DataFrame, cycle: float = 1.0, threshold_cycles: int = 30, time: str = "time") -> DataFrame:
    """Drops what a device reported within cycle * threshold_cycles seconds of its first report."""
    starts = df.groupBy("device").agg(F.min(time).alias("__start"))  # pre-aggregated: a busy device doesn't meet in one task
    late = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("__start").cast("timestamp")) >= F.lit(int(cycle * threshold_cycles * 1e6))
    return df.join(starts, "device").filter(late).select(*df.columns)


def constellations(obs: DataFrame, gnssids: tuple[int, ...]) -> DataFrame:
    """Observations of the chosen systems, never of IMES."""
    return obs.filter(F.col("gnssid").isin(*gnssids) & (F.col("gnssid") != 4))


def limit_count(df: DataFrame, n: int, time: str = "time", tie: str = "line_no") -> DataFrame:
    return df.orderBy(time, tie).limit(n)


def limit_seconds(df: DataFrame, seconds: float, time: str = "time") -> DataFrame:
    """Reports within seconds of the first one of all."""
    first = df.agg(F.min(time).alias("__first"))
    return df.crossJoin(F.broadcast(first)).filter(F.col(time) < F.col("__first") + F.expr(f"interval {seconds} seconds")).drop("__first")  # one row


def select_fields(df: DataFrame, fields=None, class_: str | None = None) -> DataFrame:
    """The fields asked for; or the class's defaults; or else all that aren't nested. Unknown ones become null."""
    if fields is None and class_:
        fields = DEFAULT_FIELDS[class_]
    if fields is None:
        fields = [f.name for f in df.schema if not isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType)]
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def sanitize_fix(df: DataFrame) -> DataFrame:
    """Impossible values become null: positions out of range or halved, a zero ECEF vector, overlarge speeds."""
    have = set(df.columns)
    out = df
    if {"lat", "lon"} <= have:
        good = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
        out = out.withColumns({"lat": F.when(good, F.col("lat")), "lon": F.when(good, F.col("lon"))})
    for triple in (("ecefx", "ecefy", "ecefz"),):
        if set(triple) <= have:
            near = sum((F.abs(F.coalesce(c, F.lit(0.0))) for c in triple), F.lit(0.0)) <= NO_ECEF
            out = out.withColumns({c: F.when(~near, F.col(c)) for c in triple})
    return out.withColumns({c: F.when(F.abs(c) <= MAX_SPEED, F.col(c)) for c in ("speed", "climb", "velN", "velE", "velD") if c in have})


def empty_sky(sky: DataFrame, file: str = "file") -> DataFrame:
    """Per file and in all (null file): skyviews, and those without satellites."""
    return sky.rollup(file).agg(F.count("*").alias("total"), F.count(F.when(F.coalesce("nSat", F.lit(0)) == 0, 1)).alias("bad"))


def dense_sky(sky: DataFrame, min_used: int = 10, max_prn: int = 32) -> DataFrame:
    """Skyviews with enough used satellites, with lists of the tracked and the used ones."""
    low = F.filter("satellites", lambda s: s["PRN"] <= max_prn)
    out = sky.withColumn("tracked", F.transform(F.filter(low, lambda s: s["ss"] > 0), lambda s: s["PRN"])).withColumn("in_use", F.transform(F.filter(low, lambda s: s["used"]), lambda s: s["PRN"]))
    return out.filter(F.size("in_use") >= min_used)


def usable_los() -> Column:
    """Whether a satellite row can give a line of sight."""
    return F.col("used") & (F.col("PRN") >= 1) & F.col("az").between(0, 359) & (F.abs("el") <= 90)


def valid_measurements(obs: DataFrame) -> DataFrame:
    """Measurements of real satellites; an impossible pseudorange becomes null."""
    out = obs.filter(~F.col("svid").isin(0, 255))
    return out.withColumn("pseudorange", F.when(~F.isnan("pseudorange") & (F.col("pseudorange") > 1), F.col("pseudorange")))


def route(lines: DataFrame, tpv_only: bool = False, ais_only: bool = False, value: str = "value") -> DataFrame:
    """Report lines ({...) or vessel sentences (!...), told apart by their first character."""
    if tpv_only:
        lines = lines.filter(F.col(value).startswith("{"))
    return lines.filter(F.col(value).startswith("!")) if ais_only else lines


def timestamp_lines(lines: DataFrame, form: str = "yyyy-MM-dd HH:mm:ss", value: str = "value") -> DataFrame:
    return lines.withColumn(value, F.concat(F.date_format(F.current_timestamp(), form), F.lit(": "), F.col(value)))


def convert_units(df: DataFrame, system: str) -> DataFrame:
    """Altitudes and speeds in imperial, nautical or metric units."""
    length, speed = {"imperial": ("ft", "mph"), "nautical": ("ft", "knots"), "metric": (None, "kph")}[system]
    units = {c: length for c in ("altHAE", "altMSL", "epv", "eph", "depth") if length} | {c: speed for c in ("speed", "climb", "eps", "epc")}
    return df.withColumns({c: geo.convert(c, u) for c, u in units.items() if c in df.columns})


def warn_malformed(lines: DataFrame) -> DataFrame:
    """What a report reader would put into quarantine, with why."""
    return lines.withColumn("why", F.when(~F.col("value").startswith("{"), "not a report").when(F.get_json_object("value", "$.class").isNull(), "no class")).filter("why is not null")


def csv_time(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn(time, isotime(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)))


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
