"""Fix enrichment: dilution of precision, derived positions, speeds, magnetic values and error estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators.filters import MAX_SPEED, usable_los
from meridian.operators.scan import SLICE, scan
from meridian.operators.sequence import seconds

#: Fixed values. User-equivalent range errors in metres: horizontal, vertical, position; plain and differential.
UERE_H, UERE_V, UERE_P = (15.0, 3.75), (23.0, 5.75), (19.0, 4.75)
EPT = 0.005


def inverse_diagonal(m: list[list[Column]]) -> tuple[list[Column], Column]:
    """(diagonal of the inverse, determinant) of a symmetric 4 by 4 matrix of columns, by cofactors."""

    def det3(rows: list[int], cols: list[int]) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = ([m[r][k] for k in cols] for r in rows)
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    rest = [[k for k in range(4) if k != j] for j in range(4)]
    determinant = sum(((-1) ** k * m[0][k] * det3([1, 2, 3], rest[k]) for k in range(1, 4)), m[0][0] * det3([1, 2, 3], rest[0]))
    return [det3(rest[k], rest[k]) / determinant for k in range(4)], determinant


def dop_from_sky(sats: DataFrame, by: tuple[str, ...] = ("device", "time"), singular: float = 1e-9) -> DataFrame:
    """Dilutions of precision of the usable lines of sight of an epoch: at least four, not in one plane.

    H has rows (sin az cos el, cos az cos el, sin el, 1); the ten sums of H'H are pre-aggregated, the inverse is
    a closed form of them. Other epochs give no row.
    """
    az, el = F.radians("az"), F.radians("el")
    h = [F.sin(az) * F.cos(el), F.cos(az) * F.cos(el), F.sin(el), F.lit(1.0)]
    rows = sats.filter(usable_los()).select(*by, *[c.alias(f"h{k}") for k, c in enumerate(h)])
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.col(f"h{i}") * F.col(f"h{j}")).alias(f"p{i}{j}") for i in range(4) for j in range(i, 4)])
    m = [[F.col(f"p{min(i, j)}{max(i, j)}") for j in range(4)] for i in range(4)]
    d, determinant = inverse_diagonal(m)
    out = sums.filter("n >= 4").withColumn("det", determinant).filter(F.abs("det") > singular)
    out = out.withColumns({f"d{k}": x for k, x in enumerate(d)}).filter("d0 >= 0 and d1 >= 0 and d2 >= 0 and d3 >= 0")
    root = lambda e: F.sqrt(F.expr(e))
    return out.select(
        *by, "n", root("d0").alias("xdop"), root("d1").alias("ydop"), root("d0 + d1").alias("hdop"), root("d2").alias("vdop"), root("d0 + d1 + d2").alias("pdop"), root("d3").alias("tdop"), root("d0 + d1 + d2 + d3").alias("gdop")
    )


def fill_dop(sky: DataFrame, computed: DataFrame, by: tuple[str, ...] = ("device", "time")) -> DataFrame:
    """Dilutions that the receiver didn't give, from dop_from_sky."""
    names = [c for c in ("xdop", "ydop", "hdop", "vdop", "pdop", "tdop", "gdop") if c in sky.columns]
    own = computed.select(*by, *[F.col(c).alias(f"__{c}") for c in names])
    return sky.join(own, list(by), "left").withColumns({c: F.coalesce(c, f"__{c}") for c in names}).select(*sky.columns)


def previous_fix(tpv: DataFrame, columns: tuple[str, ...], time: str = "time", order: str = "line_no", size: int = SLICE) -> DataFrame:
    """Adds old_<column> of the device's previous epoch (the last fix whose time is over 9.9 ms away) and dt."""
    rows = tpv.withColumn("__s", seconds(time))
    jump = lambda now, before: F.coalesce(F.abs(now["s"] - before["s"]) > 0.0099, F.lit(True))
    rows = scan(rows, ("device",), order, {"__before": F.struct(F.col("__s").alias("s"), *columns)}, held=("__old", "__before", jump), size=size)
    return rows.withColumns({f"old_{c}": F.col(f"__old.{c}") for c in columns} | {"dt": F.col("__s") - F.col("__old.s")}).drop("__s", "__before", "__old")


def fill_position(tpv: DataFrame) -> DataFrame:
    """Position, altitude and velocity from ECEF where missing."""
    lat, lon, alt = geo.ecef2lla("ecefx", "ecefy", "ecefz")
    out = tpv.withColumns({"lat": F.coalesce("lat", lat), "lon": F.coalesce("lon", lon), "altHAE": F.coalesce("altHAE", alt)})
    if {"ecefvx", "ecefvy", "ecefvz"} <= set(tpv.columns):
        n, e, d = geo.ecef_velocity_to_ned("ecefvx", "ecefvy", "ecefvz", "lat", "lon")
        out = out.withColumns({c: F.coalesce(c, x) if c in tpv.columns else x for c, x in (("velN", n), ("velE", e), ("velD", d))})
    return out


def fill_velocity(tpv: DataFrame) -> DataFrame:
    """Climb, speed and track from velocities north, east and down."""
    n, e, d = F.col("velN"), F.col("velE"), F.col("velD")
    return tpv.withColumns({"climb": F.coalesce("climb", -d), "speed": F.coalesce("speed", F.sqrt(n * n + e * e)), "track": F.coalesce("track", geo.norm_deg(F.degrees(F.atan2(e, n))))})


def fill_altitude(tpv: DataFrame) -> DataFrame:
    """Ellipsoidal and mean-sea-level altitude from each other, by geoidSep."""
    return tpv.withColumns({"altHAE": F.coalesce("altHAE", F.col("altMSL") + F.col("geoidSep")), "altMSL": F.coalesce("altMSL", F.col("altHAE") - F.col("geoidSep"))})


def fill_magnetic(tpv: DataFrame, model: str = "model_magvar") -> DataFrame:
    """Variation from the model where absent or next to 0, and the true or magnetic track from the other one."""
    own = F.when(F.abs("magvar") > 0.09, F.col("magvar"))
    out = tpv.withColumn("magvar", F.coalesce(own, F.col(model)))
    return out.withColumns({"track": F.coalesce("track", geo.norm_deg(F.col("magtrack") + F.col("magvar"))), "magtrack": F.coalesce("magtrack", geo.norm_deg(F.col("track") - F.col("magvar")))})


def rates_from_positions(tpv: DataFrame, distance=geo.earth_distance_small, time: str = "time", order: str = "line_no") -> DataFrame:
    """Speed and climb from the epoch before; impossible ones are null. Columns that exist are only filled."""
    rows = previous_fix(tpv, ("lat", "lon", "altHAE", "mode"), time, order)
    ok = (F.col("dt") > 0) & (F.col("mode") >= 2) & (F.col("old_mode") >= 2)
    speed = F.when(ok, distance("old_lat", "old_lon", "lat", "lon") / F.col("dt"))
    climb = F.when(ok & (F.col("mode") == 3) & (F.col("old_mode") == 3), (F.col("altHAE") - F.col("old_altHAE")) / F.col("dt"))
    new = {"speed": F.when(F.abs(speed) <= MAX_SPEED, speed), "climb": F.when(F.abs(climb) <= MAX_SPEED, climb)}
    return rows.withColumns({c: F.coalesce(c, x) if c in tpv.columns else x for c, x in new.items()})


def error_estimates(tpv: DataFrame) -> DataFrame:
    """Expected errors from the dilutions joined to the fix, by status and mode; those given stay."""
    plain = lambda uere: F.when(F.col("status") == 2, F.lit(uere[1])).otherwise(F.lit(uere[0]))
    two, three = F.col("mode") >= 2, F.col("mode") == 3
    new = {
        "epx": F.when(two, F.col("xdop") * plain(UERE_H)),
        "epy": F.when(two, F.col("ydop") * plain(UERE_H)),
        "epv": F.when(three, F.col("vdop") * plain(UERE_V)),
        "eph": F.when(two, F.col("hdop") * plain(UERE_P)),
        "sep": F.when(three, F.col("pdop") * plain(UERE_P)),
        "ept": F.when(two, F.lit(EPT)),
    }
    return tpv.withColumns({c: F.coalesce(c, x) if c in tpv.columns else x for c, x in new.items()})


def rate_errors(tpv: DataFrame, time: str = "time", order: str = "line_no") -> DataFrame:
    """Errors of speed, climb and track from those of this position and the one before; those given stay."""
    rows = previous_fix(tpv, ("lat", "lon", "epx", "epy", "epv", "mode"), time, order)
    ok = (F.col("dt") > 0) & (F.col("mode") >= 2) & (F.col("old_mode") >= 2)
    wide = F.greatest("old_epx", "old_epy") + F.greatest("epx", "epy")
    adjacent, opposite = geo.earth_distance_small("old_lat", "old_lon", "lat", "lon"), F.greatest("epx", "epy")
    hypotenuse = F.sqrt(adjacent * adjacent + opposite * opposite)
    new = {
        "eps": F.when(ok, wide / F.col("dt")),
        "epc": F.when(ok & (F.col("mode") == 3) & (F.col("old_mode") == 3), (F.col("old_epv") + F.col("epv")) / F.col("dt")),
        "epd": F.when(ok & (adjacent > opposite), F.degrees(F.lit(2.0) * F.asin(opposite / hypotenuse))),
    }
    return rows.withColumns({c: F.coalesce(c, x) if c in tpv.columns else x for c, x in new.items()})


def time_quality(tpv: DataFrame, now: Column, time: str = "time") -> DataFrame:
    """Flags times before the epoch or over a year ahead of now."""
    s = seconds(time)
    return tpv.withColumns({"negative_time": s < 0, "future_time": s > F.unix_timestamp(now) + 365 * 86400})


def sky_counts(sky: DataFrame, gga_used: str | None = None) -> DataFrame:
    """Satellites seen and used; without a list, the count that the position sentence gave."""
    used = F.size(F.filter("satellites", lambda s: s["used"]))
    fallback = F.col(gga_used) if gga_used else F.lit(None).cast("int")
    return sky.withColumns({"nSat": F.greatest(F.size("satellites"), F.lit(0)), "uSat": F.when(F.size("satellites") > 0, used).otherwise(fallback)})
