"""Geodesy on WGS84. Degrees and metres unless said otherwise; null in, null out."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84 semi-axes and first eccentricity squared, and units in metres or metres a second.
WGS84_A = 6378137.0
WGS84_B = 6356752.314245
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
METERS_TO_FEET = 1 / 0.3048
MPS_TO_MPH = 1 / 0.44704
MPS_TO_KNOTS = 1 / 0.514444444
MPS_TO_KPH = 3.6
KNOTS_TO_MPS = 0.514444444


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def meters_per_degree(lat) -> Column:
    """Length of a degree of latitude at lat."""
    phi = F.radians(_c(lat))
    return F.lit(111132.954) - F.lit(559.822) * F.cos(F.lit(2.0) * phi) + F.lit(1.175) * F.cos(F.lit(4.0) * phi)


def earth_distance_small(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance: right to about 1 % up to a few hundred kilometres. Closed form, stays in the JVM."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    middle = (lat1 + lat2) / F.lit(2.0)
    dy, dx = lat2 - lat1, (lon2 - lon1) * F.cos(F.radians(middle))
    return meters_per_degree(middle) * F.sqrt(dy * dy + dx * dx)


def vincenty(lat1, lon1, lat2, lon2, limit=200):
    """(distance, initial bearing, final bearing) of arrays; NaN where the iteration doesn't settle."""
    phi1, phi2 = np.radians(lat1), np.radians(lat2)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(phi1)), np.arctan((1 - WGS84_F) * np.tan(phi2))
    span = np.radians(lon2 - lon1)
    lam = span.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    settled = np.zeros(len(lam), bool)
    with np.errstate(all="ignore"):
        for _ in range(limit):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, c1 * c2 * sl / ss)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 == 0, 0, cs - 2 * s1 * s2 / ca2)
            k = WGS84_F / 16 * ca2 * (4 + WGS84_F * (4 - 3 * ca2))
            new = span + (1 - k) * WGS84_F * sa * (sigma + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        w = ca2 * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
        a = 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768))
        b = w / 1024 * (256 + w * (w * (74 - 47 * w) - 128))
        d = b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        distance = WGS84_B * a * (sigma - d)
        first = np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
        last = np.arctan2(c1 * np.sin(lam), c1 * s2 * np.cos(lam) - s1 * c2)
    same = (lat1 == lat2) & (lon1 == lon2)
    distance = np.where(same, 0.0, np.where(settled, distance, np.nan))
    return distance, np.where(settled | same, first, np.nan), np.where(settled | same, last, np.nan)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def inverse(lat1, lon1, lat2, lon2, rounds: int = 60) -> Column:
    """Struct of distance (m) and initial and final bearing (radians) by Vincenty's inverse; null where rounds rounds don't
    settle the longitude (next to antipodes). Stays in the JVM: a fold over rounds that ends once it is settled."""
    x = F.lit
    one = lambda c: x(1.0) - c
    reduced = lambda lat: F.atan(x(1 - WGS84_F) * F.tan(F.radians(lat)))

    def sides(p, lam):
        """What depends on the longitude difference on the sphere."""
        across, along = p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)
        return _struct(ss=F.sqrt(across * across + along * along), cs=p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam), sl=F.sin(lam))

    def angles(p, t):
        sa = F.when(t["ss"] == 0, 0.0).otherwise(p["c1"] * p["c2"] * t["sl"] / t["ss"])
        return let(sa, lambda sa: _struct(ss=t["ss"], cs=t["cs"], sigma=F.atan2(t["ss"], t["cs"]), sa=sa, ca2=one(sa * sa), cm=F.when(sa * sa == 1, 0.0).otherwise(t["cs"] - x(2.0) * p["s1"] * p["s2"] / one(sa * sa))))

    def terms(p, lam):
        return let(sides(p, lam), lambda t: angles(p, t))

    def step(p, state):
        def longitude(t):
            k = x(WGS84_F / 16) * t["ca2"] * (x(4.0) + x(WGS84_F) * (x(4.0) - x(3.0) * t["ca2"]))
            return let(k, lambda k: p["span"] + one(k) * x(WGS84_F) * t["sa"] * (t["sigma"] + k * t["ss"] * (t["cm"] + k * t["cs"] * (x(2.0) * t["cm"] * t["cm"] - 1))))

        new = let(terms(p, state["lam"]), longitude)
        return F.when(state["done"], state).otherwise(let(new, lambda n: _struct(lam=n, done=F.coalesce(F.abs(n - state["lam"]) < 1e-12, F.lit(False)))))

    def length(t):
        w = t["ca2"] * x((WGS84_A**2 - WGS84_B**2) / WGS84_B**2)
        big = lambda w: x(1.0) + w / 16384 * (x(4096.0) + w * (x(-768.0) + w * (x(320.0) - x(175.0) * w)))
        small = lambda w: w / 1024 * (x(256.0) + w * (x(-128.0) + w * (x(74.0) - x(47.0) * w)))
        square = x(2.0) * t["cm"] * t["cm"] - 1
        less = lambda b: b * t["ss"] * (t["cm"] + b / 4 * (t["cs"] * square - b / 6 * t["cm"] * (x(4.0) * t["ss"] * t["ss"] - 3) * (x(4.0) * t["cm"] * t["cm"] - 3)))
        return let(w, lambda w: x(WGS84_B) * big(w) * (t["sigma"] - let(small(w), less)))

    def result(p, state):
        lam, same = state["lam"], p["same"]
        first = F.atan2(p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam))
        last = F.atan2(p["c1"] * F.sin(lam), p["c1"] * p["s2"] * F.cos(lam) - p["s1"] * p["c2"])
        settled = state["done"] | same
        distance = F.when(same, 0.0).when(state["done"], let(terms(p, lam), length))
        return _struct(distance=distance, bearing_initial=F.when(settled, first), bearing_final=F.when(settled, last))

    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    u1, u2 = reduced(lat1), reduced(lat2)
    given = _struct(s1=F.sin(u1), c1=F.cos(u1), s2=F.sin(u2), c2=F.cos(u2), span=F.radians(lon2 - lon1), same=(lat1 == lat2) & (lon1 == lon2))
    start = lambda p: _struct(lam=p["span"], done=F.lit(False))
    fold = lambda p: F.aggregate(F.sequence(x(1), x(rounds)), start(p), lambda state, _: step(p, state))
    return let(given, lambda p: let(fold(p), lambda state: result(p, state)))


def with_inverse(df: DataFrame, lat1, lon1, lat2, lon2, into: str = "inverse", rounds: int = 6) -> DataFrame:
    """Adds inverse() as a column, with its first rounds as projections that Spark compiles, some ten times faster. Rows
    that they don't settle, few but for near antipodes, go on with the fold."""
    x = F.lit
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    u1, u2 = (F.atan(x(1 - WGS84_F) * F.tan(F.radians(lat))) for lat in (lat1, lat2))
    kept = df.columns
    df = df.withColumns({"__s1": F.sin(u1), "__c1": F.cos(u1), "__s2": F.sin(u2), "__c2": F.cos(u2), "__span": F.radians(lon2 - lon1)}).withColumns({"__lam": F.col("__span"), "__last": x(None).cast("double")})
    s1, c1, s2, c2, lam = (F.col(f"__{n}") for n in ("s1", "c1", "s2", "c2", "lam"))
    across, along = c2 * F.sin(lam), c1 * s2 - s1 * c2 * F.cos(lam)
    ss, cs = F.sqrt(across * across + along * along), s1 * s2 + c1 * c2 * F.cos(lam)
    sigma, sa = F.atan2(ss, cs), F.when(ss == 0, 0.0).otherwise(c1 * c2 * F.sin(lam) / ss)
    ca2 = x(1.0) - sa * sa
    cm = F.when(ca2 == 0, 0.0).otherwise(cs - x(2.0) * s1 * s2 / ca2)
    k = x(WGS84_F / 16) * ca2 * (x(4.0) + x(WGS84_F) * (x(4.0) - x(3.0) * ca2))
    new = F.col("__span") + (x(1.0) - k) * x(WGS84_F) * sa * (sigma + k * ss * (cm + k * cs * (x(2.0) * cm * cm - 1)))
    for _ in range(rounds):
        df = df.withColumns({"__lam": new, "__last": lam})
    df = df.withColumns({"__ss": ss, "__cs": cs, "__sigma": sigma, "__ca2": ca2, "__cm": cm})
    ss, cs, sigma, ca2, cm = (F.col(f"__{n}") for n in ("ss", "cs", "sigma", "ca2", "cm"))
    w = ca2 * x((WGS84_A**2 - WGS84_B**2) / WGS84_B**2)
    big = x(1.0) + w / 16384 * (x(4096.0) + w * (x(-768.0) + w * (x(320.0) - x(175.0) * w)))
    small = w / 1024 * (x(256.0) + w * (x(-128.0) + w * (x(74.0) - x(47.0) * w)))
    square = x(2.0) * cm * cm - 1
    less = small * ss * (cm + small / 4 * (cs * square - small / 6 * cm * (x(4.0) * ss * ss - 3) * (x(4.0) * cm * cm - 3)))
    same = (lat1 == lat2) & (lon1 == lon2)
    own = _struct(distance=F.when(same, 0.0).otherwise(x(WGS84_B) * big * (sigma - less)), bearing_initial=F.atan2(across, along), bearing_final=F.atan2(c1 * F.sin(lam), c1 * s2 * F.cos(lam) - s1 * c2))
    settled = same | (F.abs(lam - F.col("__last")) < 1e-12)
    return df.select(*kept, F.when(settled, own).when(lam.isNotNull(), inverse(lat1, lon1, lat2, lon2)).alias(into))


def earth_distance(lat1, lon1, lat2, lon2) -> Column:
    """Vincenty distance; where it doesn't converge (near antipodes) the equirectangular one."""
    return F.coalesce(inverse(lat1, lon1, lat2, lon2)["distance"], earth_distance_small(lat1, lon1, lat2, lon2))


def bearing_initial(lat1, lon1, lat2, lon2) -> Column:
    return inverse(lat1, lon1, lat2, lon2)["bearing_initial"]


def bearing_final(lat1, lon1, lat2, lon2) -> Column:
    return inverse(lat1, lon1, lat2, lon2)["bearing_final"]


def meter_offset(lat1, lon1, lat2, lon2, distance=earth_distance_small) -> tuple[Column, Column]:
    """(east, north) offset in metres of point 1 from point 2: negative where point 1 lies west or south."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dx, dy = distance(lat1, lon1, lat1, lon2), distance(lat1, lon1, lat2, lon1)
    return F.when(lon1 < lon2, -dx).otherwise(dx), F.when(lat1 < lat2, -dy).otherwise(dy)


def lla2ecef(lat, lon, alt) -> tuple[Column, Column, Column]:
    phi, lam, alt = F.radians(_c(lat)), F.radians(_c(lon)), _c(alt)
    n = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(WGS84_E2) * F.sin(phi) * F.sin(phi))
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * F.lit(1 - WGS84_E2) + alt) * F.sin(phi)


def ecef2lla(x, y, z) -> tuple[Column, Column, Column]:
    """Bowring's closed form."""
    x, y, z = map(_c, (x, y, z))
    ep2 = (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * F.lit(WGS84_A), p * F.lit(WGS84_B))
    phi = F.atan2(z + F.lit(ep2 * WGS84_B) * F.pow(F.sin(theta), 3), p - F.lit(WGS84_E2 * WGS84_A) * F.pow(F.cos(theta), 3))
    n = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(WGS84_E2) * F.sin(phi) * F.sin(phi))
    polar = F.abs(z) - F.lit(WGS84_B)
    return F.degrees(phi), F.degrees(F.atan2(y, x)), F.when(p < 1e-6, polar).otherwise(p / F.cos(phi) - n)


def ecef2enu(dx, dy, dz, lat, lon) -> tuple[Column, Column, Column]:
    """East, north, up of an ECEF difference seen from (lat, lon)."""
    dx, dy, dz = map(_c, (dx, dy, dz))
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    east = -F.sin(lam) * dx + F.cos(lam) * dy
    north = -F.sin(phi) * F.cos(lam) * dx - F.sin(phi) * F.sin(lam) * dy + F.cos(phi) * dz
    up = F.cos(phi) * F.cos(lam) * dx + F.cos(phi) * F.sin(lam) * dy + F.sin(phi) * dz
    return east, north, up


def enu2aer(east, north, up) -> tuple[Column, Column, Column]:
    """Azimuth (0 to 360), elevation and range."""
    east, north, up = map(_c, (east, north, up))
    flat = F.sqrt(east * east + north * north)
    return norm_deg(F.degrees(F.atan2(east, north))), F.degrees(F.atan2(up, flat)), F.sqrt(east * east + north * north + up * up)


def ecef2aer(x, y, z, lat, lon, alt) -> tuple[Column, Column, Column]:
    """Look angles from an observer at (lat, lon, alt) to the ECEF point."""
    ox, oy, oz = lla2ecef(lat, lon, alt)
    return enu2aer(*ecef2enu(_c(x) - ox, _c(y) - oy, _c(z) - oz, lat, lon))


def ecef_velocity_to_ned(vx, vy, vz, lat, lon) -> tuple[Column, Column, Column]:
    east, north, up = ecef2enu(vx, vy, vz, lat, lon)
    return north, east, -up


def radius_of_curvature(lat) -> Column:
    """Radius of curvature in the plane of the meridian."""
    s = F.sin(F.radians(_c(lat)))
    return F.lit(WGS84_A * (1 - WGS84_E2)) / F.pow(F.lit(1.0) - F.lit(WGS84_E2) * s * s, F.lit(1.5))


def dist_2d(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def dist_3d(x1, y1, z1, x2, y2, z2) -> Column:
    x1, y1, z1, x2, y2, z2 = map(_c, (x1, y1, z1, x2, y2, z2))
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2))


def norm_deg(x) -> Column:
    """The angle in [0, 360)."""
    return F.pmod(_c(x), F.lit(360.0))


def grid_value(df: DataFrame, grid: DataFrame, lat: str, lon: str, out: str, scale: float) -> DataFrame:
    """Adds out: bilinear interpolation in a grid of 5 degree cells (i: row from -90, j: column from -180, value).

    The grid, 37 by 73 points, is a parameter: of geoid separations (cm, scale 0.01) or of magnetic variations
    (0.01 degrees, scale 0.01). Its size is checked before it is broadcast.
    """
    corners = grid.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("of_row")).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("i", "of_row"))).alias("__grid"))
    y, x = (F.col(lat) + 90.0) / 5.0, (F.col(lon) + 180.0) / 5.0
    i, j = F.least(F.floor(y), F.lit(35)).cast("int"), F.least(F.floor(x), F.lit(71)).cast("int")
    at = lambda a, b: F.col("__grid")[a][b]
    u, v = y - i, x - j
    value = (1 - u) * (1 - v) * at(i, j) + (1 - u) * v * at(i, j + 1) + u * (1 - v) * at(i + 1, j) + u * v * at(i + 1, j + 1)
    inside = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    return df.crossJoin(corners).withColumn(out, F.when(inside, value * scale)).drop("__grid")  # one row


def geoid_separation(df: DataFrame, grid: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "geoidSep") -> DataFrame:
    return grid_value(df, grid, lat, lon, out, 0.01)


def mag_var(df: DataFrame, grid: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "magvar") -> DataFrame:
    return grid_value(df, grid, lat, lon, out, 0.01)


def maidenhead(lat, lon) -> Column:
    """Ten-character locator; the poles and the date line are pulled in."""
    x = F.when(_c(lon) >= 180, F.lit(179.99999)).otherwise(_c(lon)) + F.lit(180.0)
    y = F.when(_c(lat) >= 90, F.lit(89.99999)).otherwise(_c(lat)) + F.lit(90.0)
    letter = lambda k, base: F.char(k + F.lit(ord(base)))
    parts = []
    cell_x, cell_y = 20.0, 10.0
    rest_x, rest_y = x, y
    for level, base in ((18, "A"), (10, ""), (24, "a"), (10, ""), (24, "a")):
        if parts:
            cell_x, cell_y = cell_x / level, cell_y / level
        kx, ky = F.floor(rest_x / F.lit(cell_x)), F.floor(rest_y / F.lit(cell_y))
        parts += [letter(kx, base), letter(ky, base)] if base else [kx.cast("string"), ky.cast("string")]
        rest_x, rest_y = rest_x - kx * F.lit(cell_x), rest_y - ky * F.lit(cell_y)
    return F.when(_c(lat).between(-90, 90) & _c(lon).between(-180, 180), F.concat(*parts))


def deg_to_str(form: str, deg) -> Column:
    """Degrees as dd, ddmm or ddmmss text; null outside -360..360."""
    d = F.abs(_c(deg))
    whole = F.floor(d)
    if form == "dd":
        text = F.format_string("%12.8f", d)
    elif form == "ddmm":
        minutes = F.round((d - whole) * 60, 6)
        carry = (minutes >= 60).cast("int")
        text = F.format_string("%3d %09.6f'", (whole + carry).cast("long"), minutes - carry * 60.0)
    elif form == "ddmmss":
        seconds = F.round((d - whole) * 3600, 5)
        carry = (seconds >= 3600).cast("int")
        seconds = seconds - carry * 3600.0
        minutes = F.floor(seconds / 60)
        text = F.format_string("%3d %02d' %08.5f\"", (whole + carry).cast("long"), minutes.cast("long"), seconds - minutes * 60)
    else:
        raise ValueError(f"form: {form}")
    return F.when(d <= 360, F.concat(F.when(_c(deg) < 0, F.lit("-")).otherwise(F.lit(" ")), text))


def polar_xy(az, el, radius: float) -> tuple[Column, Column]:
    """Screen position of a satellite: zenith in the middle, north up."""
    r = (F.lit(90.0) - _c(el)) / F.lit(90.0) * F.lit(float(radius))
    a = F.radians(_c(az))
    return F.lit(float(radius)) + r * F.sin(a), F.lit(float(radius)) - r * F.cos(a)


def clamp_error(err, low: float, high: float) -> tuple[Column, Column]:
    """(err within low and high, marker of where it was cut); an absent error is the highest."""
    e = _c(err)
    over, under = e.isNull() | (e >= high), e <= low
    return F.when(over, F.lit(float(high))).when(under, F.lit(float(low))).otherwise(e), F.when(over, ">").when(under, "<").otherwise("")


def convert(column, unit: str) -> Column:
    """A value in metres or metres a second in the unit: ft, mph, knots or kph."""
    factor = {"ft": METERS_TO_FEET, "mph": MPS_TO_MPH, "knots": MPS_TO_KNOTS, "kph": MPS_TO_KPH}[unit]
    return _c(column) * F.lit(factor)
