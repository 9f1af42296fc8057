"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import geo, gnss, gpstime
from meridian.operators import enrich, filters, joins, profile, sequence
from meridian.plans.views import FIX_SQL, fix_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Fragments of SQL for the oracle.
E2_LEN = "(111132.954 - 559.822 * cos(2 * radians({m})) + 1.175 * cos(4 * radians({m})))"


def e2(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    m = f"(({lat1} + {lat2}) / 2e0)"
    return f"({E2_LEN.format(m=m)} * sqrt(pow({lat2} - {lat1}, 2) + pow(({lon2} - {lon1}) * cos(radians({m})), 2)))"


def query(name: str, sql: str | None = None):
    """Registers a query; sql starts after the definition of fix_view."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"with {FIX_SQL}{sql}"
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, as two engines add up in different orders; a zero keeps no sign."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_fix(fix_view(spark, sf_dir), 2)


SPREAD = f""", f as (select * from fix_view where mode >= 2),
c as (select device, avg(lat) as lat_c, avg(lon) as lon_c, avg(altHAE) as alt_c from f group by device),
o as (select f.*, lat_c, lon_c, alt_c,
  case when lon_c < lon then -{e2('lat_c', 'lon_c', 'lat_c', 'lon')} else {e2('lat_c', 'lon_c', 'lat_c', 'lon')} end as dx,
  case when lat_c < lat then -{e2('lat_c', 'lon_c', 'lat', 'lon_c')} else {e2('lat_c', 'lon_c', 'lat', 'lon_c')} end as dy
  from f join c using (device))"""


@query(
    "space_profile",
    SPREAD
    + """, s as (select device, count(*) as n, first(lat_c) as lat_c, first(lon_c) as lon_c, first(alt_c) as alt_c,
  stddev_samp(dx) as x, stddev_samp(dy) as y, stddev_samp(altHAE) as z from o group by device)
select device, n, round(lat_c, 6) + 0e0 as lat_c, round(lon_c, 6) + 0e0 as lon_c, round(alt_c, 6) as alt_c,
 round(x, 6) as sigma_x, round(y, 6) as sigma_y, round(z, 6) as sigma_z, round(0.5887 * (x + y), 6) as cep,
 round(2 * sqrt(x * x + y * y), 6) as two_drms, round(0.6745 * z, 6) as hep, round(0.51 * (x + y + z), 6) as sep,
 round(sqrt(x * x + y * y + z * z), 6) as mrse from s""",
)
def space_profile(spark, sf_dir):
    return rounded(profile.space_profile(fixes(spark, sf_dir)))


@query(
    "cep_index",
    SPREAD
    + f""", r as (select device, {e2('lat', 'lon', 'lat_c', 'lon_c')} as m, count(*) over (partition by device) as n,
  row_number() over (partition by device order by sqrt(pow(lat - lat_c, 2) + pow(lon - lon_c, 2)), line_no) - 1 as k from o)
select device, count(*) as n, round(max(case when k = floor(n * 0.5) then m end), 4) as cep50,
 round(max(case when k = floor(n * 0.95) then m end), 4) as cep95, round(max(case when k = floor(n * 0.99) then m end), 4) as cep99,
 round(max(case when k = n - 1 then m end), 4) as worst from r group by device""",
)
def cep_index(spark, sf_dir):
    return rounded(profile.cep_percentiles(fixes(spark, sf_dir)), 4)


@query(
    "altitude_ep",
    SPREAD
    + """, r as (select device, abs(altHAE - alt_c) as m, count(*) over (partition by device) as n,
  row_number() over (partition by device order by abs(altHAE - alt_c), line_no) - 1 as k from o)
select device, count(*) as n, round(max(case when k = floor(n * 0.5) then m end), 6) as ep50,
 round(max(case when k = floor(n * 0.95) then m end), 6) as ep95, round(max(case when k = floor(n * 0.99) then m end), 6) as ep99,
 round(max(case when k = n - 1 then m end), 6) as worst from r group by device""",
)
def altitude_ep(spark, sf_dir):
    return rounded(profile.altitude_ep(fixes(spark, sf_dir)))


@query("cep_approx")
def cep_approx(spark, sf_dir):
    return profile.cep_approx(fixes(spark, sf_dir))


A, E2_, B = geo.WGS84_A, geo.WGS84_E2, geo.WGS84_B
ECEF = f""", r as (select *, radians(lat) as phi, radians(lon) as lam from fix_view),
p as (select *, {A!r} / sqrt(1 - {E2_!r} * sin(phi) * sin(phi)) as nu from r),
x as (select *, (nu + altHAE) * cos(phi) * cos(lam) as x, (nu + altHAE) * cos(phi) * sin(lam) as y, (nu * {1 - E2_!r} + altHAE) * sin(phi) as z from p)"""


@query("max_3d", ECEF + """, f as (select * from x where mode >= 2), c as (select device, avg(x) as cx, avg(y) as cy, avg(z) as cz from f group by device)
select device, round(max(sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))), 4) as max_3d from f join c using (device) group by device""")
def max_3d(spark, sf_dir):
    return rounded(profile.max_3d(fixes(spark, sf_dir)), 4)


@query("ecef", ECEF + " select line_no, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from x")
def ecef(spark, sf_dir):
    x, y, z = geo.lla2ecef("lat", "lon", "altHAE")
    return rounded(fix_view(spark, sf_dir).select("line_no", x.alias("x"), y.alias("y"), z.alias("z")), 4)


@query("ecef_roundtrip", " select line_no, round(lat, 7) as lat, round(lon, 7) as lon, round(altHAE, 3) as alt from fix_view")
def ecef_roundtrip(spark, sf_dir):
    x, y, z = geo.lla2ecef("lat", "lon", "altHAE")
    there = fix_view(spark, sf_dir).select("line_no", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, alt = geo.ecef2lla("x", "y", "z")
    return there.select("line_no", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round(alt, 3).alias("alt"))


@query(
    "look_angles",
    ECEF
    + f""", o as (select radians(45e0) as p0, radians(7e0) as l0, {A!r} / sqrt(1 - {E2_!r} * sin(radians(45e0)) * sin(radians(45e0))) as n0),
d as (select x.*, p0, l0, x - (n0 + 300) * cos(p0) * cos(l0) as dx, y - (n0 + 300) * cos(p0) * sin(l0) as dy, z - (n0 * {1 - E2_!r} + 300) * sin(p0) as dz from x cross join o),
n as (select line_no, -sin(l0) * dx + cos(l0) * dy as e, -sin(p0) * cos(l0) * dx - sin(p0) * sin(l0) * dy + cos(p0) * dz as n,
  cos(p0) * cos(l0) * dx + cos(p0) * sin(l0) * dy + sin(p0) * dz as u from d)
select line_no, round(((degrees(atan2(e, n)) % 360e0) + 360e0) % 360e0, 4) as az, round(degrees(atan2(u, sqrt(e * e + n * n))), 4) as el, round(sqrt(e * e + n * n + u * u), 3) as range from n""",
)
def look_angles(spark, sf_dir):
    x, y, z = geo.lla2ecef("lat", "lon", "altHAE")
    az, el, distance = geo.ecef2aer(x, y, z, 45.0, 7.0, 300.0)
    return fix_view(spark, sf_dir).select("line_no", F.round(az, 4).alias("az"), F.round(el, 4).alias("el"), F.round(distance, 3).alias("range"))


#: The definition in two passes: means first, then powers of the differences.
MOMENTS = """, v as (select device, {x} as x from fix_view), m as (select device, count(x)::double as n, min(x) as lo, max(x) as hi, avg(x) as mean, stddev_samp(x) as s from v group by device),
q as (select *, {at} as a from m), p as (select device, sum(pow(x - a, 3)) as p3, sum(pow(x - a, 4)) as p4 from v join q using (device) group by device)
select device, n::bigint as n, round(lo, 6) as min, round(hi, 6) as max, round(mean, 6) as mean, round(s, 6) as sigma,
 round(case when s > 0.0001 then p3 / (n * s * s * s) end, {digits}) as skewness, round(case when s > 0.0001 then p4 / (n * s * s * s * s) end, {digits}) as kurtosis from q join p using (device)"""


def _stats(df: DataFrame, x: str, kind: str = "standard", digits: int = 6) -> DataFrame:
    out = profile.stats_1d(df, x, ("device",), kind).withColumns({c: F.round(c, digits) for c in ("skewness", "kurtosis")})
    return rounded(out, 6)


@query("stats_standard_moments", MOMENTS.format(x="value", at="mean", digits=6))
def stats_standard_moments(spark, sf_dir):
    return _stats(fix_view(spark, sf_dir), "value")


@query("stats_reference_moments", MOMENTS.format(x="value", at="s", digits=6))
def stats_reference_moments(spark, sf_dir):
    return _stats(fix_view(spark, sf_dir), "value", "reference")


@query("stats_latitude", MOMENTS.format(x="lat", at="mean", digits=5))
def stats_latitude(spark, sf_dir):
    """Moments of a column that is large against its spread."""
    return _stats(fix_view(spark, sf_dir), "lat", digits=5)


@query("stats_offsets", MOMENTS.format(x="(2000000 + value * 100)", at="mean", digits=5))
def stats_offsets(spark, sf_dir):
    """Moments of clock offsets in nanoseconds."""
    return _stats(fix_view(spark, sf_dir).withColumn("offset", 2000000 + F.col("value") * 100), "offset", digits=5)


@query("used_stats", """, u as (select device, count(*) filter (used) as u from fix_view group by device, time::date)
select device, count(*) as n, min(u)::double as min, max(u)::double as max, round(avg(u), 6) as mean, round(stddev_samp(u), 6) as sigma from u where u > 0 group by device""")
def used_stats(spark, sf_dir):
    sky = fix_view(spark, sf_dir).groupBy("device", F.to_date("time").alias("day")).agg(F.count(F.when(F.col("used"), 1)).alias("uSat"))
    return rounded(profile.stats_1d(sky.filter("uSat > 0"), "uSat", ("device",)).drop("skewness", "kurtosis"))


for _which, _point in (("all", "true"), ("used", "used"), ("unused", "not used")):

    @query(
        f"signal_profile_{_which}",
        f""" select device, count(*) as seen, count(*) filter (used) as used, count(*) filter ({_point}) as points, round(min(ss) filter ({_point}), 6) as ss_min,
 round(max(ss) filter ({_point}), 6) as ss_max, round(avg(ss) filter ({_point}), 6) as ss_mean, round(stddev_samp(ss) filter ({_point}), 6) as ss_sigma from fix_view group by device""",
    )
    def _signal(spark, sf_dir, which=_which):
        return rounded(profile.signal_profile(fix_view(spark, sf_dir), which))


@query("sky_grid", " select (az // 10 * 10)::bigint as az, (el // 5 * 5)::bigint as el, round(avg(ss), 6) as ss, count(*) as n from fix_view group by 1, 2")
def sky_grid(spark, sf_dir):
    return rounded(profile.sky_grid(fix_view(spark, sf_dir)))


@query("snr_avg_used", " select device, time::date as day, round(coalesce(avg(ss) filter (used), 0e0), 6) as snr_avg from fix_view group by 1, 2")
def snr_avg_used(spark, sf_dir):
    return rounded(profile.snr_avg_used(fix_view(spark, sf_dir).withColumn("day", F.to_date("time")), ("device", "day")))


@query(
    "track_segments",
    """, f as (select *, epoch_us(time) as t, lag(epoch_us(time)) over (partition by device order by line_no) as b from fix_view where mode >= 2),
g as (select *, lag(t) over (partition by device order by line_no) as p from f where b is null or t <> b),
s as (select *, sum(case when p is null or abs(t - p) // 1000000 > 21600 then 1 else 0 end) over (partition by device order by line_no rows between unbounded preceding and current row) as track_id from g)
select device, track_id::bigint as track_id, count(*) as n, min(line_no) as first_line, max(line_no) as last_line from s group by 1, 2""",
)
def track_segments(spark, sf_dir):
    tracks = sequence.segment_tracks(fix_view(spark, sf_dir), 21600)
    return tracks.groupBy("device", "track_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query(
    "fix_streak",
    """, i as (select *, sum(case when mode >= 2 then 0 else 1 end) over (partition by device order by line_no) as island from fix_view)
select line_no, device, sum(case when mode >= 2 then 1 else 0 end) over (partition by device, island order by line_no)::bigint as streak from i""",
)
def fix_streak(spark, sf_dir):
    return sequence.fix_streak(fix_view(spark, sf_dir), F.col("mode") >= 2).select("line_no", "device", "streak")


PREVIOUS = """, s as (select *, epoch_us(time) / 1e6 as s, {xp} from fix_view),
l as (select *, lag(s) over w as ls, lag(lat) over w as llat, lag(lon) over w as llon, lag(altHAE) over w as lalt, lag(mode) over w as lmode from s window w as (partition by device order by line_no)),
j as (select *, ls is null or abs(s - ls) > 0.0099 as jump from l),
i as (select *, sum(case when jump then 1 else 0 end) over (partition by device order by line_no) as epoch from j),
o as (select *, first_value(ls) over e as os, first_value(llat) over e as olat, first_value(llon) over e as olon, first_value(lalt) over e as oalt, first_value(lmode) over e as omode
  from i window e as (partition by device, epoch order by line_no)),
d as (select *, s - os as dt from o)"""


@query(
    "rates_from_positions",
    PREVIOUS.format(xp="1 as one")
    + f""", v as (select line_no, case when dt > 0 and mode >= 2 and omode >= 2 then {e2('olat', 'olon', 'lat', 'lon')} / dt end as speed,
  case when dt > 0 and mode = 3 and omode = 3 then (altHAE - oalt) / dt end as climb from d)
select line_no, round(case when abs(speed) <= 9999.9 then speed end, 6) as speed, round(case when abs(climb) <= 9999.9 then climb end, 6) + 0e0 as climb from v""",
)
def rates_from_positions(spark, sf_dir):
    return rounded(enrich.rates_from_positions(fix_view(spark, sf_dir)).select("line_no", "speed", "climb"))


DOPS = ", e as (select *, 0.5 + (line_no % 13) / 10e0 as xdop, 0.6 + (line_no % 11) / 10e0 as ydop, 0.9 + (line_no % 17) / 10e0 as vdop from fix_view)"


def with_dops(df: DataFrame) -> DataFrame:
    x, y, v = (F.lit(a) + F.expr(f"line_no % {b}") / F.lit(10.0) for a, b in ((0.5, 13), (0.6, 11), (0.9, 17)))
    h = F.sqrt(F.col("xdop") * F.col("xdop") + F.col("ydop") * F.col("ydop"))
    p = F.sqrt(F.col("hdop") * F.col("hdop") + F.col("vdop") * F.col("vdop"))
    return df.withColumns({"xdop": x, "ydop": y, "vdop": v}).withColumn("hdop", h).withColumn("pdop", p)


@query(
    "error_estimates",
    DOPS
    + """, h as (select *, sqrt(xdop * xdop + ydop * ydop) as hdop from e), p as (select *, sqrt(hdop * hdop + vdop * vdop) as pdop from h)
select line_no, round(case when mode >= 2 then xdop * case status when 2 then 3.75 else 15 end end, 6) as epx, round(case when mode >= 2 then ydop * case status when 2 then 3.75 else 15 end end, 6) as epy,
 round(case when mode = 3 then vdop * case status when 2 then 5.75 else 23 end end, 6) as epv, round(case when mode >= 2 then hdop * case status when 2 then 4.75 else 19 end end, 6) as eph,
 round(case when mode = 3 then pdop * case status when 2 then 4.75 else 19 end end, 6) as sep, case when mode >= 2 then 0.005e0 end as ept from p""",
)
def error_estimates(spark, sf_dir):
    return rounded(enrich.error_estimates(with_dops(fix_view(spark, sf_dir))).select("line_no", "epx", "epy", "epv", "eph", "sep", "ept"))


@query("latest_state", """, r as (select *, row_number() over (partition by device order by time desc, line_no desc) as k from fix_view)
select device, time, line_no, mode, round(lat, 6) as lat, round(lon, 6) as lon from r where k = 1""")
def latest_state(spark, sf_dir):
    return rounded(profile.latest_state(fix_view(spark, sf_dir), ("time", "line_no", "mode", "lat", "lon")))


@query(
    "asof_sky",
    """, k as (select device, time, line_no as sky_line, ss from fix_view where mode = 3), t as (select * from fix_view where mode < 3),
r as (select t.line_no, t.device, k.sky_line, k.ss, row_number() over (partition by t.line_no order by k.time desc, k.sky_line desc) as n from t left join k on k.device = t.device and k.time <= t.time)
select line_no, device, sky_line, round(ss, 6) as sky_ss from r where n = 1""",
)
def asof_sky(spark, sf_dir):
    rows = fix_view(spark, sf_dir)
    sky = rows.filter("mode = 3").select("device", "time", F.col("line_no").alias("sky_line"), F.col("ss").alias("sky_ss"))
    return rounded(sequence.asof(rows.filter("mode < 3").select("line_no", "device", "time"), sky, ("sky_line", "sky_ss")).drop("time"))


_H = {"h0": "sin(radians(az)) * cos(radians(el))", "h1": "cos(radians(az)) * cos(radians(el))", "h2": "sin(radians(el))", "h3": "1e0"}
_P = [f"sum(h{i} * h{j}) as p{i}{j}" for i in range(4) for j in range(i, 4)]


def _p(i: int, j: int) -> str:
    return f"p{min(i, j)}{max(i, j)}"


def _det3(rows: list[int], cols: list[int]) -> str:
    m = [[_p(r, c) for c in cols] for r in rows]
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_REST = [[k for k in range(4) if k != j] for j in range(4)]
_DET = " ".join(f"{'+' if k % 2 == 0 else '-'} {_p(0, k)} * {_det3([1, 2, 3], _REST[k])}" for k in range(4)).removeprefix("+ ")


@query(
    "dop",
    f""", h as (select device, time::date as day, {', '.join(f'{v} as {k}' for k, v in _H.items())} from fix_view where used and prn >= 1 and az between 0 and 359 and abs(el) <= 90),
p as (select device, day, count(*) as n, {', '.join(_P)} from h group by 1, 2),
d as (select *, {_DET} as det from p where n >= 4),
q as (select device, day, n, {', '.join(f'{_det3(_REST[k], _REST[k])} / det as d{k}' for k in range(4))} from d where abs(det) > 1e-3)
select device, day, n, round(sqrt(d0), 4) as xdop, round(sqrt(d1), 4) as ydop, round(sqrt(d0 + d1), 4) as hdop, round(sqrt(d2), 4) as vdop, round(sqrt(d0 + d1 + d2), 4) as pdop, round(sqrt(d3), 4) as tdop, round(sqrt(d0 + d1 + d2 + d3), 4) as gdop from q""",
)
def dop(spark, sf_dir):
    sats = fix_view(spark, sf_dir).withColumnRenamed("prn", "PRN").withColumn("day", F.to_date("time"))
    return rounded(enrich.dop_from_sky(sats, ("device", "day"), 1e-3), 4)


@query(
    "maidenhead",
    """, x as (select line_no, lon + 180e0 as x, lat + 90e0 as y from fix_view),
a as (select *, floor(x / 20e0) as a, floor(y / 10e0) as b from x), a2 as (select *, x - a * 20e0 as x1, y - b * 10e0 as y1 from a),
b as (select *, floor(x1 / 2e0) as c, floor(y1 / 1e0) as d from a2), b2 as (select *, x1 - c * 2e0 as x2, y1 - d * 1e0 as y2 from b),
c as (select *, floor(x2 / (2e0 / 24)) as e, floor(y2 / (1e0 / 24)) as f from b2), c2 as (select *, x2 - e * (2e0 / 24) as x3, y2 - f * (1e0 / 24) as y3 from c),
d as (select *, floor(x3 / (2e0 / 24 / 10)) as g, floor(y3 / (1e0 / 24 / 10)) as h from c2), d2 as (select *, x3 - g * (2e0 / 24 / 10) as x4, y3 - h * (1e0 / 24 / 10) as y4 from d)
select line_no, chr(65 + a::int) || chr(65 + b::int) || (c::int)::varchar || (d::int)::varchar || chr(97 + e::int) || chr(97 + f::int) || (g::int)::varchar || (h::int)::varchar
 || chr(97 + floor(x4 / (2e0 / 24 / 10 / 24))::int) || chr(97 + floor(y4 / (1e0 / 24 / 10 / 24))::int) as locator from d2""",
)
def maidenhead(spark, sf_dir):
    return fix_view(spark, sf_dir).select("line_no", geo.maidenhead("lat", "lon").alias("locator"))


@query("posix2gps", """ select line_no, (epoch_us(time) // 1000000) - 315964800 + 18 as gps, (((epoch_us(time) // 1000000) - 315964800 + 18) // 604800)::bigint as week, ((epoch_us(time) // 1000000) - 315964800 + 18) % 604800 as tow from fix_view""")
def posix2gps(spark, sf_dir):
    t = F.unix_timestamp(F.col("time").cast("timestamp"))
    gps, week, tow = gpstime.posix2gps(t, F.lit(18))
    return fix_view(spark, sf_dir).select("line_no", gps.alias("gps"), week.alias("week"), tow.alias("tow"))


@query("gps2utc_roundtrip", " select line_no, (epoch_us(time) // 1000000) as t from fix_view")
def gps2utc_roundtrip(spark, sf_dir):
    t = F.unix_timestamp(F.col("time").cast("timestamp"))
    _, week, tow = gpstime.posix2gps(t, F.lit(18))
    return fix_view(spark, sf_dir).select("line_no", gpstime.gps2utc(week % 1024, tow, F.lit(18), F.floor(week / 1024)).alias("t"))


@query("prn_range_join", """, s as (select line_no, prn * 10 as id from fix_view)
select line_no, id, case when id between 1 and 32 then 0 when id between 33 and 64 then 1 when id between 65 and 96 then 6 when id between 120 and 158 then 1 when id between 173 and 182 then 4 when id between 193 and 197 then 5 when id between 201 and 237 then 3
 when id between 301 and 356 then 2 when id between 401 and 437 then 3 when id between 500 and 509 then 7 when id between 901 and 918 then 7 end as gnssid,
 case when id between 1 and 32 then id when id between 33 and 64 then 87 + id when id between 65 and 96 then id - 64 when id between 120 and 158 then id when id between 173 and 182 then id - 172 when id between 193 and 197 then id - 192 when id between 201 and 237 then id - 200
 when id between 301 and 356 then id - 300 when id between 401 and 437 then id - 400 when id between 500 and 509 then id - 500 when id between 901 and 918 then id - 900 end as svid from s""")
def prn_range_join(spark, sf_dir):
    return joins.prn_range_join(fix_view(spark, sf_dir).select("line_no", (F.col("prn") * 10).alias("id")), "id")


@query(
    "knn_station",
    f""", s as (select n_name as server, 45 + n_nationkey / 100e0 as slat, 7 + n_nationkey / 100e0 as slon from nation),
d as (select line_no, server, {e2('lat', 'lon', 'slat', 'slon')} as m from fix_view cross join s), r as (select *, row_number() over (partition by line_no order by m, server) as rank from d where m <= 1600000)
select line_no, server, round(m, 4) as distance, rank::int as rank from r where rank <= 12""",
)
def knn_station(spark, sf_dir):
    place = [(F.lit(float(base)) + F.col("n_nationkey") / F.lit(100.0)).alias(c) for base, c in ((45, "lat"), (7, "lon"))]
    stations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("server"), *place)
    near = joins.nearest_stations(fix_view(spark, sf_dir).select("line_no", "lat", "lon"), stations)
    return rounded(near.select("line_no", "server", "distance", "rank"), 4)


@query("class_histogram", " select event_type, mode, count(*) as n from fix_view group by 1, 2")
def class_histogram(spark, sf_dir):
    return profile.class_histogram(fix_view(spark, sf_dir), ("event_type", "mode"))


@query("rollup_totals", """, k as (select device, time::date as day, count(*) filter (used) as n from fix_view group by 1, 2)
select device, count(*) as total, count(*) filter (n = 0) as bad from k group by rollup (device)""")
def rollup_totals(spark, sf_dir):
    sky = fix_view(spark, sf_dir).groupBy("device", F.to_date("time").alias("day")).agg(F.count(F.when(F.col("used"), 1)).alias("nSat"))
    return filters.empty_sky(sky, "device")


@query("decimate", """, s as (select *, round(epoch_us(time) / 1e6)::bigint as s from fix_view), r as (select *, row_number() over (partition by device, s order by line_no) as k from s where s % 30 = 0)
select line_no, device from r where k = 1""")
def decimate(spark, sf_dir):
    return sequence.decimate(fix_view(spark, sf_dir), 30).select("line_no", "device")


@query("dedupe_samples", """, l as (select line_no, device, mode, prn, lag(mode) over w as m, lag(prn) over w as p from fix_view window w as (partition by device order by line_no))
select line_no, device from l where not coalesce(mode = m or prn = p, false)""")
def dedupe_samples(spark, sf_dir):
    return sequence.dedupe_samples(fix_view(spark, sf_dir), "device", "mode", "prn", "line_no").select("line_no", "device")


@query("clock_offsets", """ select device, line_no, (row_number() over (partition by device order by line_no) - 1)::bigint as k, count(*) over (partition by device) as n, round(value * 1e9)::bigint as offset_ns from fix_view""")
def clock_offsets(spark, sf_dir):
    samples = fix_view(spark, sf_dir).select("device", "line_no", F.lit(0).cast("long").alias("clock_sec"), F.lit(0).cast("long").alias("clock_nsec"), F.lit(0).cast("long").alias("real_sec"), F.round(F.col("value") * 1e9).cast("long").alias("real_nsec"))
    return profile.clock_offsets(profile.clock_drift(samples), "device").select("device", "line_no", F.col("k").cast("long").alias("k"), "n", "offset_ns")


@query("latency_breakdown", """ select line_no, round(value / 1000, 6) as start, round(value / 1000 + (50 + line_no % 30) * 10e0 / case when device % 2 = 0 then 9600 else 4800 end, 6) as sent,
 round(value / 500, 6) as decoded, round(value / 250, 6) as received from fix_view""")
def latency_breakdown(spark, sf_dir):
    rows = fix_view(spark, sf_dir)
    t = F.unix_micros(F.col("time").cast("timestamp"))
    late = {"sor": 1000, "rtime": 500, "recv": 250}
    # times of day, so that microseconds survive as doubles
    rows = rows.withColumn("time", F.timestamp_micros(t % 86_400_000_000)).withColumns({c: (t % 86_400_000_000) / F.lit(1e6) + F.col("value") / F.lit(float(d)) for c, d in late.items()})
    rows = rows.withColumn("chars", F.expr("50 + line_no % 30"))
    devices = rows.select(F.col("device").alias("path")).distinct().withColumn("bps", F.when(F.col("path") % 2 == 0, 9600).otherwise(4800))
    return rounded(profile.latency_breakdown(rows, devices).select("line_no", "start", "sent", "decoded", "received"))
