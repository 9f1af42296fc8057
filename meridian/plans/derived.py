"""Queries on text, messages, orbits and streams that Spark derives from the given event table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import ais, enrich, filters, joins, nested, nmea, orbit, profile, sequence, sinks
from meridian.operators.tables import shared_path
from meridian.plans import queries as base
from meridian.plans.views import FIX_SQL, fix_view
from meridian.streaming import operators as streaming

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"with {FIX_SQL}{sql}"
        return f

    return register




@query("checksum", """, b as (select line_no, 'GP' || upper(event_type) || ',' || line_no || ',' || device as body from fix_view)
select line_no, '$' || body || '*' || printf('%02X', list_reduce(list_transform(string_split(body, ''), lambda c: ascii(c)), lambda x, y: xor(x, y))) as value from b""")
def checksum(spark, sf_dir):
    body = F.concat(F.lit("GP"), F.upper("event_type"), F.lit(","), F.col("line_no"), F.lit(","), F.col("device"))
    return fix_view(spark, sf_dir).select("line_no", sinks.sentence(body).alias("value"))


def _sentences(spark, sf_dir) -> DataFrame:
    rows = fix_view(spark, sf_dir).withColumns({"altMSL": F.col("altHAE"), "geoidSep": F.lit(0.0), "hdop": F.lit(1.5), "uSat": F.lit(8), "file": F.col("device").cast("string")})
    gga = sinks.to_gga(rows).select("file", (F.col("line_no") * 2).alias("line_no"), "value")
    rmc = sinks.to_rmc(rows.withColumns({"speed": F.col("value") / 100.0, "track": F.col("az").cast("double")})).select("file", (F.col("line_no") * 2 + 1).alias("line_no"), "value")
    return gga.unionByName(rmc).withColumn("value", nmea.once(F.col("value")))


@query(
    "nmea_roundtrip",
    """ select (line_no * 2)::bigint as line_no, device::varchar as device, date_trunc('millisecond', time) as time, case when mode < 2 then 1 else 3 end as mode, case when mode < 2 then 0 else status end as status, round(lat, 6) as lat, round(lon, 6) as lon, round(altHAE, 1) as alt from fix_view""",
)
def nmea_roundtrip(spark, sf_dir):
    """Fixes written as sentences and decoded again: each is a pair of sentences, decoded by line pair."""
    rows = nmea.decode(_sentences(spark, sf_dir)).withColumn("pair", F.floor(F.col("line_no") / 2))
    both = rows.groupBy("device", "pair").agg(F.max(F.when(F.col("tag") == "RMC", F.struct("date", "tod", "status", "mode"))).alias("r"), F.max(F.when(F.col("tag") == "GGA", F.struct("lat", "lon", "altMSL", "mode", "status"))).alias("g"))
    time = F.timestamp_micros(F.unix_micros(F.col("r.date").cast("timestamp")) + F.round(F.col("r.tod") * 1e6).cast("long")).cast("timestamp_ntz")
    return both.select((F.col("pair") * 2).alias("line_no"), "device", time.alias("time"), F.col("g.mode").alias("mode"), F.col("g.status").alias("status"), F.round("g.lat", 6).alias("lat"), F.round("g.lon", 6).alias("lon"), F.round("g.altMSL", 1).alias("alt"))


@query("nmea_fixes")
def nmea_fixes(spark, sf_dir):
    """The whole way of sentences: dates, epochs, lost locks, merged fixes."""
    return nmea.fixes(_sentences(spark, sf_dir)).select("device", "epoch", "time", "mode", "status", "lat", "lon", "speed", "track")


@query("nmea_cycles")
def nmea_cycles(spark, sf_dir):
    rows = nmea.decode(_sentences(spark, sf_dir)).select("device", "line_no", "tag", "tod")
    return nmea.cycle_report(nmea.epochs(rows, costly=True))


def _bits(spark, sf_dir) -> DataFrame:
    """A position message of 168 bits of each event, as the armoured payload of a sentence."""
    n = lambda e, k: F.lpad(F.conv(F.expr(f"cast({e} as string)"), 10, 2), k, "0")
    lon, lat = "line_no * 1237 % 100000000", "line_no * 733 % 50000000"
    parts = [n("1", 6), n("0", 2), n("200000000 + device", 30), n("line_no % 9", 4), n("line_no % 127", 8), n("line_no % 1023", 10), n("line_no % 2", 1), n(lon, 28), n(lat, 27), n("line_no % 3600", 12), n("line_no % 360", 9), n("line_no % 60", 6), n("line_no % 4", 2), n("0", 3), n("line_no % 2", 1), n("line_no % 500000", 19)]
    bits = F.concat(*parts)
    bytes_ = F.unhex(F.concat(*[F.lpad(F.conv(F.substring("bits", at, 56), 2, 16), 14, "0") for at in (1, 57, 113)]))
    payload = F.translate(F.base64(bytes_), ais.BASE64, ais.ARMOR)
    rows = fix_view(spark, sf_dir).withColumn("bits", nmea.once(bits)).withColumn("payload", nmea.once(payload))
    body = F.concat(F.lit("AIVDM,1,1,,A,"), F.col("payload"), F.lit(",0"))
    return rows.select(F.col("device").cast("string").alias("file"), "line_no", nmea.once(F.concat(F.lit("!"), body, F.lit("*"), nmea.hex_checksum(body))).alias("value"))


@query(
    "ais_bits",
    """ select line_no, (200000000 + device)::bigint as mmsi, (line_no % 9)::bigint as status, (line_no % 127)::bigint as turn, (line_no % 1023)::bigint as speed, (line_no * 1237 % 100000000)::bigint as lon, (line_no * 733 % 50000000)::bigint as lat,
 (line_no % 3600)::bigint as course, (line_no % 360)::bigint as heading, (line_no % 60)::bigint as second, (line_no % 500000)::bigint as radio from fix_view""",
)
def ais_bits(spark, sf_dir):
    rows = ais.decode_type(ais.messages(_bits(spark, sf_dir)), 1)
    return rows.select("line_no", "mmsi", "status", "turn", "speed", "lon", "lat", "course", "heading", "second", "radio")


@query(
    "ais_scaled",
    """, m as (select line_no, line_no % 1023 as speed, (line_no * 1237 % 100000000) as lon, (line_no * 733 % 50000000) as lat, line_no % 3600 as course from fix_view)
select line_no, case when speed < 1022 then round(speed / 10e0, 6) end as speed, round(lon / 600000e0, 6) as lon, round(lat / 600000e0, 6) as lat, round(course / 10e0, 6) as course from m""",
)
def ais_scaled(spark, sf_dir):
    rows = ais.scale_ais(ais.decode_type(ais.messages(_bits(spark, sf_dir)), 1))
    return base.rounded(rows.select("line_no", "speed", "lon", "lat", "course"))


A0, T0 = 26560000.0, 4.0 * 3600


@query(
    "sat_position",
    f""", o as (select line_no, radians(az) as m0, radians(prn * 11) as node0, radians(55) as i, (line_no % 7200)::double as t from fix_view),
p as (select *, m0 + sqrt({orbit.MU!r}e0 / ({A0!r}e0 * {A0!r}e0 * {A0!r}e0)) * (t - {T0!r}e0) as u, node0 - {orbit.OMEGA_E!r} * (t - {T0!r}e0) - {orbit.OMEGA_E!r} * {T0!r}e0 as node from o)
select line_no, round({A0!r}e0 * (cos(u) * cos(node) - sin(u) * cos(i) * sin(node)), 2) as x, round({A0!r}e0 * (cos(u) * sin(node) + sin(u) * cos(i) * cos(node)), 2) as y, round({A0!r}e0 * sin(u) * sin(i), 2) as z from p""",
)
def sat_position(spark, sf_dir):
    """Circular orbits of the events' satellites, for which the closed form is plain trigonometry."""
    orbits = fix_view(spark, sf_dir).select("line_no", F.lit(math.sqrt(A0)).alias("sqrtA"), F.lit(0.0).alias("e"), F.radians("az").alias("M0"), F.radians(F.col("prn") * 11).alias("Omega0"), F.radians(F.lit(55.0)).alias("i0"), F.lit(T0).alias("toe"), F.expr("cast(line_no % 7200 as double)").alias("t"))
    return orbit.sat_position(orbits).select("line_no", *[F.round(c, 2).alias(c) for c in "xyz"])


def _stream(spark, sf_dir, make, name: str) -> DataFrame:
    """Runs make over the events as a file stream to its end, into a table in the shared folder, and reads that."""
    path = shared_path(spark, name)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    from meridian.plans.views import FIX_COLUMNS, _split

    out = make(source.selectExpr(*_split(FIX_COLUMNS)))
    run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")




WINDOWS = " select time::date::timestamp as start, event_type, count(*) as n, round(avg(value), 6) as mean, round(min(value), 6) as low, round(max(value), 6) as high from fix_view group by 1, 2"


@query("window_stats", WINDOWS)
def window_stats(spark, sf_dir):
    """The streaming operator in batch: tumbling days."""
    out = streaming.window_stats(fix_view(spark, sf_dir), "value", "1 day", by=("event_type",))
    return base.rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query(
    "stream_window_stats",
    """, w as (select time::date::timestamp as start, event_type, count(*) as n, avg(value) as mean, min(value) as low, max(value) as high from fix_view group by 1, 2)
select start, event_type, n, round(mean, 6) as mean, round(low, 6) as low, round(high, 6) as high from w where start + interval 1 day <= (select max(time) - interval 10 minute from fix_view)""",
)
def stream_window_stats(spark, sf_dir):
    """Days that the watermark has closed when the stream ends."""
    rows = _stream(spark, sf_dir, lambda s: streaming.window_stats(s, "value", "1 day", by=("event_type",)), "windows")
    return base.rounded(rows.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query(
    "stream_tracks",
    """, f as (select device, time, lag(time) over (partition by device order by time) as before from fix_view where mode >= 2),
s as (select device, time, sum(case when before is null or time >= before + interval 6 hour then 1 else 0 end) over (partition by device order by time rows between unbounded preceding and current row) as k from f),
t as (select device, min(time) as start, max(time) + interval 6 hour as stop, count(*) as n from s group by device, k)
select * from t where stop <= (select max(time) - interval 10 minute from fix_view where mode >= 2)""",
)
def stream_tracks(spark, sf_dir):
    """Sessions that the watermark has closed when the stream ends."""
    rows = _stream(spark, sf_dir, lambda s: streaming.session_tracks(s, "6 hours"), "tracks")
    return rows.select("device", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("gpx_tracks")
def gpx_tracks(spark, sf_dir):
    return sinks.gpx_of(fix_view(spark, sf_dir).withColumn("uSat", F.lit(8)), 21600)


@query("report_json", """ select line_no, case when mode >= 2 then round(lat, 6) end as lat, case when mode >= 3 then round(altHAE, 3) end as altHAE, mode from fix_view""")
def report_json(spark, sf_dir):
    """Report lines written and parsed again."""
    lines = sinks.to_report_json(fix_view(spark, sf_dir).select("line_no", "mode", F.round("lat", 6).alias("lat"), F.round("altHAE", 3).alias("altHAE")))
    back = lines.select(F.from_json("value", "line_no bigint, lat double, altHAE double, mode int").alias("r"))
    return back.select("r.*")


@query("sanitized", """ select line_no, case when abs(speed) <= 9999.9 then round(speed, 6) end as speed, case when lat * 2 - 45 <= 90 and lon * 20 <= 180 then round(lat * 2 - 45, 6) end as lat from (select *, value * 50 as speed from fix_view)""")
def sanitized(spark, sf_dir):
    rows = fix_view(spark, sf_dir).withColumns({"speed": F.col("value") * 50, "lat": F.col("lat") * 2 - 45, "lon": F.col("lon") * 20})
    return base.rounded(filters.sanitize_fix(rows).select("line_no", "speed", "lat"))


@query("never_used", """ select distinct device, prn from fix_view where (device, prn) not in (select device, prn from fix_view where used)""")
def never_used(spark, sf_dir):
    return joins.never_used(fix_view(spark, sf_dir))


@query("skip_warmup", """, s as (select device, min(time) as t0 from fix_view group by device) select line_no, device from fix_view join s using (device) where epoch_us(time) - epoch_us(t0) >= 86400000000""")
def skip_warmup(spark, sf_dir):
    return filters.skip_warmup(fix_view(spark, sf_dir), 1.0, 86400).select("line_no", "device")


@query("one_per_second", """, i as (select *, sum(case when mode >= 2 then 0 else 1 end) over (partition by device order by line_no) as island, epoch_us(time) // 1000000 as s from fix_view),
k as (select *, sum(case when mode >= 2 then 1 else 0 end) over (partition by device, island order by line_no) as streak from i),
g as (select *, lag(s) over (partition by device order by line_no) as l from k where streak > 3)
select line_no, device from g where l is null or s <> l""")
def one_per_second(spark, sf_dir):
    return sequence.one_per_second(fix_view(spark, sf_dir)).select("line_no", "device")


@query("strip_chart", """ select device, time::date::timestamp as start, round(avg(lat), 9) as lat, round(avg(altHAE), 9) as altHAE from fix_view group by 1, 2""")
def strip_chart(spark, sf_dir):
    out = sequence.strip_chart(fix_view(spark, sf_dir), ("lat", "altHAE"), "1 day")
    return base.rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 9)


@query("rollovers", """, w as (select line_no, device, (line_no * 37) % 1024 as week from fix_view), l as (select *, lag(week) over (partition by device order by line_no) as b from w)
select line_no, device, sum(case when week < b then 1 else 0 end) over (partition by device order by line_no rows between unbounded preceding and current row)::bigint as rollovers from l""")
def rollovers(spark, sf_dir):
    return sequence.rollover_count(fix_view(spark, sf_dir).withColumn("week", F.expr("line_no * 37 % 1024"))).select("line_no", "device", "rollovers")


def _vincenty_sql(rounds: int = 6) -> str:
    """Vincenty's inverse from (45, 7), one subquery a round, as the published formulas have it."""
    a, b, f = geo.WGS84_A, geo.WGS84_B, "(1e0 / 298.257223563e0)"
    out = f""", l0 as (select line_no, lat, lon, radians(7e0 - lon) as span, radians(7e0 - lon) as lam, sin(atan((1 - {f}) * tan(radians(lat)))) as s1, cos(atan((1 - {f}) * tan(radians(lat)))) as c1,
 sin(atan((1 - {f}) * tan(radians(45e0)))) as s2, cos(atan((1 - {f}) * tan(radians(45e0)))) as c2 from fix_view)"""
    for k in range(rounds + 1):
        out += f""", a{k} as (select *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) as ss, s1 * s2 + c1 * c2 * cos(lam) as cs from l{k}), b{k} as (select *, atan2(ss, cs) as sg, case when ss = 0 then 0 else c1 * c2 * sin(lam) / ss end as sa from a{k}),
 c{k} as (select *, 1 - sa * sa as ca, cs - 2 * s1 * s2 / (1 - sa * sa) as cm from b{k}), d{k} as (select *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) as c from c{k})"""
        if k < rounds:
            out += f""", l{k + 1} as (select line_no, lat, lon, span, span + (1 - c) * {f} * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))) as lam, s1, c1, s2, c2 from d{k})"""
    u = f"(ca * ({a!r}e0 * {a!r}e0 - {b!r}e0 * {b!r}e0) / ({b!r}e0 * {b!r}e0))"
    return out + f""", u as (select *, 1 + {u} / 16384 * (4096 + {u} * (-768 + {u} * (320 - 175 * {u}))) as ka, {u} / 1024 * (256 + {u} * (-128 + {u} * (74 - 47 * {u}))) as kb from d{rounds})
select line_no, round({b!r}e0 * ka * (sg - kb * ss * (cm + kb / 4 * (cs * (2 * cm * cm - 1) - kb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 4) as exact, round({base.e2('lat', 'lon', '45e0', '7e0')}, 4) as small,
 round(degrees(atan2(c2 * sin(lam), c1 * s2 - s1 * c2 * cos(lam))), 6) + 0e0 as initial, round(degrees(atan2(c1 * sin(lam), c1 * s2 * cos(lam) - s1 * c2)), 6) + 0e0 as final from u"""


@query("vincenty_near", _vincenty_sql())
def vincenty_near(spark, sf_dir):
    """Exact beside equirectangular distance to one place, and the bearings there."""
    rows = geo.with_inverse(fix_view(spark, sf_dir), "lat", "lon", 45.0, 7.0)
    small = geo.earth_distance_small("lat", "lon", 45.0, 7.0)
    degrees = lambda c: F.round(F.degrees(f"inverse.{c}"), 6) + F.lit(0.0)
    return rows.select("line_no", F.round("inverse.distance", 4).alias("exact"), F.round(small, 4).alias("small"), degrees("bearing_initial").alias("initial"), degrees("bearing_final").alias("final"))


@query("rate_errors")
def rate_errors(spark, sf_dir):
    rows = enrich.error_estimates(base.with_dops(fix_view(spark, sf_dir)))
    return enrich.rate_errors(rows).select("line_no", "eps", "epc", "epd")


#: A walk over each device's fixes, row by row: what is kept so far goes with it.
WALK = """, r as (select device, line_no, epoch_us(time) as t, lat, lon, row_number() over (partition by device order by line_no) as k from fix_view where {which}),
walk as (select device, k, line_no, t as kt, lat as klat, lon as klon, true as kept from r where k = 1
 union all select device, k, line_no, case when far then t else kt end, case when far then lat else klat end, case when far then lon else klon end, far
 from (select r.device, r.k, r.line_no, r.t, r.lat, r.lon, w.kt, w.klat, w.klon, {far} as far from walk w join r on r.device = w.device and r.k = w.k + 1))
select line_no, device from walk where kept"""


def _recursive(name: str, sql: str) -> None:
    ORACLE_SQL[name] = f"with recursive {FIX_SQL}{sql}"


def _small_far(least: float):
    """Far by the equirectangular distance, which SQL can say in a line."""

    def far(a, b):
        middle = np.radians((a[0] + b[0]) / 2)
        metres = (111132.954 - 559.822 * np.cos(2 * middle) + 1.175 * np.cos(4 * middle)) * np.hypot(b[0] - a[0], (b[1] - a[1]) * np.cos(middle))
        return (metres >= least) & (a[2] != b[2])

    return far


@query("thinned")
def thinned(spark, sf_dir):
    rows = fix_view(spark, sf_dir).filter("mode >= 2")
    return sequence.thin(rows, 4000.0, far=_small_far(4000.0)).select("line_no", "device")


_recursive("thinned", WALK.format(which="mode >= 2", far=f"{base.e2('w.klat', 'w.klon', 'r.lat', 'r.lon')} >= 4000 and r.t <> w.kt"))


@query("decimated")
def decimated(spark, sf_dir):
    return sequence.decimate_exact(fix_view(spark, sf_dir).withColumn("time", F.date_trunc("hour", F.col("time").cast("timestamp"))), 7200).select("line_no", "device")


_recursive("decimated", WALK.replace("epoch_us(time)", "epoch(date_trunc('hour', time))").format(which="epoch(date_trunc('hour', time))::bigint % 7200 = 0", far="r.t - w.kt >= 7200"))


SHIFTED = "case when line_no % 7 = 0 then time - interval '3' day else time end"


@query(
    "stream_late",
    f""", s as (select line_no, device, {SHIFTED} as time from fix_view), w as (select *, max(time) over (partition by device order by line_no rows between unbounded preceding and 1 preceding) as newest from s)
select line_no, device, coalesce(time < newest - interval 10 minute, false) as is_late from w""",
)
def stream_late(spark, sf_dir):
    """A stream with rows out of order: those behind the newest time of their device are told apart, none is lost."""
    late = lambda s: streaming.split_late(s.selectExpr("line_no", "device", f"{SHIFTED} as time"), ttl_ms=None)
    return _stream(spark, sf_dir, late, "late").select("line_no", "device", "is_late")


def _cells(spark, sf_dir) -> DataFrame:
    """Sentences of each event: position, velocity and date, and now and then one without a fix or without altitude."""
    rows = fix_view(spark, sf_dir).selectExpr("line_no", "device", "cast(device as string) as file", "line_no * 60 % 86400 as s", "mode", "lat", "lon", "altHAE")
    clock = F.format_string("%02d%02d%02d.00", F.floor(F.col("s") / 3600).cast("int"), (F.floor(F.col("s") / 60) % 60).cast("int"), (F.col("s") % 60).cast("int"))
    degree = lambda c, w: F.format_string(f"%0{w}d%08.5f", F.floor(c).cast("int"), (F.col(c) - F.floor(c)) * 60)
    rmc = F.concat(F.lit("GPRMC,"), clock, F.when(F.col("mode") > 1, ",A,").otherwise(",V,"), degree("lat", 2), F.lit(",N,"), degree("lon", 3), F.lit(",E,"), F.expr("format_string('%.1f,%.1f', line_no % 90 / 2D, line_no % 360 / 1D)"), F.lit(",280224,"), F.expr("format_string('%.1f,%s', line_no % 40 / 2D, if(line_no % 2 = 0, 'W', 'E'))"), F.lit(",A"))
    return rows.select("file", "line_no", sinks.sentence(rmc).alias("value"))


@query(
    "sentence_RMC",
    """, s as (select line_no, device, mode > 1 as ok, line_no * 60 % 86400 as s, floor(lat) as a, round((lat - floor(lat)) * 60, 5) as am, floor(lon) as o, round((lon - floor(lon)) * 60, 5) as om from fix_view)
select line_no, device::varchar as device, s::double as tod, date '2024-02-28' as date, case when ok then 1 else 0 end as status, case when ok then 2 else 1 end as mode, case when ok then round(a + am / 60, 6) end as lat, case when ok then round(o + om / 60, 6) end as lon,
 case when ok then round(line_no % 90 / 2e0 * 0.514444444e0, 6) end as speed, case when ok then (line_no % 360)::double end as track, case when ok then (line_no % 40) / 2e0 * case when line_no % 2 = 0 then -1 else 1 end + 0e0 end as magvar from s""",
)
def sentence_rmc(spark, sf_dir):
    rows = nmea.decode(_cells(spark, sf_dir))
    return base.rounded(rows.select("line_no", "device", "tod", "date", "status", "mode", "lat", "lon", "speed", "track", "magvar"))


def _cycles(spark, sf_dir) -> DataFrame:
    """Decoded rows of each event's cycle: altitude first, then a plain position without altitude, then dilutions."""
    of = "line_no * 3 + {0} as line_no, cast(device as string) as device, '{1}' as tag, 'GP' as talker, {2} as tod"
    part = lambda k, tag, tod, **more: fix_view(spark, sf_dir).selectExpr(*of.format(k, tag, tod).split(", "), *[f"{v} as {c}" for c, v in more.items()])
    gga = part(0, "GGA", "cast(line_no div 2 % 80000 as double)", mode="mode", status="if(mode > 1, status, 0)", lat="if(mode > 1, lat, null)", lon="if(mode > 1, lon, null)", altMSL="if(mode > 2, altHAE, null)")
    rmc = part(1, "RMC", "cast(line_no div 2 % 80000 as double)", mode="if(mode > 1, 2, 1)", status="if(mode > 1, 1, 0)", lat="if(mode > 1, lat + 1, null)", lon="if(mode > 1, lon, null)", speed="line_no / 8D", date="date'2024-02-28'")
    gsa = part(2, "GSA", "cast(null as double)", pdop="el / 10D")
    rows = gga.unionByName(rmc, allowMissingColumns=True).unionByName(gsa, allowMissingColumns=True)
    kinds = {c: "double" for c in nmea.FIELDS} | nmea._TYPES
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in nmea.FIELDS])


#: The rows of _cycles in order, and the epochs that their times make.
CYCLES = """, r as (select line_no * 3 as l, device, 0 as k, (line_no // 2 % 80000)::double as tod, mode, case when mode > 1 then status else 0 end as status, case when mode > 1 then lat end as lat, case when mode > 2 then altHAE end as alt, null::double as speed, null::double as pdop from fix_view
 union all select line_no * 3 + 1, device, 1, (line_no // 2 % 80000)::double, case when mode > 1 then 2 else 1 end, case when mode > 1 then 1 else 0 end, case when mode > 1 then lat + 1 end, null, line_no / 8e0, null from fix_view
 union all select line_no * 3 + 2, device, 2, null, null, null, null, null, null, el / 10e0 from fix_view),
t as (select *, last_value(tod ignore nulls) over (partition by device order by l rows between unbounded preceding and 1 preceding) as before from r),
e as (select *, sum(case when tod is not null and (before is null or abs(tod - before) > 0.01) then 1 else 0 end) over (partition by device order by l) as epoch from t)"""


@query(
    "merged_fixes",
    CYCLES
    + """, g as (select *, lag(tod) over (partition by device, k order by l) as same from e where k = 0),
x as (select e.* replace (case when e.k = 0 and g.same = g.tod then 1 else e.mode end as mode, case when e.k = 0 and g.same = g.tod then 0 else e.status end as status) from e left join g on g.device = e.device and g.l = e.l),
m as (select device, epoch, min(l) as line_no, arg_max(tod, l) filter (tod is not null) as tod, max(status) as status, arg_max(mode, l) filter (mode is not null) as last_mode, max(mode) filter (k = 0) as full_mode,
 arg_max(lat, l) filter (lat is not null) as lat, arg_max(alt, l) filter (alt is not null) as alt, arg_max(speed, l) filter (speed is not null) as speed, arg_max(pdop, l) filter (pdop is not null) as pdop from x where epoch > 0 group by device, epoch)
select device::varchar as device, epoch::bigint as epoch, line_no, tod, status, case when full_mode = 3 and last_mode = 2 then 3 else last_mode end as mode, round(lat, 6) as lat, round(alt, 6) as alt, round(speed, 6) as speed, round(pdop, 6) as pdop from m""",
)
def merged_fixes(spark, sf_dir):
    """Epochs, lost locks and merged cycles: a position without altitude doesn't undo 3D, a repeated time means no fix."""
    rows = nmea.merge_fix(nmea.stale_gga(nmea.epochs(nmea.carry_date(_cycles(spark, sf_dir)))))
    return base.rounded(rows.select("device", "epoch", "line_no", "tod", "status", "mode", "lat", F.col("altMSL").alias("alt"), "speed", "pdop"))


@query(
    "cycle_enders",
    CYCLES
    + """, n as (select *, lead(epoch) over (partition by device order by l) as next from e where tod is not null) select device::varchar as device, case k when 0 then 'GGA' else 'RMC' end as tag, count(*) as n from n where next <> epoch group by 1, 2""",
)
def cycle_enders(spark, sf_dir):
    return nmea.cycle_enders(nmea.epochs(_cycles(spark, sf_dir)))


@query(
    "cycle_reports",
    CYCLES
    + """, b as (select device, epoch, string_agg(case k when 0 then 'GGA' when 1 then 'RMC' else 'GSA' end, ',' order by l) as tags from e where epoch > 0 group by device, epoch),
h as (select *, min(epoch) over (partition by device) as lo, max(epoch) over (partition by device) as hi from b)
select device::varchar as device, count(*) as cycles, count(distinct tags) as kinds from h where epoch > lo and epoch < hi group by device""",
)
def cycle_reports(spark, sf_dir):
    return nmea.cycle_report(nmea.epochs(_cycles(spark, sf_dir))).select("device", "cycles", "kinds")


@query("subframe_records", """ select line_no as TOW17, prn as tSV, line_no % 64 as WN, line_no / 4e0 as af0 from fix_view where line_no % 5 = 1 and line_no % 2 = 0""")
def subframe_records(spark, sf_dir):
    """Parts of their own frame only."""
    part = F.when(F.col("line_no") % 2 == 0, F.struct((F.col("line_no") % 64).alias("WN"), (F.col("line_no") / 4.0).alias("af0")))
    rows = fix_view(spark, sf_dir).select(F.col("line_no").alias("TOW17"), F.col("prn").alias("tSV"), (F.col("line_no") % 5).cast("int").alias("frame"), part.alias("EPHEM1"))
    return nested.subframe_records(rows, "EPHEM1")


@query("obs_records", """ select device, count(*) as n, sum(line_no)::bigint as lines, round(sum(value), 4) as total from fix_view group by device""")
def obs_records(spark, sf_dir):
    """Measurements of nested reports, one row each again."""
    one = F.struct(F.col("prn").alias("svid"), "line_no", "value")
    raw = fix_view(spark, sf_dir).groupBy("device", F.to_date("time").alias("time")).agg(F.collect_list(one).alias("rawdata")).withColumn("nsec", F.lit(0))
    flat = nested.obs_records(raw)
    return base.rounded(flat.groupBy("device").agg(F.count("*").alias("n"), F.sum("line_no").alias("lines"), F.sum("value").alias("total")), 4)


@query("correction_records", """, c as (select line_no, device, case line_no % 6 when 0 then 1 when 1 then 5 when 2 then 9 when 3 then 31 else 14 end as type, line_no % 3 as n from fix_view)
select device, type, line_no as station_id, (line_no % 7) / 2e0 as zcount, case when n > 0 then i::bigint end as ident from c, unnest(case when n = 0 then [0] when n = 1 then [1] else [1, 2] end) as u(i) where type <> 14""")
def correction_records(spark, sf_dir):
    """A row for each satellite of the message types that have any; messages without one keep a row."""
    sats = F.expr("transform(filter(array(1L, 2L), i -> i <= line_no % 3), i -> named_struct('ident', i))")
    rows = fix_view(spark, sf_dir).select("device", F.expr("element_at(array(1, 5, 9, 31, 14, 14), cast(line_no % 6 as int) + 1)").alias("type"), F.col("line_no").alias("station_id"), (F.expr("line_no % 7") / F.lit(2.0)).alias("zcount"), sats.alias("satellites"))
    return nested.correction_records(rows)


@query("first_pair", """ select (select min(line_no) from fix_view where used and time = (select min(time) from fix_view where used)) as sky_line, (select min(line_no) from fix_view where time = (select min(time) from fix_view)) as fix_line""")
def first_pair(spark, sf_dir):
    rows = fix_view(spark, sf_dir)
    sky = rows.select("line_no", F.struct("time", "line_no").alias("time"), F.when(F.col("used"), F.array("prn")).otherwise(F.expr("array()")).alias("satellites"))
    return profile.first_pair(sky, rows.select("line_no", F.struct("time", "line_no").alias("time"))).select(F.col("sky.line_no").alias("sky_line"), F.col("tpv.line_no").alias("fix_line"))


@query("utc_corrections", f""" select line_no, round(18 + 1e-3 + 1e-9 * (line_no % 604800 - 405504 + 604800 * (line_no % 2)), 9) as utc_offset from fix_view""")
def utc_corrections(spark, sf_dir):
    page = F.expr("named_struct('A0', 1e-3D, 'A1', 1e-9D, 'tot', 405504D, 'WNt', 100)")
    rows = fix_view(spark, sf_dir).select("line_no", F.lit(18).alias("ls"), page.alias("IONO"), F.expr("cast(line_no % 604800 as double)").alias("tow"), F.expr("100 + line_no % 2").alias("week"))
    return orbit.utc_correction(rows).select("line_no", F.round("utc_offset", 9).alias("utc_offset"))


@query("merged_almanacs", """, h as (select prn as sv, device % 4 as IODA, max(line_no) filter (line_no % 2 = 0) as a, max(line_no) filter (line_no % 2 = 1) as b from fix_view group by 1, 2), k as (select *, row_number() over (partition by sv order by IODA desc) as n from h)
select sv, a as sqrtA, b as e, IODA as toa from k where n = 1 and a > 0""")
def merged_almanacs(spark, sf_dir):
    """Halves of an almanac by satellite and issue: one has the orbit's size, the other its shape."""
    halves = fix_view(spark, sf_dir).selectExpr("prn as sv", "device % 4 as IODA", "line_no % 2 as half", "line_no").groupBy("sv", "IODA", "half").agg(F.max("line_no").alias("x"))
    halves = halves.selectExpr("sv", "IODA", "if(half = 0, x, null) as sqrtA", "if(half = 1, x, null) as e", "IODA as toa")
    return orbit.merge_almanac(halves, ("sqrtA", "e", "toa"))


@query(
    "ephemerides",
    """, p as (select prn as sv, device % 3 as iod, line_no % 3 as part, line_no from fix_view), f as (select sv, iod, part, line_no % 4 as version, min(line_no) as heard from p group by all)
select a.sv as tSV, a.iod::bigint as iod, a.heard as first_heard, b.heard as second_heard, c.heard as third_heard from f a join f b on a.sv = b.sv and a.iod = b.iod and b.part = 1 and b.version = 2 and abs(a.heard - b.heard) <= 300
 join f c on a.sv = c.sv and a.iod = c.iod and c.part = 2 and c.version = 3 and abs(a.heard - c.heard) <= 300 where a.part = 0 and a.version = 1""",
)
def ephemerides(spark, sf_dir):
    """Parts that are sent again and again, put together by issue where they were first heard within a window."""
    of = lambda part, version, issue, heard: fix_view(spark, sf_dir).filter(f"line_no % 3 = {part} and line_no % 4 = {version}").selectExpr("prn as tSV", "line_no as TOW17", f"device % 3 as {issue}", f"{version} as {heard}")
    out = orbit.ephemerides(of(0, 1, "IODC", "v1"), of(1, 2, "IODE", "v2"), of(2, 3, "IODE", "v3"), window=300)
    return out.select("tSV", F.col("iod").cast("long").alias("iod"), F.col("heard1").alias("first_heard"), F.col("heard2").alias("second_heard"), F.col("heard3").alias("third_heard"))


def _kepler_sql(steps: int = 10) -> str:
    x = "m"
    for _ in range(steps):
        x = f"m + e * sin({x})"
    return x


@query(
    "orbits_by_time",
    f""", o as (select distinct prn as sv, line_no % 6 as d, (line_no % 6) * 86400e0 + (prn % 2) * 7200 as toe, radians(prn * 7 + (line_no % 6) * 13) as m0, radians(prn * 3) as w, radians(prn * 11) as node0, 0.01e0 * (prn % 3 + 1) as e from fix_view),
s as (select line_no, prn as sv, (line_no * 97 % 518400)::double as t from fix_view), r as (select s.line_no, s.t, o.*, row_number() over (partition by s.line_no order by abs(t - toe), toe) as k from s join o on o.sv = s.sv and abs(t - toe) <= 43200),
k as (select *, {A0!r}e0 as a, m0 + sqrt({orbit.MU!r}e0 / ({A0!r}e0 * {A0!r}e0 * {A0!r}e0)) * (t - toe) as m, node0 - {orbit.OMEGA_E!r} * (t - toe) - {orbit.OMEGA_E!r} * toe as node from r where k = 1),
b as (select *, {_kepler_sql()} as big from k), u as (select *, atan2(sqrt(1 - e * e) * sin(big), cos(big) - e) + w as u, a * (1 - e * cos(big)) as rad, radians(55e0) as i from b)
select line_no, toe, round(rad * (cos(u) * cos(node) - sin(u) * cos(i) * sin(node)), 1) as x, round(rad * (cos(u) * sin(node) + sin(u) * cos(i) * cos(node)), 1) as y, round(rad * sin(u) * sin(i), 1) as z from u""",
)
def orbits_by_time(spark, sf_dir):
    """Each time with the orbit nearest to it among six days of a satellite's, elliptic ones."""
    rows = fix_view(spark, sf_dir)
    orbits = rows.selectExpr("prn as tSV", "line_no % 6 as d", "line_no % 6 * 86400D + prn % 2 * 7200 as toe", "radians(prn * 7 + line_no % 6 * 13) as M0", "radians(prn * 3) as omega", "radians(prn * 11) as Omega0", "0.01D * (prn % 3 + 1) as e").distinct()
    orbits = orbits.withColumns({"sqrtA": F.lit(math.sqrt(A0)), "i0": F.radians(F.lit(55.0))})
    times = rows.selectExpr("line_no", "prn as tSV", "cast(line_no * 97 % 518400 as double) as t")
    near = orbit.orbits_at(times, orbits, valid=43200.0)
    return orbit.sat_position(near).select("line_no", "toe", *[F.round(c, 1).alias(c) for c in "xyz"])


@query(
    "moving_percentiles",
    f""", m as (select device, time, {base.e2('lat', 'lon', '45e0', '7e0')} as m from fix_view), w as (select device, m, time::date::timestamp - d * interval 1 day as start from m, unnest([0, 1]) as u(d))
select start, device, count(*) as n, round(quantile_disc(m, 0.5), 4) as cep50, round(quantile_disc(m, 0.95), 4) as cep95, round(quantile_disc(m, 0.99), 4) as cep99 from w group by 1, 2""",
)
def moving_percentiles(spark, sf_dir):
    """Two days wide, a day on each time; windows have fewer fixes than the sketch tells apart."""
    out = streaming.moving_percentiles(fix_view(spark, sf_dir), 45.0, 7.0, "2 days", "1 day")
    return base.rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query(
    "gpx_points",
    """, f as (select *, epoch_us(time) as t, lag(epoch_us(time)) over (partition by device order by line_no) as b from fix_view where mode >= 2)
select line_no, printf('<trkpt lat="%.9f" lon="%.9f"><ele>%.4f</ele><time>%s</time><fix>%s</fix><sat>8</sat></trkpt>', lat, lon, altHAE, strftime(time, '%Y-%m-%dT%H:%M:%S.%gZ'), case when status = 2 then 'dgps' when mode = 3 then '3d' else '2d' end) as value from f where b is null or t <> b""",
)
def gpx_points(spark, sf_dir):
    tracks = sequence.segment_tracks(fix_view(spark, sf_dir).withColumn("uSat", F.lit(8)), 21600)
    return sinks.gpx_lines(tracks).filter("place = 1").select(F.col("k").alias("line_no"), "value")
