import datetime as dt

import pytest
from pyspark.sql import functions as F

from meridian.functions import geo, gnss, gpstime
from meridian.functions.register import register_functions
from meridian.operators import ais, enrich, filters, joins, nested, nmea, orbit, profile, sequence, sinks
from meridian.sources import readers
from meridian.streaming import operators as streaming

DISTANCES = [(42.3541165, -71.0693514, 40.7791472, -73.9680804, 298396.0), (0, 0, 10, 0, 1105854.0), (0, 0, 0, 10, 1113194.0), (45, 0, 46, 1, 135869.0)]


def _xor(body: str) -> str:
    x = 0
    for c in body:
        x ^= ord(c)
    return f"{x:02X}"


def _lines(spark, bodies, mark="$"):
    return spark.createDataFrame([("d", k, f"{mark}{b}*{_xor(b)}") for k, b in enumerate(bodies, 1)], "file string, line_no long, value string")


def test_distances(spark):
    df = spark.createDataFrame([tuple(map(float, d)) for d in DISTANCES], "a double, b double, c double, d double, want double")
    for r in df.select("want", geo.earth_distance("a", "b", "c", "d").alias("exact"), geo.earth_distance_small("a", "b", "c", "d").alias("small")).collect():
        assert r.exact == pytest.approx(r.want, rel=1e-5)
        assert r.small == pytest.approx(r.want, rel=1e-2)
    far = spark.createDataFrame([(0.0, 0.0, 0.5, 179.7)], "a double, b double, c double, d double")
    assert far.select(geo.earth_distance("a", "b", "c", "d")).first()[0] == pytest.approx(19870094, rel=1e-2)


def test_positions_and_locators(spark):
    x = spark.createDataFrame([(48.864710, 2.373051, 100.0)], "lat double, lon double, alt double")
    assert x.select(geo.maidenhead("lat", "lon")).first()[0] == "JN18eu47sm"
    ecef = x.select("lat", "lon", "alt", *[c.alias(n) for c, n in zip(geo.lla2ecef("lat", "lon", "alt"), "xyz", strict=True)])
    back = ecef.select(*[c.alias(n) for c, n in zip(geo.ecef2lla("x", "y", "z"), ("p", "q", "h"), strict=True)]).first()
    assert (back.p, back.q, back.h) == pytest.approx((48.864710, 2.373051, 100.0), abs=1e-6)
    assert spark.range(1).select(geo.deg_to_str("ddmm", F.lit(-45.5))).first()[0] == "- 45 30.000000'"


def test_gps_time(spark):
    gps, week, tow = gpstime.posix2gps(F.lit(1609459200), F.lit(18))
    assert tuple(spark.range(1).select(gps, week, tow).first()) == (1293494418, 2138, 432018)
    t = spark.range(1).select(gpstime.gps2utc(F.lit(2138 % 1024), F.lit(432018), F.lit(18), F.lit(2)).alias("t"), gpstime.fix_wkro(F.lit(1000000000), F.lit(18)).alias("w")).first()
    assert (t.t, t.w) == (1609459200, 1000000000 + 619315200)
    assert spark.range(1).select(gpstime.isotime(F.lit(1.5))).first()[0] == "1970-01-01T00:00:01.500Z"


def test_snr_flags_and_codes(spark):
    df = spark.createDataFrame([(0.0, 0), (11.0, 1), (12.0, 2), (18.0, 2), (19.0, 3), (53.0, 8), (54.0, 9)], "ss double, want int")
    assert df.filter(gnss.snr_flag(F.col("ss")) != F.col("want")).count() == 0
    assert spark.range(1).select(gnss.obs_code(F.lit(0), F.lit(0), "L"), gnss.rinex_system(F.lit(6))).first()[:] == ("L1C", "R")


def test_grid_is_bilinear(spark):
    grid = spark.createDataFrame([(i, j, float(100 * i + j)) for i in range(37) for j in range(73)], "i int, j int, value double")
    df = spark.createDataFrame([(-90.0, -180.0), (2.5, 2.5), (90.0, 180.0), (91.0, 0.0)], "lat double, lon double")
    assert [r.g for r in geo.geoid_separation(df, grid, out="g").collect()] == pytest.approx([0.0, 0.01 * (1850 + 36.5), 36.72, None])


def test_sentences_to_fixes(spark):
    lines = _lines(
        spark,
        [
            "GPGGA,145243.000,3401.9764,N,11744.8274,W,2,10,0.87,234.7,M,-33.2,M,0000,0000",
            "GPGSA,A,3,14,09,22,18,,,,,,,,,1.58,0.87,1.31",
            "GPGSV,2,1,05,14,86,335,41,22,54,049,36,24,54,134,38,51,48,161,31",
            "GPGSV,2,2,05,19,36,273,30",
            "GPRMC,145243.000,A,3401.9764,N,11744.8274,W,1.00,119.27,030610,,,D",
            "GPGGA,145244.000,3401.9764,N,11744.8274,W,1,03,0.87,,M,,M,,",
            "GPRMC,145244.000,V,,,,,,,030610,,,N",
            "SDDBT,10.0,f,3.1,M,1.7,F",
            "SDDPT,5.0,-1.0",
        ],
    ).unionByName(spark.createDataFrame([("d", 99, "$GPGGA,broken*00"), ("d", 100, "noise")], "file string, line_no long, value string"))
    a, b = nmea.fixes(lines).orderBy("epoch").collect()
    assert (a.mode, a.status, a.time, a.pdop, a.speed) == (3, 2, dt.datetime(2010, 6, 3, 14, 52, 43), 1.58, pytest.approx(0.514444, rel=1e-5))
    assert (a.lat, a.lon, a.altMSL) == pytest.approx((34.03294, -117.747123, 234.7), abs=1e-6)
    assert (b.mode, b.depth) == (1, 6.0)
    rows = nmea.epochs(nmea.carry_date(nmea.decode(lines)))
    sky = nmea.union_skyview(nmea.assemble_gsv(nmea.gsv_parts(lines)), rows)
    used = nmea.gsa_used(lines).withColumn("epoch", F.lit(1).cast("bigint"))
    got = {r.PRN: (r.gnssid, r.svid, r.used) for r in nmea.mark_used(nmea.sat_identity(sky), used).collect()}
    assert got == {14: (0, 14, True), 22: (0, 22, True), 24: (0, 24, False), 51: (1, 138, False), 19: (0, 19, False)}


def test_vessel_messages(spark):
    position = "AIVDM,1,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ,0"
    rows = ais.messages(_lines(spark, [position], "!"))
    r = ais.decode_type(rows, 1).first()
    assert (r.mmsi, r.turn, r.speed, r.lon, r.lat, r.course, r.heading, r.second) == (371798000, -127, 123, -74037230, 29028980, 2240, 215, 33)
    s = ais.scale_ais(ais.decode_type(rows, 1)).first()
    assert (s.turn_text, s.speed, s.lon, s.lat, s.course) == ("fastleft", 12.3, pytest.approx(-123.3953833), pytest.approx(48.3816333), 224.0)
    assert spark.range(1).select(ais.mmsi_of(F.lit("15RTgt0PAso"))).first()[0] == 371798000


FRAGMENTS = [("d", "A", 1, 2, 1, "55", 0), ("d", "B", 2, 1, 1, "x", 0), ("d", "A", 3, 2, 2, "66", 2), ("d", "A", 4, 2, 1, "77", 0), ("d", "A", 5, 3, 2, "88", 0), ("d", "A", 6, 2, 2, "99", 0)]
FRAGMENT_SCHEMA = "device string, channel string, line_no long, nfrags int, ifrag int, payload string, pad int"


def test_fragments_in_turn_only(spark, tmp_path, no_idle_batches):
    df = spark.createDataFrame(FRAGMENTS, FRAGMENT_SCHEMA)
    want = {("A", 3, "5566", 2), ("B", 2, "x", 0)}
    assert {(r.channel, r.line_no, r.payload, r.pad) for r in ais.assemble_fragments(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FRAGMENT_SCHEMA).parquet(str(tmp_path / "in"))
    q = streaming.assemble_fragments(stream).writeStream.format("memory").queryName("fragments").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    ended = q.awaitTermination(60)
    q.stop()
    assert ended
    assert {(r.channel, r.line_no, r.payload, r.pad) for r in spark.table("fragments").collect()} == want


def test_type_24_halves(spark):
    rows = [("d", "A", 1, 7, "A", "SEVEN", None), ("d", "A", 2, 8, "B", None, "C8"), ("d", "A", 3, 7, "B", None, "C7"), ("d", "A", 4, 7, "B", None, "C7")]
    got = ais.merge_24(spark.createDataFrame(rows, "device string, channel string, line_no long, mmsi long, part string, shipname string, callsign string")).orderBy("line_no").collect()
    assert [(r.part, r.shipname) for r in got] == [("A", "SEVEN"), ("B", None), ("both", "SEVEN"), ("B", None)]


def test_reports_and_quarantine(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"class":"TPV","device":"d","mode":3,"lat":1.5,"odd":1,"time":"2020-01-01T00:00:00.000Z"}\n# note\n$GPGGA*00\n{"x":1}\n{"class":"SKY","satellites":[{"PRN":5,"used":true,"ss":40.0}]}\n{"class":"VERSION"}\n')
    reports, rest = readers.read_reports(spark, str(tmp_path / "log.json"))
    assert (reports.count(), rest.count()) == (3, 3)
    r = readers.report_table(reports, "TPV").first()
    assert (r.lat, r.mode, r.lon, '"odd":1' in r._raw) == (1.5, 3, None, True)
    assert readers.report_table(reports, "SKY").first().satellites[0].PRN == 5
    assert readers.report_table(reports, "VERSION").count() == 1


def test_clock_samples_keep_nanoseconds(spark, tmp_path):
    (tmp_path / "s.txt").write_text("sample NTP0 1461537438.593729271 1461537438.593633306 1461537438.703999996 0 -1\n# x\n")
    r = readers.read_clock_samples(spark, str(tmp_path / "s.txt")).first()
    assert (r.unit, r.real_ns - r.clock_ns, r.precision) == ("NTP0", 110366690, -1)


def test_station_tables(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\n45.0 7.0 a.test # near\n\n46 8 b.test\n")
    assert [tuple(r) for r in readers.read_station_list(spark, str(tmp_path / "l.txt")).collect()] == [(45.0, 7.0, "a.test"), (46.0, 8.0, "b.test")]
    (tmp_path / "t.txt").write_text("CAS;x\nSTR;M1;I;RTCM 3;;2;GPS;N;DEU;50.0;8.0;1;0;g;none;B;N;9600\n")
    r = readers.read_sourcetable(spark, str(tmp_path / "t.txt")).first()
    assert (r.mountpoint, r.carrier, r.lat, r.bitrate) == ("M1", 2, 50.0, 9600)


def _fixes(spark, rows):
    return spark.createDataFrame([("d", k, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=t), m, lat) for k, (t, m, lat) in enumerate(rows)], "device string, line_no long, time timestamp, mode int, lat double").withColumn("lon", F.lit(0.0))


def test_tracks_cut_at_gaps_both_ways(spark):
    tracks = sequence.segment_tracks(_fixes(spark, [(0, 3, 0.0), (3, 3, 0.0), (3, 3, 0.0), (9, 3, 0.0), (1, 3, 0.0), (2, 1, 0.0)]))
    assert [(r.line_no, r.track_id) for r in tracks.orderBy("line_no").collect()] == [(0, 1), (1, 1), (3, 2), (4, 3)]


def test_thin_measures_from_the_last_kept(spark):
    rows = _fixes(spark, [(k, 3, 0.00004 * k) for k in range(6)])  # 4.4 m apart
    assert [r.line_no for r in sequence.thin(rows, 10.0).orderBy("line_no").collect()] == [0, 3]
    assert sequence.decimate_exact(rows, 2).count() == 3


def test_pulses_and_slips(spark):
    edges = [("d", t, e) for k in range(4) for t, e in ((k * 1_000_000, 1), (k * 1_000_000 + 100_000, 0))]
    kinds = {(r.edge, r.kind) for r in sequence.classify_pulses(spark.createDataFrame(edges, "device string, us long, edge int")).filter("us > 1000000").collect()}
    assert kinds == {(1, "1 Hz leading"), (0, "1 Hz trailing")}
    obs = spark.createDataFrame([(100, 1), (9000, None)], "locktime long, lli int")
    assert [r.lli for r in sequence.slip_flag(obs, 1000).collect()] == [3, None]


def test_sat_tracks_forget(spark):
    rows = [(5, u, float(u), 10.0) for u in (1, 2, 3)] + [(5, u, 1.0, 10.0) for u in (30, 31)] + [(6, 31, 2.0, 3.0)]
    got = sequence.sat_tracks(spark.createDataFrame(rows, "PRN int, update int, az double, el double")).collect()
    assert {(r.PRN, r.update) for r in got} == {(5, 30), (6, 31)}


def test_dop_needs_four(spark):
    sats = [("d", 1, p, a, e, True) for p, a, e in ((1, 0, 45), (2, 90, 45), (3, 180, 45), (4, 270, 45), (5, 0, 90))] + [("d", 2, 1, 0, 45, True)]
    got = enrich.dop_from_sky(spark.createDataFrame(sats, "device string, time int, PRN int, az int, el int, used boolean")).collect()
    assert len(got) == 1 and got[0].hdop == pytest.approx((got[0].xdop ** 2 + got[0].ydop ** 2) ** 0.5) and got[0].xdop == pytest.approx(1.0)


def test_orbit_radius_and_solvers_agree(spark):
    o = spark.createDataFrame([(5153.7, 0.01, 0.5, 0.9, 1.0, 2.0, 100000.0, 100500.0)], "sqrtA double, e double, M0 double, i0 double, omega double, Omega0 double, toe double, t double")
    a, b = (orbit.sat_position(o, solve=s).first() for s in (orbit.kepler, orbit.kepler_unrolled))
    assert (a.x, a.y, a.z) == pytest.approx((b.x, b.y, b.z), abs=1e-3)
    r = (a.x**2 + a.y**2 + a.z**2) ** 0.5
    assert 5153.7**2 * 0.99 <= r <= 5153.7**2 * 1.01


def test_nested(spark):
    sky = spark.createDataFrame([("d", 1, [(5, True), (6, False)]), ("d", None, [(7, True)])], "device string, time int, satellites array<struct<PRN:int,used:boolean>>")
    assert [r.PRN for r in nested.sat_records(sky).collect()] == [5, 6]
    health = spark.createDataFrame([(1, 2, {"SV1": 9, "SVH25": 0x20})], "TOW17 long, tSV int, HEALTH map<string,int>")
    assert {(r.sv, r.anti_spoof, r.data_bad) for r in nested.health_unpivot(health).collect()} == {(1, True, None), (25, None, True)}


def test_sinks(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 2, 3, 4, 5), 3, 1, 45.5, -7.25, 100.0)], "time timestamp, mode int, status int, lat double, lon double, altMSL double")
    body = sinks.to_gga(df).first().value
    assert body.startswith("$GPGGA,030405.000,4530.00000,N,00715.00000,W,1,00,") and body.endswith("*" + _xor(body[1:-3]))
    assert sinks.to_kml(df.withColumns({"speed": F.lit(0.1), "track": F.lit(5.0), "altHAE": F.lit(1.0)})).first().value.count("heading") == 0
    assert sinks.csv_rows(df, ("mode", "speed")).first()[:] == ("3", "")
    sky = spark.createDataFrame([([(p, 10.0, 20.0, 30.0, p < 3) for p in range(1, 6)], 3)], "satellites array<struct<PRN:int,el:double,az:double,ss:double,used:boolean>>, mode int")
    assert [r.value.split(",")[1:4] for r in sinks.to_gsv(sky).orderBy("part").collect()] == [["2", "1", "05"], ["2", "2", "05"]]
    assert sinks.to_gsa(sky).first().value.startswith("$GPGSA,A,3,01,02,,,")


def test_filters_and_joins(spark):
    rows = spark.createDataFrame([("TPV", "a", 1, None), ("AIS", "b", 24, "A"), ("AIS", "b", 5, None)], "class string, device string, type int, part string")
    assert filters.watch(rows, "b", ("AIS",)).count() == 2
    assert filters.types(rows, (5,)).count() == 2
    assert filters.unsplit24(rows).count() == 2
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in joins.differences(a, b).collect()) == [(1, "a"), (2, "a"), (3, "b")]
    assert joins.timeline(rows, a).count() == 6


def test_empty_tables_give_no_rows(spark):
    empty = spark.createDataFrame([], "device string, line_no long, time timestamp, mode int, lat double, lon double, altHAE double")
    for f in (profile.space_profile, profile.cep_percentiles, profile.max_3d, sequence.segment_tracks, lambda d: sequence.thin(d, 1.0)):
        assert f(empty).count() == 0


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("select earth_distance(0D, 0D, 0D, 10D) a, earth_distance_small(0D, 0D, 10D, 0D) b, norm_deg(-90D) c, posix2gps(1609459200, 18) d").first()
    assert (r.a, r.b, r.c, r.d) == (pytest.approx(1113194, rel=1e-5), pytest.approx(1105854, rel=1e-2), 270.0, 1293494418)


def test_stream_of_reports_ends_cycles(spark, tmp_path, no_idle_batches):
    rows = [("d", k, tod, lat, 0.0, 3, "GGA") for k, (tod, lat) in enumerate([(1.0, 5.0), (None, 6.0), (2.0, 7.0), (3.0, 8.0)])]
    schema = "device string, line_no long, tod double, lat double, lon double, mode int, tag string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming.end_of_cycle(stream, 60_000).writeStream.format("memory").queryName("cycles").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    ended = q.awaitTermination(60)
    q.stop()
    assert ended
    assert {(r.tod, r.lat, r.n) for r in spark.table("cycles").collect()} >= {(1.0, 6.0, 2), (2.0, 7.0, 1)}


#: Sentences with the values that were written into them, or that are published with them.
SENTENCES = [
    ("!AIVDM,1,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ,0*4A", {"type": 1, "mmsi": 371798000, "status": 0, "turn": -127, "speed": 123, "accuracy": True, "lon": -74037230, "lat": 29028980, "course": 2240, "heading": 215, "second": 33, "maneuver": 0, "raim": False, "radio": 0x84E1}),
    ("!AIVDM,1,1,,B,177KQJ5000G?tO`K>RA1wUbN0TKH,0*5C", {"type": 1, "mmsi": 477553000, "status": 5, "turn": 0, "speed": 0, "accuracy": False, "lon": -73407500, "lat": 28549700, "course": 510, "heading": 181, "second": 15, "maneuver": 0, "raim": False}),
]


def encoded(type_: int, mmsi: int, *fields: tuple[int, int]) -> str:
    """A sentence of (value, bits) fields after type, repeat and ship, put together bit by bit."""
    bits = "".join(format(v % (1 << n), f"0{n}b") for v, n in ((type_, 6), (0, 2), (mmsi, 30), *fields))
    pad = -len(bits) % 6
    codes = [int((bits + "0" * pad)[k : k + 6], 2) for k in range(0, len(bits), 6)]
    body = "AIVDM,1,1,,A," + "".join(chr(48 + c + 8 * (c >= 40)) for c in codes) + f",{pad}"
    check = 0
    for c in body:
        check ^= ord(c)
    return f"!{body}*{check:02X}"


def letters(text: str, n: int) -> tuple[int, int]:
    """Six-bit text of n characters, filled up with @."""
    value = 0
    for c in text.ljust(n, "@"):
        value = value * 64 + ord(c) % 64
    return value, 6 * n


def test_sentences_have_their_known_values(spark):
    """Whole sentences beside hand-written values: all of them agree."""
    known = [
        *SENTENCES,
        (encoded(4, 3660713, (2024, 14), (2, 4), (29, 5), (23, 5), (59, 6), (58, 6), (1, 1), (-73407500, 28), (28549700, 27), (7, 4), (0, 10), (1, 1), (131071, 19)), {"type": 4, "mmsi": 3660713, "timestamp": "2024-02-29T23:59:58Z", "lon": -73407500, "lat": 28549700, "epfd": 7, "raim": True, "radio": 131071, "accuracy": True}),
        (encoded(9, 111232511, (303, 12), (42, 10), (0, 1), (-3762600, 28), (34800000, 27), (1545, 12), (15, 6), (0, 8), (1, 1), (0, 3), (1, 1), (0, 1), (33392, 20)), {"type": 9, "mmsi": 111232511, "alt": 303, "speed": 42, "lon": -3762600, "lat": 34800000, "course": 1545, "second": 15, "dte": 1, "raim": False, "radio": 33392}),
        (encoded(14, 351809000, (0, 2), letters("RCVD YR TEST MSG", 16)), {"type": 14, "mmsi": 351809000, "text": "RCVD YR TEST MSG"}),
        (encoded(18, 367430530, (0, 8), (0, 10), (0, 1), (-73360398, 28), (22671062, 27), (0, 12), (511, 9), (55, 6), (0, 2), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (0, 1), (0, 1), (917510, 20)), {"type": 18, "mmsi": 367430530, "lon": -73360398, "lat": 22671062, "heading": 511, "second": 55, "cs": True, "msg22": True, "raim": False, "radio": 917510}),
        (encoded(21, 123456789, (20, 5), letters("CHINA ROSE MURPHY EX", 20), (0, 1), (-73619519, 28), (28792599, 27), (5, 9), (5, 9), (5, 6), (5, 6), (1, 4), (50, 6), (0, 1), (165, 8), (0, 1), (1, 1), (0, 1), (0, 1)), {"type": 21, "name": "CHINA ROSE MURPHY EX", "aid_type": 20, "lon": -73619519, "lat": 28792599, "to_bow": 5, "to_starboard": 5, "epfd": 1, "second": 50, "regional": 165, "virtual_aid": True}),
        (encoded(22, 3160048, (0, 2), (2087, 12), (2088, 12), (0, 4), (0, 1), (-79800, 18), (29500, 17), (-80100, 18), (29000, 17), (0, 1), (0, 1), (1, 1), (2, 3), (0, 23)), {"type": 22, "channel_a": 2087, "channel_b": 2088, "ne_lon": -79800, "ne_lat": 29500, "sw_lon": -80100, "sw_lat": 29000, "addressed": False, "band_b": True, "zonesize": 2, "dest1": None}),
        (encoded(23, 2268120, (0, 2), (157, 18), (3064, 17), (109, 18), (2040, 17), (6, 4), (0, 8), (0, 22), (2, 2), (9, 4), (15, 4), (0, 6)), {"type": 23, "ne_lon": 157, "ne_lat": 3064, "sw_lon": 109, "sw_lat": 2040, "stationtype": 6, "shiptype": 0, "txrx": 2, "interval": 9, "quiet": 15}),
        (encoded(27, 206914217, (0, 1), (0, 1), (2, 4), (82214, 18), (2904, 17), (57, 6), (167, 9), (0, 1), (0, 1)), {"type": 27, "status": 2, "lon": 82214, "lat": 2904, "speed": 57, "course": 167, "gnss": False}),
    ]
    rows = [("d", k, sentence) for k, (sentence, _) in enumerate(known)]
    messages = ais.messages(spark.createDataFrame(rows, "file string, line_no long, value string"))
    got = {r.line_no: r.asDict() for t in {w["type"] for _, w in known} for r in ais.decode_type(messages, t).collect()}
    for k, (_, want) in enumerate(known):
        assert {c: got[k][c] for c in want} == want


def test_lines_of_a_file_in_many_parts(spark, tmp_path):
    """Line numbers don't depend on the parts that a file is read in."""
    from meridian.sources.readers import read_sentences

    want = []
    for name, n in (("a.log", 3000), ("b.log", 1), ("c.log", 0)):
        lines = ["" if k % 5 == 0 else f"${'x' * (k * 7 % 60)}{k} " for k in range(n)]
        (tmp_path / name).write_bytes("\r\n".join(lines).encode())
        want += [(name, k + 1, x.rstrip(" ")) for k, x in enumerate(lines) if x]
    whole = read_sentences(spark, str(tmp_path))
    conf = {"spark.sql.files.maxPartitionBytes": "701", "spark.sql.files.openCostInBytes": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        parts = read_sentences(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
        for df in (parts, whole):
            assert sorted((r.file.rpartition("/")[2], r.line_no, r.value) for r in df.collect()) == sorted(want)
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_moments_in_sql(spark):
    register_functions(spark)
    spark.range(500).selectExpr("id % 3 as k", "45.123456D + pow(id % 17, 3) * 1e-7D as x").createOrReplaceTempView("given")
    for kind in ("standard", "reference"):
        got = spark.sql(f"select k, shape_of(count(x), avg(x), stddev_samp(x), skewness(x), kurtosis(x), '{kind}') as s from given group by k").collect()
        want = {r.k: r for r in profile.stats_1d(spark.table("given"), "x", ("k",), kind).collect()}
        assert all(r.s.skewness == pytest.approx(want[r.k].skewness) and r.s.kurtosis == pytest.approx(want[r.k].kurtosis) for r in got)


def test_scaling_is_by_type(spark):
    rows = spark.createDataFrame([(1, 123, -74037230, 2240), (9, 123, -74037230, 2240), (27, 12, -74037, 224), (17, 12, 1000, 0)], "type int, speed long, lon long, course long")
    got = [(r.speed, r.lon, r.course) for r in ais.scale_ais(rows).orderBy("type").collect()]
    assert got == [(12.3, pytest.approx(-123.39538), 224.0), (123.0, pytest.approx(-123.39538), 224.0), (1.2, pytest.approx(1000 / 600), 0.0), (12.0, None if 74037 >= 181 * 600 else pytest.approx(-74037 / 600), 224.0)]


def test_reports_of_a_second_count_from_the_last_reported(spark):
    rows = [("d", k, dt.datetime(2020, 1, 1) + dt.timedelta(milliseconds=250 * k), 3) for k in range(8)]
    got = sequence.one_per_second(spark.createDataFrame(rows, "device string, line_no long, time timestamp, mode int"))
    assert [r.line_no for r in got.orderBy("line_no").collect()] == [3, 4]


def test_errors_that_are_given_stay(spark):
    rows = [("d", k, dt.datetime(2020, 1, 1, 0, 0, k), 3, 45.0 + k / 1e4, 7.0, 3.0, 4.0, 5.0, 9.0 if k == 1 else None) for k in range(3)]
    got = enrich.rate_errors(spark.createDataFrame(rows, "device string, line_no long, time timestamp, mode int, lat double, lon double, epx double, epy double, epv double, eps double"))
    assert [r.eps for r in got.orderBy("line_no").collect()] == [None, 9.0, 8.0]


def test_stations_across_the_date_line_and_near_a_pole(spark):
    stations = spark.createDataFrame([("east", 10.0, 179.9), ("west", 10.0, -179.9), ("pole", 89.5, 90.0), ("far", 10.0, 90.0)], "server string, lat double, lon double")
    fixes = spark.createDataFrame([(1, 10.0, 179.95), (2, 10.0, -179.95), (3, 89.0, 90.0)], "line_no long, lat double, lon double")
    got = {}
    for r in joins.nearest_stations(fixes, stations).collect():
        got.setdefault(r.line_no, []).append(r.server)
    assert sorted(got[1]) == ["east", "west"] and sorted(got[2]) == ["east", "west"] and got[3] == ["pole"]


def test_vessel_reports_have_the_fields_of_their_types(spark):
    from meridian.sources.readers import report_table

    line = '{"class":"AIS","device":"d","type":5,"mmsi":1,"imo":9,"callsign":"C","draught":2.5,"waypoints":[{"lon":1.5,"lat":2.5}]}'
    rows = spark.createDataFrame([(line, "AIS")], "value string, class string")
    row = report_table(rows, "AIS").first()
    assert (row.imo, row.callsign, row.draught, row.waypoints[0].lat, row.lat) == (9, "C", 2.5, 2.5, None)
