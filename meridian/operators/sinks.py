"""Exports. Each builds rows of text or typed columns as a DataFrame; writing is Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.functions import gnss
from meridian.functions.geo import MPS_TO_KNOTS, clamp_error, polar_xy
from meridian.operators.nmea import hex_checksum
from meridian.operators.sequence import segment_tracks


def csv_rows(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Selected fields as text, missing ones empty."""
    return df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])


def write_csv(df: DataFrame, path: str, fields: tuple[str, ...], header: int = 1, sep: str = ",") -> None:
    """header 0: none, 1: names, 2: names after `# `."""
    rows = csv_rows(df, fields)
    if header < 2:
        rows.write.option("header", header == 1).option("sep", sep).option("emptyValue", "").csv(path)
        return
    text = rows.select(F.concat_ws(sep, *fields).alias("value"), F.lit(1).alias("k"))
    head = df.sparkSession.createDataFrame([("# " + sep.join(fields), 0)], "value string, k int")
    head.unionByName(text).select("value").write.text(path)


def gpx_point(tracks: DataFrame) -> Column:
    """A fix as a track point."""
    fix = F.when(F.col("status") == 2, "dgps").when(F.col("mode") == 3, "3d").when(F.col("mode") == 2, "2d").otherwise("none")
    optional = lambda c, form: F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c).cast("double"))).otherwise("") if c in tracks.columns else F.lit("")
    sat = F.when((F.col("mode") > 1) & (F.col("uSat") > 0), F.format_string("<sat>%d</sat>", F.col("uSat").cast("int"))).otherwise("") if "uSat" in tracks.columns else F.lit("")
    time = F.coalesce(F.concat(F.lit("<time>"), F.date_format(F.col("time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("</time>")), F.lit(""))
    return F.concat(
        F.format_string('<trkpt lat="%.9f" lon="%.9f">', "lat", "lon"), optional("altHAE", "<ele>%.4f</ele>"), time, F.lit("<fix>"), fix, F.lit("</fix>"), sat,
        optional("hdop", "<hdop>%.1f</hdop>"), optional("vdop", "<vdop>%.1f</vdop>"), optional("pdop", "<pdop>%.1f</pdop>"), optional("depth", "<extensions><depth>%.2f</depth></extensions>"), F.lit("</trkpt>"),
    )


def to_gpx(tracks: DataFrame, order: str = "line_no") -> DataFrame:
    """One <trk> per (device, track_id) of segmented fixes as a row; points in order. For tracks of any length: gpx_lines."""
    lines = tracks.select("device", "track_id", F.col(order).alias("k"), gpx_point(tracks).alias("value"))
    trk = lines.groupBy("device", "track_id").agg(F.concat(F.lit("<trk><trkseg>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "\n"), F.lit("</trkseg></trk>")).alias("value"))
    return trk  # a track is bounded by its gap; GPX_HEAD and GPX_FOOT go around the rows


#: Keys of the lines of a document: head, body and foot; then within the body.
KEYS = ("section", "device", "part", "place", "k")


def document(body: DataFrame, head: str, foot: str) -> DataFrame:
    """Lines (KEYS, value) of a document with its first and last line."""
    ends = body.sparkSession.createDataFrame([(0, head), (2, foot)], "section int, value string")
    return body.unionByName(ends, allowMissingColumns=True).select(*KEYS, "value")


def write_document(lines: DataFrame, path: str) -> None:
    """The lines in order: Spark sorts them into ranges, one file each, whose names are in order too, and commits them
    together. The files one after the other are the document, whatever their number."""
    lines.orderBy(*KEYS).select("value").write.text(path)


def gpx_lines(tracks: DataFrame, order: str = "line_no") -> DataFrame:
    """A document of segmented fixes, a line each; no row holds a whole track."""
    point = tracks.select("device", F.col("track_id").cast("long").alias("part"), F.lit(1).alias("place"), F.col(order).cast("long").alias("k"), gpx_point(tracks).alias("value"))
    each = point.select("device", "part").distinct()
    ends = [each.select("device", "part", F.lit(place).alias("place"), F.lit(None).cast("long").alias("k"), F.lit(text).alias("value")) for place, text in ((0, "<trk><trkseg>"), (2, "</trkseg></trk>"))]
    return document(point.unionByName(ends[0]).unionByName(ends[1]).withColumn("section", F.lit(1)), GPX_HEAD, GPX_FOOT)


def kml_lines(tpv: DataFrame, order: str = "line_no") -> DataFrame:
    """A document of placemarks in order."""
    marks = tpv.select(F.lit(1).alias("section"), "device", F.lit(None).cast("long").alias("part"), F.lit(1).alias("place"), F.col(order).cast("long").alias("k"), kml_mark().alias("value"))
    return document(marks, KML_HEAD, KML_FOOT)


GPX_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<gpx version="1.1" creator="meridian" xmlns="http://www.topografix.com/GPX/1/1">'
GPX_FOOT = "</gpx>"


def gpx_of(tpv: DataFrame, timeout: int = 5, order: str = "line_no") -> DataFrame:
    return to_gpx(segment_tracks(tpv, timeout, order=order), order)


KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
KML_FOOT = "</Document></kml>"


def kml_mark() -> Column:
    """A placemark; the heading is shown from 1 km/h on."""
    kph = F.coalesce(F.col("speed"), F.lit(0.0)) * 3.6
    text = F.when(kph >= 1, F.format_string("%.1f km/h, heading %.0f", kph, F.coalesce(F.col("track"), F.lit(0.0)))).otherwise(F.format_string("%.1f km/h", kph))
    return F.concat(F.lit("<Placemark><description>"), text, F.format_string("</description><Point><coordinates>%.7f,%.7f,%.2f</coordinates></Point></Placemark>", "lon", "lat", F.coalesce(F.col("altHAE"), F.lit(0.0))))


def to_kml(tpv: DataFrame) -> DataFrame:
    """A placemark per fix."""
    return tpv.select(kml_mark().alias("value"))


def sentence(body: Column) -> Column:
    """$body*checksum."""
    return F.transform(F.array(body), lambda b: F.concat(F.lit("$"), b, F.lit("*"), hex_checksum(b)))[0]  # body is worked out once


def _angle(c: Column, width: int, positive: str, negative: str) -> Column:
    minutes = F.round(F.abs(c) * 60, 5)
    whole = F.floor(minutes / 60)
    return F.when(c.isNull(), ",").otherwise(F.concat(F.format_string(f"%0{width}d%08.5f", whole.cast("long"), minutes - whole * 60), F.lit(","), F.when(c < 0, negative).otherwise(positive)))


def _position() -> Column:
    return F.concat(_angle(F.col("lat"), 2, "N", "S"), F.lit(","), _angle(F.col("lon"), 3, "E", "W"))


def _clock(form: str = "HHmmss.SSS") -> Column:
    return F.coalesce(F.date_format(F.col("time").cast("timestamp"), form), F.lit(""))


def _number(c: str, form: str, df: DataFrame) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c).cast("double"))).otherwise("") if c in df.columns else F.lit("")


def to_gga(tpv: DataFrame) -> DataFrame:
    n = F.format_string("%02d", F.coalesce(F.col("uSat"), F.lit(0)).cast("int")) if "uSat" in tpv.columns else F.lit("00")
    body = F.concat_ws(",", F.lit("GPGGA"), _clock(), _position(), F.when(F.col("mode") < 2, "0").when(F.col("status") == 2, "2").otherwise("1"), n, _number("hdop", "%.2f", tpv), _number("altMSL", "%.2f", tpv), F.lit("M"), _number("geoidSep", "%.2f", tpv), F.lit("M"), F.lit(""), F.lit(""))
    return tpv.withColumn("value", sentence(body))


def to_rmc(tpv: DataFrame) -> DataFrame:
    knots = F.when(F.col("speed").isNotNull(), F.format_string("%.4f", F.col("speed") * MPS_TO_KNOTS)).otherwise("") if "speed" in tpv.columns else F.lit("")
    body = F.concat_ws(",", F.lit("GPRMC"), _clock(), F.when(F.col("mode") > 1, "A").otherwise("V"), _position(), knots, _number("track", "%.3f", tpv), _clock("ddMMyy"), F.lit(""), F.lit(""), F.when(F.col("mode") < 2, "N").when(F.col("status") == 2, "D").otherwise("A"))
    return tpv.withColumn("value", sentence(body))


def to_zda(tpv: DataFrame) -> DataFrame:
    return tpv.withColumn("value", sentence(F.concat(F.lit("GPZDA,"), _clock(), F.lit(","), _clock("dd,MM,yyyy"), F.lit(",00,00"))))


def to_gbs(tpv: DataFrame) -> DataFrame:
    body = F.concat_ws(",", F.lit("GPGBS"), _clock(), _number("epy", "%.3f", tpv), _number("epx", "%.3f", tpv), _number("epv", "%.3f", tpv), F.lit(""), F.lit(""), F.lit(""), F.lit(""))
    return tpv.withColumn("value", sentence(body))


#: Fixed values. Fields of an almanac sentence with their forms; all but the first two in hexadecimal digits.
ALMANAC_FIELDS = (("sv", "%02d"), ("week", "%04d"), ("svh", "%02x"), ("e", "%04x"), ("toa", "%02x"), ("deltai", "%04x"), ("Omegad", "%04x"), ("sqrtA", "%05x"), ("omega", "%06x"), ("Omega0", "%06x"), ("M0", "%06x"), ("af0", "%03x"), ("af1", "%03x"))


def to_alm(almanac: DataFrame) -> DataFrame:
    """Almanac sentences from an almanac's unscaled numbers; the week is taken modulo 1024."""
    values = [F.col(c) % 1024 if c == "week" else F.col(c) for c, _ in ALMANAC_FIELDS]
    body = F.format_string("GPALM,1,1," + ",".join(f for _, f in ALMANAC_FIELDS), *[v.cast("int") for v in values])
    return almanac.withColumn("value", sentence(body))


def to_gsa(sky: DataFrame) -> DataFrame:
    """Used satellites (twelve fit) and dilutions, with the fix's mode beside the skyview."""
    used = F.transform(F.slice(F.filter("satellites", lambda s: s["used"]), 1, 12), lambda s: F.format_string("%02d", s["PRN"]))
    padded = F.concat(used, F.array_repeat(F.lit(""), F.lit(12) - F.size(used)))
    body = F.concat_ws(",", F.lit("GPGSA"), F.lit("A"), F.coalesce(F.col("mode"), F.lit(1)).cast("string"), F.array_join(padded, ","), _number("pdop", "%.2f", sky), _number("hdop", "%.2f", sky), _number("vdop", "%.2f", sky))
    return sky.withColumn("value", sentence(body))


def to_gsv(sky: DataFrame) -> DataFrame:
    """Pages of four satellites."""
    n = F.size("satellites")
    pages = F.greatest(F.ceil(n / 4), F.lit(1)).cast("int")
    rows = sky.withColumns({"__n": n, "__pages": pages}).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("__pages"))))
    show = lambda x, form: F.coalesce(F.format_string(form, x.cast("int")), F.lit(""))
    four = F.transform(F.slice(F.col("satellites"), (F.col("part") - 1) * 4 + 1, F.lit(4)), lambda s: F.concat_ws(",", F.format_string("%02d", s["PRN"]), F.when(s["el"].isNotNull(), show(s["el"], "%02d")).otherwise(""), F.when(s["az"].isNotNull(), show(s["az"], "%03d")).otherwise(""), F.when(s["ss"].isNotNull(), show(s["ss"], "%02d")).otherwise("")))
    body = F.concat_ws(",", F.lit("GPGSV"), F.col("__pages").cast("string"), F.col("part").cast("string"), F.format_string("%02d", "__n"), F.array_join(four, ","))
    return rows.withColumn("value", sentence(body)).drop("__n", "__pages")


def to_report_json(tpv: DataFrame) -> DataFrame:
    """Report lines: absent fields left out, no geometry below 2D, no climb below 3D, tiny velocities as 0."""
    flat = [c for c in ("lat", "lon", "epx", "epy", "eph", "track", "speed", "eps", "epd") if c in tpv.columns]
    deep = [c for c in ("altHAE", "altMSL", "epv", "climb", "epc", "sep", "ecefx", "ecefy", "ecefz", "ecefvx", "ecefvy", "ecefvz") if c in tpv.columns]
    out = tpv.withColumns({c: F.when(F.col("mode") >= 2, F.col(c)) for c in flat} | {c: F.when(F.col("mode") >= 3, F.col(c)) for c in deep})
    out = out.withColumns({c: F.when(F.abs(c) < 0.0005, 0.0).otherwise(F.col(c)) for c in ("climb", "velN", "velE", "velD") if c in tpv.columns})
    return out.select(F.to_json(F.struct(F.lit("TPV").alias("class"), *[c for c in out.columns if c != "class"]), {"ignoreNullFields": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}).alias("value"))


def to_psv(rows: DataFrame, sep: str = "|") -> DataFrame:
    """All columns of a decoded message type as one separated line; absent ones empty, flags as 0 and 1."""
    text = [F.coalesce((F.col(c).cast("int") if t == "boolean" else F.col(c)).cast("string"), F.lit("")) for c, t in rows.dtypes if not t.startswith(("struct", "array", "map"))]
    return rows.select(F.concat_ws(sep, *text).alias("value"))


def sky_plot_points(sats: DataFrame, radius: float = 100.0, floor: float = 30.0) -> DataFrame:
    """Screen positions, and bar heights scaled by the strongest signal (floor at least)."""
    x, y = polar_xy("az", "el", radius)
    top = F.greatest(F.max("ss").over(W.partitionBy("device", "time")), F.lit(floor))
    return sats.withColumns({"x": x, "y": y, "bar": F.col("ss") / top})


def error_circle(tpv: DataFrame, err: str = "eph", low: float = 5.0, high: float = 75.0) -> DataFrame:
    value, marker = clamp_error(err, low, high)
    return tpv.withColumns({"error": value, "marker": marker})


def rinex_rows(obs: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """Observation rows (epoch, sat, value): per satellite its codes' values as F14.3 with lock and strength digits.

    obs: epoch, sat, code, value, lli, flag.
    """
    cell = F.when(F.col("value").isNotNull(), F.concat(F.format_string("%14.3f", "value"), F.when(F.col("lli") > 0, F.col("lli").cast("string")).otherwise(" "), F.when(F.col("flag") > 0, F.col("flag").cast("string")).otherwise(" "))).otherwise(" " * 16)
    wide = obs.withColumn("cell", cell).groupBy("epoch", "sat").pivot("code", list(codes)).agg(F.first("cell"))
    return wide.select("epoch", "sat", F.concat("sat", *[F.coalesce(c, F.lit(" " * 16)) for c in codes]).alias("value"))


#: Fixed values. Systems of an observation header in its order, with their phase shift lines.
HEADER_SYSTEMS = ((0, ("G L1C", "G L2C")), (1, ("S L1C", "E L5Q")), (2, ("E L1C", "E L7Q")), (3, ("B L1C", "B L7I")), (5, ("J L1C", "J L2C")), (6, ("R L1C", "R L2C")))


def _headed(text: Column, name: str) -> Column:
    """A header line: the text in 60 characters and the line's name in 20."""
    return F.concat(F.rpad(text, 60, " "), F.lit(name.ljust(20)))


def _moment(t: Column) -> Column:
    at = F.timestamp_micros((t * 1_000_000).cast("long"))
    parts = [F.year(at), F.month(at), F.dayofmonth(at), F.hour(at), F.minute(at), F.second(at), ((t * 10_000_000).cast("long") % 10_000_000)]
    return F.format_string("%6d    %02d    %02d    %02d    %02d   %02d.%07d        GPS", *parts)


def rinex_header(counts: DataFrame, span: DataFrame, leap_seconds: int, stamp: str, marker: str = "XXXX", marker_type: str = "GEODETIC", observer: str = "Unknown", agency: str = "Unknown", comment: str = "", program: str = "meridian") -> DataFrame:
    """(k, value): the lines of an observation file's header, in the order of k.

    counts: obs_counts of the data, with the codes of header systems; span: its obs_span, times in seconds. Each system
    lists its codes in order, twelve at most to a line of the format; satellites list their counts by those codes, nine
    to a line, blank where there is none. Both are tables of a row per satellite and code, so the joins are small.
    """
    spark = counts.sparkSession
    order = {g: i for i, (g, _) in enumerate(HEADER_SYSTEMS)}
    known = counts.filter(F.col("gnssid").isin(*order) & (F.col("svid") > 0))
    letter = lambda c: gnss.rinex_system(c)
    pad = lambda s, n: f"{s[:n]:<{n}}"
    fixed = [
        (f"{'3.05':>9}{'':11}{'OBSERVATION DATA':<20}{'M: Mixed':<20}", "RINEX VERSION / TYPE"),
        (pad(program, 20) + " " * 20 + pad(stamp, 20), "PGM / RUN BY / DATE"),
        (pad(comment, 60), "COMMENT"),
        (pad(marker, 60), "MARKER NAME"),
        (pad(marker_type, 60), "MARKER TYPE"),
        (pad(observer, 20) + pad(agency, 40), "OBSERVER / AGENCY"),
        ("0".ljust(20) + "Unknown".ljust(20) + "0".ljust(20), "REC # / TYPE / VERS"),
        ("0".ljust(20) + "Unknown".ljust(40), "ANT # / TYPE"),
    ]
    top = spark.createDataFrame([(i, text + name.ljust(20)) for i, (text, name) in enumerate(fixed)], "k long, value string")
    place = F.format_string("%14.4f%14.4f%14.4f", "position.ecefx", "position.ecefy", "position.ecefz")
    where = span.filter("position.ecefx is not null and position.ecefy is not null and position.ecefz is not null").select(F.lit(100).cast("long").alias("k"), _headed(place, "APPROX POSITION XYZ").alias("value"))
    antenna = span.select(F.lit(101).cast("long"), _headed(F.lit(f"{0.0:14.4f}" * 3), "ANTENNA: DELTA H/E/N"))
    rank = gnss.label(F.col("gnssid"), order)
    systems = known.groupBy("gnssid").agg(F.array_sort(F.collect_set("code")).alias("codes"))  # codes of a system: a few
    lines = systems.filter("gnssid <> 6").withColumn("part", F.explode(F.sequence(F.lit(0), ((F.size("codes") - 1) / 12).cast("int"))))
    first = F.when(F.col("part") == 0, F.concat(letter(F.col("gnssid")), F.format_string("%5d", F.size("codes")))).otherwise(" " * 6)
    listed = F.array_join(F.transform(F.slice("codes", F.col("part") * 12 + 1, F.lit(12)), lambda c: F.lpad(c, 4, " ")), "")
    types = lines.select((rank * 100 + F.col("part") + 200).cast("long"), _headed(F.concat(first, listed), "SYS / # / OBS TYPES"))
    number = known.select("gnssid", "svid").distinct().agg(F.count("*").alias("n")).select(F.lit(1000).cast("long"), _headed(F.format_string("%6d", "n"), "# OF SATELLITES"))
    of_sat = known.groupBy("gnssid", "svid").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("of")).join(systems, "gnssid")
    of_sat = of_sat.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.size("codes") - 1) / 9).cast("int"))))
    cells = F.array_join(F.transform(F.slice("codes", F.col("part") * 9 + 1, F.lit(9)), lambda c: F.coalesce(F.when(F.col("of")[c] > 0, F.lpad(F.col("of")[c].cast("string"), 6, " ")), F.lit(" " * 6))), "")
    sat = F.when(F.col("part") == 0, F.concat(F.lit("   "), letter(F.col("gnssid")), F.format_string("%02d", F.col("svid") % 100))).otherwise(" " * 6)
    sats = of_sat.select((F.col("gnssid") * 100000 + F.col("svid") * 100 + F.col("part") + 10000).cast("long"), _headed(F.concat(sat, cells), "PRN / # OF OBS"))
    facts = span.select(
        F.posexplode(
            F.array(
                _headed(F.lit("DBHZ"), "SIGNAL STRENGTH UNIT"),
                _headed(F.format_string("%10.3f", F.coalesce("interval", F.lit(0.0)).cast("double")), "INTERVAL"),
                _headed(_moment(F.col("first")), "TIME OF FIRST OBS"),
                _headed(_moment(F.col("last")), "TIME OF LAST OBS"),
            )
        ).alias("k", "value")
    ).select((F.col("k") + 10_000_000).cast("long"), "value")
    shifts = F.create_map(*[F.lit(x) for g, texts in HEADER_SYSTEMS for x in (g, "|".join(texts))])
    shift = systems.select(rank.alias("r"), F.posexplode(F.split(shifts[F.col("gnssid")], "\\|"))).select((F.col("r") * 10 + F.col("pos") + 20_000_000).cast("long"), _headed(F.col("col"), "SYS / PHASE SHIFT"))
    end = spark.createDataFrame([(30_000_000, f"{leap_seconds:6d}{'':18}GPS{'':33}" + "LEAP SECONDS".ljust(20)), (30_000_001, " " * 60 + "END OF HEADER".ljust(20))], "k long, value string")
    out = top
    for part in (where, antenna, types, number, sats, facts, shift, end):
        out = out.union(part)
    return out


def to_rinex3(obs: DataFrame, codes: tuple[str, ...], header: DataFrame) -> DataFrame:
    """Header lines, then each epoch with its satellites: (part, epoch, k, value), to be sorted by the first three.

    header: (k, value) of rinex_header.
    """
    body = rinex_rows(obs, codes)
    marks = obs.groupBy("epoch").agg(F.count_distinct("sat").alias("n"))
    stamp = F.date_format(F.timestamp_seconds("epoch"), "yyyy MM dd HH mm ")
    head = marks.select(F.lit(1).alias("part"), "epoch", F.lit("").alias("k"), F.concat(F.lit("> "), stamp, F.format_string("%10.7f  0%3d", F.col("epoch") % 60.0, "n")).alias("value"))
    top = header.select(F.lit(0).alias("part"), F.lit(0).cast(obs.schema["epoch"].dataType).alias("epoch"), F.format_string("%09d", "k").alias("k"), "value")
    return top.unionByName(head).unionByName(body.select(F.lit(1).alias("part"), "epoch", F.col("sat").alias("k"), "value"))


def write_tables(tables: dict[str, DataFrame], path: str, time: str = "time") -> None:
    """Typed Parquet by class, in folders by date."""
    for name, df in tables.items():
        dated = df.withColumn("date", F.to_date(time)) if time in df.columns else df
        writer = dated.write.mode("append")
        (writer.partitionBy("date") if time in df.columns else writer).parquet(f"{path}/{name.lower()}")
