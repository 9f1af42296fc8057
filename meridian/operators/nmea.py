"""Sentence decoding as projections: every sentence type is one select over the split fields.

The rows keep (device, line_no); a decoded row has the columns of FIELDS, null where its sentence has nothing to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.functions.geo import KNOTS_TO_MPS
from meridian.functions.gnss import PRN_RANGES, SYSTEM_RANGES
from meridian.operators.scan import SLICE, scan

#: Fixed values. Position qualities and mode letters as fix statuses (1 plain, 2 differential, 3 and 4 RTK, ...).
QUALITY_STATUS = {"0": 0, "1": 1, "2": 2, "3": 1, "4": 3, "5": 4, "6": 5, "7": 7, "8": 8}
FAA_STATUS = {"A": 1, "C": 1, "D": 2, "E": 5, "F": 4, "M": 7, "N": 0, "P": 1, "R": 3, "S": 8, "V": 0}
#: Fixed values. Systems by talker.
TALKER_GNSS = {"GP": 0, "GL": 6, "GA": 2, "GB": 3, "BD": 3, "PQ": 3, "GI": 7, "GQ": 5, "QZ": 5}
#: Fixed values. Signals of the reports by system (their numbering) and signal field of the sentence.
SIGNAL = {
    0: {0: 0, 1: 4, 5: 4, 6: 3, 7: 6, 8: 7},
    6: {0: 0, 1: 0, 3: 2},
    2: {0: 0, 1: 3, 2: 5, 4: 10, 5: 8, 6: 0, 7: 4},
    3: {0: 0, 1: 0, 2: 2, 3: 5, 4: 0, 5: 7, 8: 4, 11: 2},
    5: {0: 0, 1: 0, 4: 1, 5: 4, 6: 5, 7: 8, 8: 9},
    7: {0: 0, 1: 0},
}
FEET, FATHOMS = 0.3048, 1.8288
LONGEST = 1024

FIELDS = (
    "device", "line_no", "tag", "talker", "tod", "date", "mode", "status", "lat", "lon", "altMSL", "geoidSep", "speed", "track", "magtrack", "magvar", "hdop", "pdop", "vdop", "used_count",
    "dgpsAge", "dgpsSta", "rms", "major", "minor", "orient", "lat_err", "lon_err", "alt_err", "epx", "epy", "epv", "heading", "rot", "depth", "wtemp", "wanglet", "wanglem", "wangler", "wspeedt", "wspeedr", "pitch", "roll", "mag_x", "mag_y", "mag_z", "datum", "text", "nav_status",
)


def checksum(body: Column) -> Column:
    """XOR of the characters' codes. Where all are of one byte, seven of them at a time make a number; these numbers'
    XOR is folded."""
    nothing = F.lit(0).cast("bigint")

    def of(text: Column) -> Column:
        codes = F.aggregate(F.transform(F.split(text, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a.bitwiseXOR(c))
        seven = lambda k: F.coalesce(F.conv(F.hex(F.substring(text, k, F.lit(7))), 16, 10).cast("bigint"), nothing)
        sevens = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(7)), nothing, lambda a, k: a.bitwiseXOR(seven(k)), _folded)
        return F.when(F.length(text) == F.octet_length(text), sevens).otherwise(codes)

    return told_once(body, of)


def told_once(value: Column, of) -> Column:
    """of(value), for which value is worked out once."""
    return F.transform(F.array(value), of)[0]


def _folded(x: Column) -> Column:
    """XOR of the bytes of a number of up to seven."""
    for k in (32, 16, 8):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseAND(255).cast("int")


def hex_checksum(body: Column) -> Column:
    return F.lpad(F.hex(checksum(body)), 2, "0")


def _between(value: Column) -> Column:
    """What stands between the first character and the last *."""
    return F.regexp_extract(value, r"^[$!](.*)\*[^*]*$", 1)


def checksum_ok(value: Column) -> Column:
    """Whether the two hex digits after the last * agree; sentences of one maker's kind are exempt."""
    given = F.regexp_extract(value, r"^[$!].*\*([0-9A-Fa-f]{2})", 1)
    return value.startswith("$STI,") | ((given != "") & (F.translate(given, "abcdef", "ABCDEF") == hex_checksum(_between(value))))


def once(expr: Column) -> Column:
    """The value through a generator of one row: Spark neither repeats it where it is used nor pushes filters below."""
    return F.explode(F.array(expr))


def tokenise(lines: DataFrame, value: str = "value") -> DataFrame:
    """Valid sentences split into fields f (f[0]: talker and tag), with talker and tag."""
    v = F.col(value)
    good = lines.filter(v.startswith("$") & (F.length(v) <= LONGEST) & checksum_ok(v))
    body = F.regexp_extract(v, r"^\$([^*\x00-\x1f]*)", 1)
    out = good.withColumn("f", once(F.split(body, ","))).filter(F.length(F.get("f", F.lit(0))) >= 5)
    return out.withColumns({"talker": F.substring(F.get("f", F.lit(0)), 1, 2), "tag": F.expr("substring(get(f, 0), 3)")})


def _f(i: int) -> Column:
    """Field i; null where empty or absent."""
    c = F.try_element_at("f", F.lit(i + 1))
    return F.when(F.trim(c) != "", F.trim(c))


def _at(places: dict[str, int], ok: Column | None = None) -> Column:
    """The field at the place that the sentence has it; null where empty, absent, not ok or without place."""
    at = F.lit(None).cast("int")
    for k in sorted(set(places.values())):
        at = F.when(F.col("tag").isin(*[tag for tag, p in places.items() if p == k]), k + 1).otherwise(at)
    c = F.try_element_at("f", at if ok is None else F.when(ok, at))
    return F.when(F.trim(c) != "", F.trim(c))


def _d(i: int) -> Column:
    return _f(i).try_cast("double")


def _i(i: int) -> Column:
    return _f(i).try_cast("int")


def _map(c: Column, names: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c]


def degrees(value: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm and a hemisphere letter as signed degrees."""
    sign = F.when(hemisphere.isin("S", "W"), F.lit(-1.0)).when(hemisphere.isin("N", "E"), F.lit(1.0))
    return sign * told_once(value.try_cast("double"), lambda x: F.floor(x / 100) + (x - F.floor(x / 100) * 100) / 60)


def date_ddmmyy(c: Column) -> Column:
    """The date; years below 69 are of this century."""
    return told_once(c, _ddmmyy)


def _ddmmyy(c: Column) -> Column:
    year = F.substring(c, 5, 2).try_cast("int")
    good = c.rlike("^[0-9]{6}$") & F.substring(c, 1, 2).between("01", "31") & F.substring(c, 3, 2).between("01", "12")
    return F.when(good, F.try_to_timestamp(F.concat((year + F.when(year < 69, 2000).otherwise(1900)).cast("string"), F.substring(c, 3, 2), F.substring(c, 1, 2)), F.lit("yyyyMMdd")).cast("date"))


def time_of_day(c: Column) -> Column:
    """Seconds of the day of hhmmss.sss."""
    return told_once(c, _hhmmss)


def _hhmmss(c: Column) -> Column:
    good = c.rlike(r"^[0-9]{6}(\.[0-9]*)?$")
    return F.when(good, F.substring(c, 1, 2).cast("int") * 3600 + F.substring(c, 3, 2).cast("int") * 60 + F.expr("0").cast("double") + F.regexp_extract(c, r"^[0-9]{4}(.*)$", 1).cast("double"))


#: Fixed values. Places of the time, and of latitude, its hemisphere, longitude and its hemisphere, by sentence.
TOD_AT = {"GGA": 1, "RMC": 1, "GLL": 5, "GNS": 1, "GST": 1, "GBS": 1, "GRS": 1, "ZDA": 1, "BWC": 1}
POSITION_AT = {"GGA": 2, "RMC": 3, "GLL": 1, "GNS": 2}


def _shared_fields() -> dict[str, Column]:
    """Fields that many sentences have, each picked once."""
    ok = F.when(F.col("tag") == "RMC", _f(2) == "A").when(F.col("tag") == "GLL", _f(6) == "A").otherwise(True)
    position = {f"__{name}": _at({tag: k + j for tag, k in POSITION_AT.items()}, ok) for j, name in enumerate(("lat", "ns", "lon", "ew"))}
    return {"__tod": _at(TOD_AT), "__date": _at({"RMC": 9}), **position}


def _shared() -> dict[str, Column]:
    """Columns told from the shared fields."""
    x = F.col
    return {"tod": time_of_day(x("__tod")), "lat": degrees(x("__lat"), x("__ns")), "lon": degrees(x("__lon"), x("__ew"))}


def _unknown_if_absent(mode: Column) -> Column:
    return F.when(mode.isNotNull(), mode).otherwise(F.lit(1))


def _decoders() -> dict[str, dict[str, Column]]:
    """Sentence -> its columns but the shared ones. Numbers are positions of fields in the public sentence descriptions."""
    gga_status = _map(_f(6), QUALITY_STATUS)
    rmc_ok, gll_ok = _f(2) == "A", _f(6) == "A"
    rmc_status = F.when(rmc_ok, F.coalesce(_map(_f(12), FAA_STATUS), F.lit(1))).otherwise(0)
    gns_status = F.coalesce(_map(F.substring(_f(6), 1, 1), FAA_STATUS), F.lit(0))
    fixed = lambda status, alt, n: F.when(status == 0, 1).when(alt.isNotNull() & (n >= 4), 3).otherwise(2)
    signed = lambda k: _d(k) * F.when(_f(k + 1) == "W", -1.0).otherwise(1.0)
    wind_speed = _d(3) * F.when(_f(4) == "N", KNOTS_TO_MPS).when(_f(4) == "K", 1 / 3.6).when(_f(4) == "M", 1.0)
    wind_ok = _f(5) == "A"
    return {
        "GGA": {"status": gga_status, "mode": fixed(gga_status, _d(9), _i(7)), "used_count": _i(7), "hdop": _d(8), "altMSL": _d(9), "geoidSep": _d(11), "dgpsAge": _d(13), "dgpsSta": F.when(_f(13).isNotNull(), _i(14))},
        "RMC": {"date": date_ddmmyy(F.col("__date")), "status": rmc_status, "mode": F.when(rmc_ok, 2).otherwise(1), "speed": F.when(rmc_ok, _d(7) * KNOTS_TO_MPS), "track": F.when(rmc_ok, _d(8)), "magvar": F.when(rmc_ok, signed(10)), "nav_status": _f(13)},
        "GLL": {"status": F.when(gll_ok, F.coalesce(_map(_f(7), FAA_STATUS), F.lit(1))).otherwise(0), "mode": F.when(gll_ok, 2).otherwise(1)},
        "GNS": {"status": gns_status, "mode": fixed(gns_status, _d(9), _i(7)), "used_count": _i(7), "hdop": _d(8), "altMSL": _d(9), "geoidSep": _d(10), "dgpsAge": _d(11), "dgpsSta": _i(12), "nav_status": _f(13)},
        "GSA": {"mode": F.when(_i(2).between(1, 3), _i(2)), "pdop": _d(15), "hdop": _d(16), "vdop": _d(17)},
        "GST": {"rms": _d(2), "major": _d(3), "minor": _d(4), "orient": _d(5), "lat_err": _d(6), "lon_err": _d(7), "alt_err": _d(8)},
        "GBS": {"epy": _d(2), "epx": _d(3), "epv": _d(4)},
        "GRS": {},
        "VTG": {"track": _d(1), "magtrack": _d(3), "speed": F.coalesce(_d(5) * KNOTS_TO_MPS, _d(7) / 3.6)},
        "ZDA": {"date": F.when(_i(2).between(1, 31) & _i(3).between(1, 12) & (_i(4) >= 1900), F.try_to_timestamp(F.format_string("%04d%02d%02d", _i(4), _i(3), _i(2)), F.lit("yyyyMMdd")).cast("date"))},
        "HDG": {"magtrack": _d(1) + F.coalesce(_d(2) * F.when(_f(3) == "W", -1.0).otherwise(1.0), F.lit(0.0)), "magvar": signed(4)},
        "HDM": {"magtrack": _d(1)},
        "HDT": {"heading": _d(1)},
        "THS": {"heading": F.when(_f(2) != "V", _d(1))},
        "ROT": {"rot": F.when(_f(2) == "A", _d(1))},
        "DBT": {"depth": F.coalesce(_d(3), _d(1) * FEET, _d(5) * FATHOMS)},
        "DPT": {"depth": F.when(_d(2) < 0, _d(1) - _d(2)).otherwise(_d(1))},
        "MTW": {"wtemp": F.when(_f(2) == "C", _d(1))},
        "MWD": {"wanglet": _d(1), "wanglem": _d(3), "wspeedt": F.coalesce(_d(7), _d(5) * KNOTS_TO_MPS)},
        "MWV": {"wangler": F.when(wind_ok & (_f(2) == "R"), _d(1)), "wspeedr": F.when(wind_ok & (_f(2) == "R"), wind_speed), "wanglet": F.when(wind_ok & (_f(2) == "T"), _d(1)), "wspeedt": F.when(wind_ok & (_f(2) == "T"), wind_speed)},
        "XDR": _transducers(),
        "DTM": {"datum": _map(_f(1), {"W84": "WGS84", "W72": "WGS72", "S85": "SGS85", "P90": "PE90", "999": "User Defined"})},
        "TXT": {"text": _f(4)},
        "BWC": {},
    }


def _transducers() -> dict[str, Column]:
    """Quadruples (type, value, unit, name) by name."""
    quads = F.transform(F.sequence(F.lit(1), F.greatest(F.size("f") - 4, F.lit(1)), F.lit(4)), lambda k: F.struct(F.upper(F.get("f", k + 3)).alias("name"), F.get("f", k + 1).try_cast("double").alias("value")))
    named = lambda *names: F.get(F.filter(quads, lambda q: q["name"].isin(*names)), F.lit(0))["value"]
    return {"pitch": named("PITCH", "PTCH"), "roll": named("ROLL"), "mag_x": named("MAGX"), "mag_y": named("MAGY"), "mag_z": named("MAGZ")}


_TYPES = {"line_no": "bigint", "date": "date", "mode": "int", "status": "int", "used_count": "int", "dgpsSta": "int", "text": "string", "datum": "string", "nav_status": "string", "tag": "string", "talker": "string", "device": "string"}
SENTENCES = tuple(sorted({"GGA", "RMC", "GLL", "GNS", "GSA", "GST", "GBS", "GRS", "VTG", "ZDA", "HDG", "HDM", "HDT", "THS", "ROT", "DBT", "DPT", "MTW", "MWD", "MWV", "XDR", "DTM", "TXT", "BWC"}))


def decode(lines: DataFrame, device: str = "file", value: str = "value") -> DataFrame:
    """All fix sentences (not GSV) of (device, line_no, value) lines as rows of FIELDS. One pass, no shuffle."""
    rows = told_apart(lines, device, value)
    return rows.select(*[c.alias(name) for name, c in columns_of().items()])


def told_apart(lines: DataFrame, device: str = "file", value: str = "value") -> DataFrame:
    """Fix sentences (device, line_no, tag, talker) with their fields, of which columns_of() tells the columns."""
    rows = tokenise(lines, value).filter(F.col("tag").isin(*SENTENCES))
    return rows.select(F.col(device).cast("string").alias("device"), F.col("line_no").cast("bigint").alias("line_no"), "tag", "talker", "f").withColumns(_shared_fields())


def columns_of() -> dict[str, Column]:
    """The columns of FIELDS, from the fields of a sentence."""
    decoders, shared = _decoders(), _shared()
    columns = {}
    for name in FIELDS:
        kind = _TYPES.get(name, "double")
        if name in ("device", "line_no", "tag", "talker"):
            columns[name] = F.col(name)
        elif name in shared:
            columns[name] = shared[name].cast(kind)
        else:
            cases = [(tag, d[name]) for tag, d in decoders.items() if name in d]
            value_ = F.lit(None).cast(kind)
            for tag, c in cases:
                value_ = F.when(F.col("tag") == tag, c.cast(kind)).otherwise(value_)
            columns[name] = value_
    return columns


def _dated() -> Column:
    return F.when(F.col("date").isNotNull(), F.struct("date", F.col("tod").alias("at")))


def _with_day(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("__seen", F.coalesce(_dated(), F.col("__seen")))
    wrapped = (F.col("tod") < F.col("__seen.at") - 43200).cast("int")
    return rows.withColumn("day", F.date_add("__seen.date", F.coalesce(wrapped, F.lit(0)))).drop("__seen")


def carry_date(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """Adds day: the last date of the device so far, null before the first; a day on where the time wraps since."""
    return _with_day(scan(rows, ("device",), "line_no", {"__seen": _dated()}, size=size))


def _new_epoch(step: float):
    return lambda now, before: F.when(before.isNull() | (F.abs(now - before) > step), 1).otherwise(0)


def epochs(rows: DataFrame, step: float = 0.01, size: int = SLICE, costly: bool = False) -> DataFrame:
    """Adds epoch: it goes up where a sentence's time differs by over step seconds from the time before. Sentences
    without time belong to the epoch that they arrive in; those before the first time to epoch 0."""
    return scan(rows, ("device",), "line_no", {"__before": F.col("tod")}, total=("epoch", "__before", _new_epoch(step)), size=size, costly=costly).drop("__before")


def dated_epochs(rows: DataFrame, step: float = 0.01, size: int = SLICE) -> DataFrame:
    """Adds day and epoch in one scan, as carry_date and epochs do in two."""
    both = {"__seen": _dated(), "__before": F.col("tod")}
    rows = scan(rows, ("device",), "line_no", both, total=("epoch", "__before", _new_epoch(step)), size=size, costly=True)
    return _with_day(rows.drop("__before"))


def cycle_enders(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """Per device the tags that were the last timed ones before the time went on, and how often."""
    timed = scan(rows.filter("tod is not null"), ("device",), "line_no", {"__before": F.struct("epoch", "tag")}, size=size)
    return timed.filter("__before.epoch <> epoch").groupBy("device", F.col("__before.tag").alias("tag")).agg(F.count("*").alias("n"))


def cycle_report(rows: DataFrame) -> DataFrame:
    """Per device: cycles, distinct tag lists, whether all agree (first and last cycle left out), enders, and the
    enders that also occur inside a cycle."""
    bursts = rows.filter("epoch > 0").groupBy("device", "epoch").agg(F.array_sort(F.collect_list(F.struct("line_no", "tag"))).alias("b"))
    bursts = bursts.select("device", "epoch", F.transform("b", lambda x: x["tag"]).alias("tags"), F.element_at(F.transform("b", lambda x: x["tag"]), -1).alias("ender"))
    edge = W.partitionBy("device")
    inner = bursts.withColumns({"lo": F.min("epoch").over(edge), "hi": F.max("epoch").over(edge)}).filter("epoch > lo and epoch < hi")
    out = inner.groupBy("device").agg(F.count("*").alias("cycles"), F.count_distinct("tags").alias("kinds"), F.array_sort(F.collect_set("ender")).alias("enders"), F.array_distinct(F.flatten(F.collect_set(F.expr("slice(tags, 1, greatest(size(tags) - 1, 0))")))).alias("__inside"))
    enough = F.when(F.col("kinds") == 1, F.col("cycles") >= 4).otherwise(F.col("cycles") >= 6)
    return out.select("device", "cycles", "kinds", F.when(enough, F.col("kinds") == 1).alias("regular"), "enders", F.array_intersect("enders", "__inside").alias("also_inside"))


def stale_gga(rows: DataFrame, size: int = SLICE, costly: bool = False) -> DataFrame:
    """A position sentence repeating the time of its talker's last one tells that the lock is lost."""
    rows = scan(rows, ("device", "tag", "talker"), "line_no", {"__before": F.struct("tod")}, size=size, costly=costly)
    stale = F.coalesce((F.col("tag") == "GGA") & (F.col("tod") == F.col("__before.tod")), F.lit(False))
    return rows.withColumns({"mode": F.when(stale, 1).otherwise(F.col("mode")), "status": F.when(stale, 0).otherwise(F.col("status"))}).drop("__before")


def merge_fix(rows: DataFrame) -> DataFrame:
    """One fix per (device, epoch): the last value of each field; status only rises; position, position errors and
    differential fields go together; the mode is the last one, but a sentence without altitude doesn't undo 3D."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    pair = lambda a, b: F.max_by(F.struct(a, b), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col("line_no"))).alias(f"__{a}")
    single = [c for c in FIELDS if c not in ("device", "line_no", "tag", "talker", "mode", "status", "lat", "lon", "dgpsAge", "dgpsSta", "tod", "date", "lat_err", "lon_err", "epx", "epy")]
    flat = F.col("tag").isin("RMC", "GLL")
    merged = rows.filter("epoch > 0").groupBy("device", "epoch").agg(
        F.min("line_no").alias("line_no"),
        last("tod"),
        last("day"),
        F.max("status").alias("status"),
        F.max_by("mode", F.when(F.col("mode").isNotNull(), F.col("line_no"))).alias("__mode"),
        F.max(F.when(~flat, F.col("mode"))).alias("__full"),
        pair("lat", "lon"),
        pair("lat_err", "lon_err"),
        pair("epx", "epy"),
        pair("dgpsAge", "dgpsSta"),
        *[last(c) for c in single],
    )
    mode = F.when((F.col("__full") == 3) & (F.col("__mode") == 2), 3).otherwise(F.col("__mode"))
    seconds = F.unix_micros(F.col("day").cast("timestamp")) + F.round(F.col("tod") * 1e6).cast("long")
    return merged.withColumns({"mode": mode, "lat": F.col("__lat.lat"), "lon": F.col("__lat.lon"), "lat_err": F.col("__lat_err.lat_err"), "lon_err": F.col("__lat_err.lon_err"), "epx": F.col("__epx.epx"), "epy": F.col("__epx.epy"), "dgpsAge": F.col("__dgpsAge.dgpsAge"), "dgpsSta": F.col("__dgpsAge.dgpsSta"), "time": F.timestamp_micros(seconds)}).drop("__mode", "__full", "__lat", "__lat_err", "__epx", "__dgpsAge")


def fixes(lines: DataFrame, device: str = "file", value: str = "value") -> DataFrame:
    """Sentence lines to fixes: date, epoch, decode, lost lock, merge. Only date and time are told before the scans, which
    carry the sentence's fields, so that a line is read once and only what is asked for is decoded."""
    told, rows = columns_of(), told_apart(lines, device, value)
    early = {name: told[name] for name in ("tod", "date", "mode", "status")}
    rows = stale_gga(dated_epochs(rows.withColumns(early)), costly=True)
    kept = {*early, "device", "line_no", "tag", "talker"}
    return merge_fix(rows.withColumns({name: c for name, c in told.items() if name not in kept}))


def sat_identity(sats: DataFrame) -> DataFrame:
    """(gnssid, svid) of satellite numbers by range; numbers up to 32 take the talker's system. Numbers in no range are
    of system 0, with number 0. A column system, if there is one, is the sentence's system field."""
    prn = F.col("PRN")
    by_talker = F.when(prn.between(1, 32), _map(F.col("talker"), TALKER_GNSS))
    gnss, svid = F.coalesce(by_talker, ranged(prn, PRN_RANGES, 2)), ranged(prn, PRN_RANGES, 3)
    if "system" in sats.columns:  # the system field of later sentence versions decides where there is one
        for field in range(1, 7):
            own = [r[1:] for r in SYSTEM_RANGES if r[0] == field]
            here = F.col("system") == field
            gnss, svid = F.when(here, ranged(prn, own, 2)).otherwise(gnss), F.when(here, ranged(prn, own, 3)).otherwise(svid)
    return sats.withColumns({"gnssid": F.coalesce(gnss, F.lit(0)), "svid": F.coalesce(svid, F.lit(0))})


def ranged(prn: Column, ranges, what: int) -> Column:
    """Of the range that a number is in: the system (2), or the number within it (3); null in none."""
    out = F.lit(None).cast("int")
    for low, high, system, off in ranges:
        out = F.when(prn.between(low, high), F.lit(system) if what == 2 else prn - off).otherwise(out)
    return out


def gsv_parts(lines: DataFrame, device: str = "file", value: str = "value") -> DataFrame:
    """GSV sentences: part of parts, and up to four satellites."""
    rows = tokenise(lines, value).filter("tag = 'GSV' and size(f) >= 4")
    n = F.floor((F.size("f") - 4) / 4)
    sats = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda k: F.struct(*[F.get("f", 4 + 4 * k + j).try_cast(t).alias(name) for j, (name, t) in enumerate((("PRN", "int"), ("el", "double"), ("az", "double"), ("ss", "double")))]))
    signal = F.when((F.size("f") - 4) % 4 == 1, F.element_at("f", -1))
    return rows.select(F.col(device).alias("device"), "line_no", "talker", _i(1).alias("parts"), _i(2).alias("part"), _i(3).alias("in_view"), signal.alias("signal"), F.when(n > 0, F.filter(sats, lambda s: s["PRN"].isNotNull())).alias("sats"))


def assemble_gsv(parts: DataFrame, size: int = SLICE) -> DataFrame:
    """Complete series of parts as one skyview (device, line_no of the last part, talker, signal, satellites). A series
    that lacks a part, or whose azimuths are all zero or absent, is dropped."""
    parts = parts.withColumn("signal", F.coalesce("signal", F.lit("")))
    begins = {"__first": F.when(F.col("part") == 1, 1)}
    series = scan(parts, ("device", "talker", "signal"), "line_no", begins, total=("series", "__first", lambda *_: F.lit(1)), size=size).filter("series > 0")
    out = series.groupBy("device", "talker", "signal", "series").agg(
        F.max("line_no").alias("line_no"), F.count("*").alias("__n"), F.max("parts").alias("__of"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "sats"))), lambda x: F.coalesce(x["sats"], F.array()))).alias("satellites")
    )  # a series has few parts, so the list is small
    return out.filter("__n = __of").filter(F.exists("satellites", lambda s: s["az"] != 0)).drop("__n", "__of")


def union_skyview(series: DataFrame, rows: DataFrame, size: int = SLICE) -> DataFrame:
    """Satellites of all talkers' series of an epoch: (device, epoch, talker, PRN, el, az, ss). Series get the epoch
    that they arrive in, from the decoded rows."""
    marks = rows.select("device", "line_no", "epoch").withColumn("satellites", F.lit(None).cast(series.schema["satellites"].dataType)).withColumn("talker", F.lit(None).cast("string"))
    both = series.select("device", "line_no", F.lit(None).cast("bigint").alias("epoch"), "satellites", "talker").unionByName(marks)
    placed = scan(both, ("device",), "line_no", {"__epoch": F.col("epoch")}, size=size).filter("satellites is not null").withColumn("epoch", F.col("__epoch")).drop("__epoch")
    return placed.select("device", "epoch", "talker", F.explode("satellites").alias("s")).select("device", "epoch", "talker", "s.*")


def gsa_used(lines: DataFrame, device: str = "file", value: str = "value") -> DataFrame:
    """Satellites named as used: (device, line_no, talker, PRN, system)."""
    rows = tokenise(lines, value).filter("tag = 'GSA' and size(f) >= 18")
    named = F.filter(F.transform(F.slice("f", 4, 12), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return rows.select(F.col(device).alias("device"), "line_no", "talker", _i(18).alias("system"), F.explode(named).alias("PRN"))


def mark_used(sats: DataFrame, used: DataFrame) -> DataFrame:
    """Adds used: whether the satellite is named in its epoch. Both have (device, epoch, PRN) and talker or gnssid and
    svid; satellites agree by system and number within it."""
    sats, used = (d if {"gnssid", "svid"} <= set(d.columns) else sat_identity(d) for d in (sats, used))
    by = ["device", "epoch", "gnssid", "svid"]
    named = used.select(*by).distinct().withColumn("__used", F.lit(True))
    return sats.join(named, by, "left").withColumn("used", F.coalesce("__used", F.lit(False))).drop("__used")


def signal_id(gnssid: Column, signal: Column) -> Column:
    """The report's signal number of a sentence's hexadecimal one; 0 where it isn't known."""
    keys = {g * 16 + s: to for g, signals in SIGNAL.items() for s, to in signals.items()}
    return F.when(signal.isNotNull(), F.coalesce(_map(gnssid * 16 + F.conv(signal, 16, 10).cast("int"), keys), F.lit(0)))
