"""Vessel messages (AIVDM) as a Spark job: lines, fragments, bits, and one select per message type.

Layouts are those of the public ITU-R M.1371 description: name, first bit, length, kind (u unsigned, s signed, b flag,
t six-bit text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.operators.nmea import checksum_ok, once
from meridian.operators.scan import SLICE, scan

#: Fixed values. The six-bit alphabet.
SIXBIT = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_ !\"#$%&'()*+,-./0123456789:;<=>?"
_DIMENSIONS = "to_bow {0} 9 u, to_stern {1} 9 u, to_port {2} 6 u, to_starboard {3} 6 u"


def _dimensions(at: int) -> str:
    return _DIMENSIONS.format(at, at + 9, at + 18, at + 24)


#: Fixed values. Message layouts by type.
LAYOUTS = {
    (1, 2, 3): "status 38 4 u, turn 42 8 s, speed 50 10 u, accuracy 60 1 b, lon 61 28 s, lat 89 27 s, course 116 12 u, heading 128 9 u, second 137 6 u, maneuver 143 2 u, raim 148 1 b, radio 149 19 u",
    (4, 11): "year 38 14 u, month 52 4 u, day 56 5 u, hour 61 5 u, minute 66 6 u, second 72 6 u, accuracy 78 1 b, lon 79 28 s, lat 107 27 s, epfd 134 4 u, raim 148 1 b, radio 149 19 u",
    (5,): f"ais_version 38 2 u, imo 40 30 u, callsign 70 42 t, shipname 112 120 t, shiptype 232 8 u, {_dimensions(240)}, epfd 270 4 u, month 274 4 u, day 278 5 u, hour 283 5 u, minute 288 6 u, draught 294 8 u, destination 302 120 t, dte 422 1 u",
    (6,): "seqno 38 2 u, dest_mmsi 40 30 u, retransmit 70 1 b, dac 72 10 u, fid 82 6 u",
    (7, 13): "mmsi1 40 30 u, mmsi2 72 30 u, mmsi3 104 30 u, mmsi4 136 30 u",
    (8,): "dac 40 10 u, fid 50 6 u",
    (9,): "alt 38 12 u, speed 50 10 u, accuracy 60 1 b, lon 61 28 s, lat 89 27 s, course 116 12 u, second 128 6 u, regional 134 8 u, dte 142 1 u, raim 147 1 b, radio 148 20 u",
    (10,): "dest_mmsi 40 30 u",
    (12,): "seqno 38 2 u, dest_mmsi 40 30 u, retransmit 70 1 b",
    (14,): "",
    (15,): "mmsi1 40 30 u, type1_1 70 6 u, offset1_1 76 12 u, type1_2 90 6 u, offset1_2 96 12 u, mmsi2 110 30 u, type2_1 140 6 u, offset2_1 146 12 u",
    (16,): "mmsi1 40 30 u, offset1 70 12 u, increment1 82 10 u, mmsi2 92 30 u, offset2 122 12 u, increment2 134 10 u",
    (17,): "lon 40 18 s, lat 58 17 s",
    (18,): "reserved 38 8 u, speed 46 10 u, accuracy 56 1 b, lon 57 28 s, lat 85 27 s, course 112 12 u, heading 124 9 u, second 133 6 u, regional 139 2 u, cs 141 1 b, display 142 1 b, dsc 143 1 b, band 144 1 b, msg22 145 1 b, raim 147 1 b, radio 148 20 u",
    (19,): f"reserved 38 8 u, speed 46 10 u, accuracy 56 1 b, lon 57 28 s, lat 85 27 s, course 112 12 u, heading 124 9 u, second 133 6 u, regional 139 4 u, shipname 143 120 t, shiptype 263 8 u, {_dimensions(271)}, epfd 301 4 u, raim 305 1 b, dte 306 1 u, assigned 307 1 b",
    (20,): ", ".join(f"offset{k} {40 + 30 * i} 12 u, number{k} {52 + 30 * i} 4 u, timeout{k} {56 + 30 * i} 3 u, increment{k} {59 + 30 * i} 11 u" for i, k in enumerate((1, 2, 3, 4))),
    (21,): f"aid_type 38 5 u, name 43 120 t, accuracy 163 1 b, lon 164 28 s, lat 192 27 s, {_dimensions(219)}, epfd 249 4 u, second 253 6 u, off_position 259 1 b, regional 260 8 u, raim 268 1 b, virtual_aid 269 1 b",
    (22,): "channel_a 40 12 u, channel_b 52 12 u, txrx 64 4 u, power 68 1 b, ne_lon 69 18 s, ne_lat 87 17 s, sw_lon 104 18 s, sw_lat 122 17 s, addressed 139 1 b, band_a 140 1 b, band_b 141 1 b, zonesize 142 3 u",
    (23,): "ne_lon 40 18 s, ne_lat 58 17 s, sw_lon 75 18 s, sw_lat 93 17 s, stationtype 110 4 u, shiptype 114 8 u, txrx 144 2 u, interval 146 4 u, quiet 150 4 u",
    (24,): f"partno 38 2 u, shipname 40 120 t, shiptype 40 8 u, vendorid 48 42 t, model 66 4 u, serial 70 20 u, callsign 90 42 t, {_dimensions(132)}, mothership_mmsi 132 30 u",
    (25,): "addressed 38 1 b, structured 39 1 b",
    (26,): "addressed 38 1 b, structured 39 1 b",
    (27,): "accuracy 38 1 b, raim 39 1 b, status 40 4 u, lon 44 18 s, lat 62 17 s, speed 79 6 u, course 85 9 u, gnss 94 1 b",
}
#: Fixed values. Least and most bits of a message by type.
LENGTHS = {1: (163, 204), 2: (163, 204), 3: (163, 204), 4: (168, 1192), 5: (420, 1192), 6: (88, 1192), 7: (72, 168), 8: (56, 1192), 9: (168, 1192), 10: (72, 1192), 11: (168, 1192), 12: (72, 1192), 13: (72, 168), 14: (40, 1192), 15: (88, 168), 16: (96, 168), 17: (80, 816), 18: (168, 1192), 19: (312, 1192), 20: (72, 186), 21: (272, 1192), 22: (168, 1192), 23: (160, 1192), 24: (160, 1192), 25: (40, 1192), 26: (60, 1192), 27: (96, 168)}
#: Fixed values. What follows the position and time in weather reports, from its first bit in type 8.
_WEATHER_11 = "wspeed 121 7 u, wgust 128 7 u, wdir 135 9 u, wgustdir 144 9 u, temperature 153 11 u, humidity 164 7 u, dewpoint 171 10 u, pressure 181 9 u, pressuretend 190 2 u, visibility 192 8 u, waterlevel 200 9 u, leveltrend 209 2 u, cspeed 211 8 u, cdir 219 9 u, cspeed2 228 8 u, cdir2 236 9 u, cdepth2 245 5 u, cspeed3 250 8 u, cdir3 258 9 u, cdepth3 267 5 u, waveheight 272 8 u, waveperiod 280 6 u, wavedir 286 9 u, swellheight 295 8 u, swellperiod 303 6 u, swelldir 309 9 u, seastate 318 4 u, watertemp 322 10 u, preciptype 332 3 u, salinity 335 9 u, ice 344 2 u"
_WEATHER_31 = "wspeed 122 7 u, wgust 129 7 u, wdir 136 9 u, wgustdir 145 9 u, airtemp 154 11 s, humidity 165 7 u, dewpoint 172 10 s, pressure 182 9 u, pressuretend 191 2 u, visgreater 193 1 b, visibility 194 7 u, waterlevel 201 12 u, leveltrend 213 2 u, cspeed 215 8 u, cdir 223 9 u, cspeed2 232 8 u, cdir2 240 9 u, cdepth2 249 5 u, cspeed3 254 8 u, cdir3 262 9 u, cdepth3 271 5 u, waveheight 276 8 u, waveperiod 284 6 u, wavedir 290 9 u, swellheight 299 8 u, swellperiod 307 6 u, swelldir 313 9 u, seastate 322 4 u, watertemp 326 10 s, preciptype 336 3 u, salinity 339 9 u, ice 348 2 u"
#: Fixed values. Services of a berth, two bits each from bit 141 on.
_SERVICES = "fuel chandler stevedore electrical water customs cartage crane lift medical navrepair provisions shiprepair surveyor steam tugs solidwaste liquidwaste hazardouswaste ballast additional regional1 regional2 future1 future2"
_BUOY = "ana_int 88 10 u, ana_ext1 98 10 u, ana_ext2 108 10 u, racon 118 2 u, light 120 2 u, alarm 122 1 b, stat_ext 123 8 u, off_pos 131 1 b"
_LOCK = "country 88 12 t, locode 100 18 t, section 118 30 t, terminal 148 30 t, hectometre 178 30 t, month 208 4 u, day 212 5 u, hour 217 5 u, minute 222 6 u"
_WAYPOINTS = "lon 0 28 s, lat 28 27 s"


def _route(at: int) -> str:
    names = (("linkage", 10), ("sender", 3), ("rtype", 5), ("month", 4), ("day", 5), ("hour", 5), ("minute", 6), ("duration", 18), ("waycount", 5))
    starts = [at + sum(n for _, n in names[:k]) for k in range(len(names))]
    return ", ".join(f"{name} {a} {n} u" for (name, n), a in zip(names, starts, strict=True))


#: Fixed values. Binary messages: type, dac, fid, least and most bits, layout from the message's first bit, and a list at
#: the end: its name, first bit, bits an entry, layout of an entry, most entries, and the field that counts them.
APPLICATIONS = (
    (6, 235, 10, 136, 136, _BUOY, None),
    (6, 250, 10, 136, 136, _BUOY, None),
    (6, 200, 21, 248, 248, f"{_LOCK}, tugs 228 3 u, airdraught 231 12 u", None),
    (6, 200, 22, 232, 232, f"{_LOCK}, status 228 2 u", None),
    (6, 200, 55, 168, 168, "crew 88 8 u, passengers 96 13 u, personnel 109 8 u", None),
    (6, 1, 12, 357, 1192, "lastport 88 30 t, lmonth 118 4 u, lday 122 5 u, lhour 127 5 u, lminute 132 6 u, nextport 138 30 t, nmonth 168 4 u, nday 172 5 u, nhour 177 5 u, nminute 182 6 u, dangerous 188 120 t, imdcat 308 24 t, unid 332 13 u, amount 345 10 u, unit 355 2 u", None),
    (6, 1, 14, 97, 1008, "month 88 4 u, day 92 5 u", ("tidals", 97, 93, "lat 0 27 s, lon 27 28 s, from_hour 55 5 u, from_min 60 6 u, to_hour 66 5 u, to_min 71 6 u, cdir 77 9 u, cspeed 86 7 u", 3, None)),
    (6, 1, 15, 67, 1008, "airdraught 56 11 u", None),
    (6, 1, 16, 136, 136, "persons 88 13 u", None),
    (6, 1, 16, 68, 135, "persons 55 13 u", None),
    (6, 1, 16, 137, 1192, "persons 55 13 u", None),
    (6, 1, 18, 317, 1192, "linkage 88 10 u, month 98 4 u, day 102 5 u, hour 107 5 u, minute 112 6 u, portname 118 120 t, destination 238 30 t, lon 268 25 s, lat 293 24 s", None),
    (6, 1, 20, 360, 1008, "linkage 88 10 u, berth_length 98 9 u, berth_depth 107 8 u, position 115 3 u, month 118 4 u, day 122 5 u, hour 127 5 u, minute 132 6 u, availability 138 1 u, agent 139 2 u, " + ", ".join(f"{n} {141 + 2 * k} 2 u" for k, n in enumerate(_SERVICES.split())) + ", berth_name 191 120 t, berth_lon 311 25 s, berth_lat 336 24 s", None),
    (6, 1, 25, 100, 1008, "unit 88 2 u, amount 90 10 u", ("cargos", 100, 17, "code 0 4 u, subtype 4 13 u", 28, None)),
    (6, 1, 28, 149, 1008, _route(88), ("waypoints", 149, 55, _WAYPOINTS, 16, "waycount")),
    (6, 1, 30, 98, 1008, "linkage 88 10 u, text 98 906 t", None),
    (6, 1, 32, 97, 1008, "month 88 4 u, day 92 5 u", ("tidals", 97, 88, "lon 0 25 s, lat 25 24 s, from_hour 49 5 u, from_min 54 6 u, to_hour 60 5 u, to_min 65 6 u, cdir 71 9 u, cspeed 80 8 u", 3, None)),
    (8, 1, 11, 346, 352, f"lat 56 24 s, lon 80 25 s, day 105 5 u, hour 110 5 u, minute 115 6 u, {_WEATHER_11}", None),
    (8, 1, 13, 468, 1192, "reason 56 120 t, closefrom 176 120 t, closeto 296 120 t, radius 416 10 u, extunit 426 2 u, fday 428 5 u, fmonth 433 4 u, fhour 437 5 u, fminute 442 6 u, tday 448 5 u, tmonth 453 4 u, thour 457 5 u, tminute 462 6 u", None),
    (8, 1, 15, 67, 1192, "airdraught 56 11 u", None),
    (8, 1, 16, 136, 136, "persons 88 13 u", None),
    (8, 1, 16, 72, 72, "persons 55 13 u", None),
    (8, 1, 17, 56, 1008, "", ("targets", 56, 122, "idtype 0 2 u, id 2 42 u, name 2 42 t, lat 48 24 s, lon 72 25 s, course 97 9 u, second 106 6 u, speed 112 10 u", 4, None)),
    (8, 1, 19, 258, 1008, "linkage 56 10 u, station 66 120 t, lon 186 25 s, lat 211 24 s, status 235 2 u, signal 237 5 u, hour 242 5 u, minute 247 6 u, nextsignal 253 5 u", None),
    (8, 1, 27, 117, 1008, _route(56), ("waypoints", 117, 55, _WAYPOINTS, 16, "waycount")),
    (8, 1, 29, 72, 1008, "linkage 56 10 u, text 66 942 t", None),
    (8, 1, 31, 350, 1192, f"lon 56 25 s, lat 81 24 s, accuracy 105 1 b, day 106 5 u, hour 111 5 u, minute 116 6 u, {_WEATHER_31}", None),
    (8, 200, 10, 168, 168, "vin 56 48 t, length 104 13 u, beam 117 10 u, shiptype 127 14 u, hazard 141 3 u, draught 144 11 u, loaded 155 2 u, speed_q 157 1 b, course_q 158 1 b, heading_q 159 1 b", None),
    (8, 200, 23, 256, 256, "start_year 56 8 u, start_month 64 4 u, start_day 68 5 u, end_year 73 8 u, end_month 81 4 u, end_day 85 5 u, start_hour 90 5 u, start_minute 95 6 u, end_hour 101 5 u, end_minute 106 6 u, start_lon 112 28 s, start_lat 140 27 s, end_lon 167 28 s, end_lat 195 27 s, type 222 4 u, min 226 9 s, max 235 9 s, intensity 244 2 u, wind 246 4 u", None),
    (8, 200, 24, 168, 168, "country 56 12 t", ("gauges", 68, 25, "id 0 11 u, level 11 14 s", 4, None)),
    (8, 200, 40, 168, 168, "lon 56 28 s, lat 84 27 s, form 111 4 u, facing 115 9 u, direction 124 3 u, status 127 30 u", None),
)
#: The largest hazard class of inland ships; more tell that a message is of another kind.
MOST_HAZARD = 5
#: Fixed values. Navigation statuses, position-fixing devices, kinds of ships, stations and aids to navigation.
STATUS_TEXT = dict(enumerate(("Under way using engine", "At anchor", "Not under command", "Restricted maneuverability", "Constrained by her draught", "Moored", "Aground", "Engaged in fishing", "Under way sailing", "Reserved for HSC", "Reserved for WIG", "Power-driven vessel towing astern", "Power-driven vessel pushing ahead or towing alongside", "Reserved", "AIS-SART is active", "Not defined")))
EPFD_TEXT = dict(enumerate(("Undefined", "GPS", "GLONASS", "Combined GPS/GLONASS", "Loran-C", "Chayka", "Integrated navigation system", "Surveyed", "Galileo", "Reserved (9)", "Reserved (10)", "Reserved (11)", "Reserved (12)", "Reserved (13)", "Reserved (14)", "Internal GNSS")))
SHIP_CLASSES = {2: "Wing in ground (WIG)", 4: "High speed craft (HSC)", 6: "Passenger", 7: "Cargo", 8: "Tanker", 9: "Other Type"}
SHIPS_3 = ("Fishing", "Towing", "Towing: length exceeds 200m or breadth exceeds 25m", "Dredging or underwater ops", "Diving ops", "Military ops", "Sailing", "Pleasure Craft", "Reserved", "Reserved")
SHIPS_5 = ("Pilot Vessel", "Search and Rescue vessel", "Tug", "Port Tender", "Anti-pollution equipment", "Law Enforcement", "Spare - Local Vessel", "Spare - Local Vessel", "Medical Transport", "Ship according to RR Resolution No. 18")
STATION_TEXT = dict(enumerate(("All types of mobiles", "Reserved for future use", "All types of Class B mobile stations", "SAR airborne mobile station", "Aid to Navigation station", "Class B shipborne mobile station", *["Regional use and inland waterways"] * 4, *["Reserved for future use"] * 6)))
AID_TEXT = dict(enumerate((
    "Unspecified", "Reference point", "RACON", "Fixed offshore structure", "Spare, Reserved for future use.", "Light, without sectors", "Light, with sectors", "Leading Light Front", "Leading Light Rear", "Beacon, Cardinal N", "Beacon, Cardinal E",
    "Beacon, Cardinal S", "Beacon, Cardinal W", "Beacon, Port hand", "Beacon, Starboard hand", "Beacon, Preferred Channel port hand", "Beacon, Preferred Channel starboard hand", "Beacon, Isolated danger", "Beacon, Safe water", "Beacon, Special mark",
    "Cardinal Mark N", "Cardinal Mark E", "Cardinal Mark S", "Cardinal Mark W", "Port hand Mark", "Starboard hand Mark", "Preferred Channel Port hand", "Preferred Channel Starboard hand", "Isolated danger", "Safe Water", "Special Mark", "Light Vessel / LANBY / Rigs",
)))


def _ship_types() -> dict[int, str]:
    """Kinds of ships by number: six classes of ten, two lists of ten."""
    out = {0: "Not available", **{k: "Reserved for future use" for k in range(1, 20)}, **dict(enumerate(SHIPS_3, 30)), **dict(enumerate(SHIPS_5, 50))}
    last = {2: "Reserved for future use", 9: "no additional information"}
    for tens, name in SHIP_CLASSES.items():
        kinds = ["all ships of this type", *(f"Hazardous category {x}" for x in "ABCD"), *["Reserved for future use"] * 4, last.get(tens, "No additional information")]
        out |= {10 * tens + k: f"{name} - {kind}" for k, kind in enumerate(kinds)}
    return out


SHIP_TEXT = _ship_types()
POSITION_NA = {"lon": 181, "lat": 91}
#: Types whose positions are in tenths of a minute.
COARSE = (17, 22, 23, 27)


def ais_lines(lines: DataFrame, device: str = "file", value: str = "value") -> DataFrame:
    """Valid fragments: (device, line_no, nfrags, ifrag, seq, channel, payload, pad). Channel 1 is A, 2 is B, blank A;
    others are rejected."""
    rows = lines.filter(F.col(value).startswith("!") & checksum_ok(F.col(value))).withColumn("f", once(F.split(F.regexp_extract(value, r"^!(.*)\*", 1), ",")))
    rows = rows.filter(F.expr("size(f) >= 7 and substring(get(f, 0), 3) in ('VDM', 'VDO')"))
    given = F.get("f", F.lit(4))
    channel = F.when(given.isin("", "A", "1"), "A").when(given.isin("B", "2"), "B")
    n = lambda i: F.get("f", F.lit(i)).try_cast("int")
    return rows.select(F.col(device).alias("device"), "line_no", n(1).alias("nfrags"), n(2).alias("ifrag"), F.get("f", F.lit(3)).alias("seq"), channel.alias("channel"), F.get("f", F.lit(5)).alias("payload"), F.coalesce(n(6), F.lit(0)).alias("pad")).filter("channel is not null and nfrags >= ifrag and ifrag >= 1")


def assemble_fragments(fragments: DataFrame, size: int = SLICE) -> DataFrame:
    """Whole messages (device, channel, line_no of the last part, payload, pad). Parts of a device and channel come one
    after the other; a first part starts anew, a part out of turn loses its message."""
    begins = {"__first": F.when(F.col("ifrag") == 1, 1)}
    rows = scan(fragments, ("device", "channel"), "line_no", begins, total=("__group", "__first", lambda *_: F.lit(1)), size=size, costly=True).drop("__first")
    rows = rows.filter("__group > 0").withColumn("__k", F.row_number().over(W.partitionBy("device", "channel", "__group").orderBy("line_no")))
    parts = rows.filter("__k <= nfrags").groupBy("device", "channel", "__group").agg(
        F.max("line_no").alias("line_no"),
        F.max("nfrags").alias("__of"),
        F.count("*").alias("__n"),
        F.bool_and(F.col("__k") == F.col("ifrag")).alias("__ok"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ifrag", "payload"))), lambda x: x["payload"]), "").alias("payload"),
        F.max_by("pad", "ifrag").alias("pad"),
    )  # a message has at most nine parts
    return parts.filter("__ok and __n = __of").drop("__group", "__of", "__n", "__ok")


#: The payload's 64 characters and those of the public base64 alphabet, in the order of their six-bit values.
ARMOR = "".join(chr(48 + v + 8 * (v >= 40)) for v in range(64))
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Zeros behind the bits, so that fields may reach over their end.
BEHIND = 64


def unarmor(payload: Column, pad: Column) -> Column:
    """The payload's bits as a struct of hexadecimal digits, zeros behind them, and the number n of bits without the
    padding; null for foreign characters. Six-bit characters are base64 in another alphabet."""
    whole = F.rpad(F.translate(payload, ARMOR, BASE64), (F.ceil(F.length(payload) / 4) * 4).cast("int"), "A")
    bits = F.struct(F.concat(F.hex(F.unbase64(whole)), F.lit("0" * BEHIND)).alias("hex"), (F.length(payload) * 6 - pad).cast("int").alias("n"))
    return F.when(payload.rlike("^[0-W`-w]*$"), bits)


def bit_length(bits: Column) -> Column:
    return bits["n"]


def _number(bits: Column, at: int, n: int) -> Column:
    """n bits, 50 at most, as a number; zeros beyond the end."""
    first, last = at // 4, (at + n - 1) // 4
    x = F.conv(F.substring(bits["hex"], first + 1, last - first + 1), 16, 10).cast("bigint")
    over = 4 * (last + 1) - at - n
    return (F.shiftright(x, over) if over else x).bitwiseAND((1 << n) - 1)


def unsigned(bits: Column, at: int, n: int) -> Column:
    """Bits at to at + n, null beyond the end."""
    return F.when(bit_length(bits) >= at + n, _number(bits, at, n))


def signed(bits: Column, at: int, n: int) -> Column:
    u = unsigned(bits, at, n)
    return F.when(u >= F.lit(1 << (n - 1)), u - F.lit(1 << n)).otherwise(u)


def _readable(hex_: Column) -> Column:
    """Six-bit text of whole groups of three bytes, up to an @, without spaces at its end."""
    return F.rtrim(F.substring_index(_characters(hex_), "@", 1))


def _characters(hex_: Column) -> Column:
    return F.translate(F.base64(F.unhex(hex_)), BASE64 + "\r\n", SIXBIT)


def sixbit(bits: Column, at: int, n: int) -> Column:
    """Six-bit text up to an @, without spaces at its end; what is left of it where the message ends before.

    From an even bit on, up to two zero digits before the digits bring the text to a whole character; from an odd one on
    it is read as numbers of 48 bits.
    """
    if at % 2:
        long = bits if n + 48 <= 4 * BEHIND else {"hex": F.rpad(bits["hex"], (at + n) // 4 + 13, "0")}
        groups = [F.lpad(F.hex(_number(long, at + k, 48)), 12, "0") for k in range(0, n, 48)]
        text = _characters(F.concat(*groups))
    else:
        over = at % 12
        zeros = over % 6 // 2
        digits = -(-(over + 4 * zeros + n) // 24) * 6 - zeros
        taken = F.rpad(F.substring(bits["hex"], (at - over) // 4 + 1, digits), digits, "0")
        text = F.substring(_characters(F.concat(F.lit("0" * zeros), taken) if zeros else taken), (over + 4 * zeros) // 6 + 1, n // 6)
    there = F.least(F.lit(n - n % 6), bit_length(bits) - at)
    text = F.rtrim(F.substring_index(text, "@", 1))
    return F.when(there >= 6, F.rtrim(F.substring(text, F.lit(1), F.floor(there / 6).cast("int"))))


def _field(bits: Column, at: int, n: int, kind: str) -> Column:
    if kind == "t":
        return sixbit(bits, at, n)
    x = signed(bits, at, n) if kind == "s" else unsigned(bits, at, n)
    return x == 1 if kind == "b" else x


def _layout(text: str) -> list[tuple[str, int, int, str]]:
    return [(n, int(a), int(k), kind) for n, a, k, kind in (x.split() for x in text.split(", ") if x)]


def header(messages: DataFrame) -> DataFrame:
    """Messages with their bits, type, repeat and mmsi; too short or too long ones are rejected."""
    rows = messages.withColumn("bits", once(unarmor(F.col("payload"), F.col("pad")))).filter("bits is not null and bits.n >= 38")
    b = F.col("bits")
    rows = rows.withColumns({"type": unsigned(b, 0, 6).cast("int"), "repeat": unsigned(b, 6, 2).cast("int"), "mmsi": unsigned(b, 8, 30)})
    limits = F.create_map(*[F.lit(x) for t, (lo, hi) in LENGTHS.items() for x in (t, lo * 10000 + hi)])[F.col("type")]
    ok = (F.col("bits.n") >= F.floor(limits / 10000)) & (F.col("bits.n") <= limits % 10000)
    return rows.filter(ok & ((F.col("type") != 27) | F.col("bits.n").isin(96, 168)))


def mmsi_of(payload: Column) -> Column:
    """The ship of a message, from the first seven characters of its payload."""
    return unsigned(unarmor(F.substring(payload, 1, 7), F.lit(0)), 8, 30)


def decode_type(messages: DataFrame, type_: int) -> DataFrame:
    """Messages of a type with its fields, unscaled. messages come from header."""
    layout = next(v for k, v in LAYOUTS.items() if type_ in k)
    b = F.col("bits")
    rows = messages.filter(F.col("type") == type_)
    out = rows.select("device", "channel", "line_no", "type", "repeat", "mmsi", "bits", *[_field(b, a, n, k).alias(name) for name, a, n, k in _layout(layout)])
    if type_ in (1, 2, 3):
        out = out.withColumn("status_text", _text("status", STATUS_TEXT))
    if type_ == 27:
        out = out.withColumn("status_text", _text("status", STATUS_TEXT))
    if type_ in (4, 11):
        out = out.withColumn("timestamp", F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", "year", "month", "day", "hour", "minute", "second")).drop("year", "month", "day", "hour", "minute")
    if type_ == 5:
        out = out.withColumn("eta", F.format_string("%02d-%02dT%02d:%02dZ", "month", "day", "hour", "minute")).drop("month", "day", "hour", "minute")
    for c, names in (("epfd", EPFD_TEXT), ("aid_type", AID_TEXT), ("stationtype", STATION_TEXT)):
        if c in out.columns:
            out = out.withColumn(f"{c}_text", _text(c, names))
    if type_ in (6, 8):
        out = with_payload(out, type_)
    if type_ == 12:
        out = out.withColumn("text", _rest_text(b, 72))
    if type_ == 14:
        out = out.withColumn("text", _rest_text(b, 40))
    if type_ == 17:
        out = out.withColumn("data", hex_data(b, 80))
    if type_ == 21:
        out = out.withColumn("name", F.when(F.col("bits.n") > 272, F.concat(F.rpad("name", 20, " "), _rest_text(b, 272))).otherwise(F.col("name"))).withColumn("name", F.rtrim("name"))
    if type_ == 22:
        out = out.withColumns({"dest1": F.when(F.col("addressed"), unsigned(b, 69, 30)), "dest2": F.when(F.col("addressed"), unsigned(b, 104, 30))}).withColumns({c: F.when(~F.col("addressed"), F.col(c)) for c in ("ne_lon", "ne_lat", "sw_lon", "sw_lat")})
    if type_ == 24:
        out = _type24(out)
    if type_ in (25, 26):
        out = _type25(out, type_)
    if "shiptype" in out.columns:
        out = out.withColumn("shiptype_text", F.when(F.col("shiptype").isNotNull(), F.coalesce(_text("shiptype", SHIP_TEXT), F.lit("INVALID SHIP TYPE"))))
    return out.drop("bits")


def _text(c: str, names: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(c).cast("int")]


def _rest_text(bits: Column, at: int) -> Column:
    """Six-bit text from a bit (the first of a byte) to the end."""
    n = F.floor((bit_length(bits) - at) / 6).cast("int")
    digits = (F.ceil(F.greatest(n, F.lit(0)) / 4) * 6).cast("int")
    return F.when(n >= 1, F.rtrim(F.substring(_readable(F.rpad(F.substring(bits["hex"], F.lit(at // 4 + 1), digits), digits, "0")), F.lit(1), n))).otherwise("")


def hex_data(bits: Column, at: int) -> Column:
    """Bits from a place (the first of a hexadecimal digit) to the end as `count:hex`, the last byte filled up with zeros."""
    n = bit_length(bits) - at
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(":"), F.lower(F.substring(bits["hex"], F.lit(at // 4 + 1), (F.ceil(n / 8) * 2).cast("int")))))


def _from(bits: Column, at: Column, cut: int = 0) -> Column:
    """The bits from a place that depends on the row, without the last cut ones: their digits are moved by 0 or 2 bits."""
    here = F.substring(bits["hex"], F.floor(at / 4).cast("int") + 1, F.length(bits["hex"]))
    wide = F.rpad(here, (F.ceil(F.length(here) / 12) * 12 + 12).cast("int"), "0")
    moved = F.array_join(F.transform(F.sequence(F.lit(1), F.length(wide) - 12, F.lit(12)), lambda k: F.lpad(F.hex(F.shiftright(F.conv(F.substring(wide, k, F.lit(13)), 16, 10).cast("bigint"), 2).bitwiseAND((1 << 48) - 1)), 12, "0")), "")
    n = F.greatest(bit_length(bits) - at - cut, F.lit(0)).cast("int")
    digits = F.rpad(F.when(at % 4 == 0, here).otherwise(moved), (F.ceil(F.greatest(n, F.lit(1)) / 4) * 4 + BEHIND).cast("int"), "0")
    # no bits of what is cut off behind the end
    kept, last = F.floor(n / 4).cast("int"), n % 4
    edge = F.conv(F.substring(digits, kept + 1, F.lit(1)), 16, 10).cast("int").bitwiseAND(F.when(last == 0, 0).when(last == 1, 8).when(last == 2, 12).otherwise(14))
    clean = F.concat(F.substring(digits, F.lit(1), kept), F.hex(edge), F.lit("0" * BEHIND))
    return F.struct(clean.alias("hex"), n.alias("n"))


def _entries(bits: Column, name: str, at: int, size: int, layout: str, most: int, n: Column | None) -> Column:
    """The whole entries of a list at the end of a message; n says how many, else the message's length."""
    count = F.floor((bit_length(bits) - at) / size)
    count = count if n is None else F.least(n, count)
    entry = lambda k: F.struct(*[_field(bits, at + size * k + a, w, kind).alias(c) for c, a, w, kind in _layout(layout)])
    all_ = F.array(*[F.when(count > k, entry(k)) for k in range(most)])
    return F.filter(all_, lambda x: x.isNotNull()).alias(name)


def with_payload(rows: DataFrame, type_: int) -> DataFrame:
    """Binary payloads of a type: a struct per known (dac, fid), named app_<dac>_<fid>, and hex data of the others and
    of those with another length than theirs. Values are unscaled. Lists hold whole entries only: bits that a message
    has behind its last whole entry are not read."""
    b, known, structs = F.col("bits"), F.lit(False), {}
    for of, dac, fid, least, most, layout, more in APPLICATIONS:
        if of != type_:
            continue
        here = (F.col("dac") == dac) & (F.col("fid") == fid) & bit_length(b).between(least, most)
        fields = {name: _field(b, a, n, k).alias(name) for name, a, n, k in _layout(layout)}
        if (dac, fid) == (200, 10):
            here = here & (fields["hazard"] <= MOST_HAZARD)
        known = known | here
        name = f"app_{dac}_{fid}"
        value = F.when(here, F.struct(*fields.values(), *([] if more is None else [_entries(b, *more[:5], fields.get(more[5]))])))
        structs[name] = F.coalesce(structs[name], value) if name in structs else value
    return rows.withColumns({**structs, "data": F.when(~F.coalesce(known, F.lit(False)), hex_data(b, 88 if type_ == 6 else 56))})


def _type24(rows: DataFrame) -> DataFrame:
    """Parts A and B: the name, or what else describes the ship; auxiliary craft give their mother ship."""
    a, auxiliary = F.col("partno") == 0, is_auxiliary(F.col("mmsi"))
    out = rows.filter("partno in (0, 1)").withColumn("part", F.when(a, "A").otherwise("B")).withColumn("shipname", F.when(a, F.col("shipname")))
    out = out.withColumns({c: F.when(~a, F.col(c)) for c in ("shiptype", "vendorid", "model", "serial", "callsign")})
    out = out.withColumns({c: F.when(~a & ~auxiliary, F.col(c)) for c in ("to_bow", "to_stern", "to_port", "to_starboard")})
    return out.withColumn("mothership_mmsi", F.when(~a & auxiliary, F.col("mothership_mmsi"))).drop("partno")


def is_auxiliary(mmsi: Column) -> Column:
    return F.floor(mmsi / 10_000_000) == 98


def _type25(rows: DataFrame, type_: int) -> DataFrame:
    """The application's number and data; type 26 ends with 20 bits of radio state."""
    b = F.col("bits")
    start = 40 + F.when(F.col("addressed"), 30).otherwise(0)
    rows = rows.withColumn("__body", _from(b, start, 20 if type_ == 26 else 0))
    app = F.when(F.col("structured"), unsigned(F.col("__body"), 0, 16))
    data = F.when(F.col("structured"), hex_data(F.col("__body"), 16)).otherwise(hex_data(F.col("__body"), 0))
    out = rows.withColumns({"dest_mmsi": F.when(F.col("addressed"), unsigned(b, 40, 30)), "app_id": app, "data": data}).drop("__body")
    if type_ == 26:
        end = _from(b, (bit_length(b) - 20) - (bit_length(b) - 20) % 2)
        out = out.withColumn("radio", F.when(bit_length(b) % 2 == 0, _number(end, 0, 20)).otherwise(_number(end, 1, 20)))
    return out


def merge_24(rows: DataFrame, ring: int = 8, size: int = SLICE) -> DataFrame:
    """Halves of type 24 (device, channel, line_no, mmsi, part) put together: a B takes the name of its ship's last A
    on the channel, if that is not taken yet and no more than ring A halves of the channel back."""
    is_a, key = F.col("part") == "A", ("device", "channel")
    rows = scan(rows, key, "line_no", {"__any": F.when(is_a, 1)}, total=("__a", "__any", lambda *_: F.lit(1)), size=size).drop("__any")
    of_ship = {"__last": F.when(is_a, F.struct("__a", "shipname")), "__part": F.col("part")}
    rows = scan(rows, (*key, "mmsi"), "line_no", of_ship, size=size)
    both = (F.col("part") == "B") & (F.col("__part") == "A") & (F.col("__a") - F.col("__last.__a") < ring)
    return rows.withColumns({"shipname": F.when(both, F.col("__last.shipname")).otherwise(F.col("shipname")), "part": F.when(both, "both").otherwise(F.col("part"))}).drop("__a", "__last", "__part")


def scale_ais(rows: DataFrame, type_: int | None = None) -> DataFrame:
    """Scaled values; what isn't available becomes null, with a text beside it where the message has words for it.

    Positions are ten-thousandths of a minute, in types 17, 22, 23 and 27 tenths of one; speeds tenths of knots, in
    types 9 and 27 whole knots; courses tenths of degrees, in type 27 whole ones. The type is that of the column type,
    or type_ where all rows are of one.
    """
    kind = F.lit(type_) if type_ is not None else F.col("type")
    have = set(rows.columns)
    out = rows
    minutes = F.when(kind.isin(*COARSE), F.lit(600.0)).otherwise(F.lit(600000.0))
    for c in [c for c in rows.columns if c.removeprefix("ne_").removeprefix("sw_") in POSITION_NA]:
        limit = POSITION_NA[c.removeprefix("ne_").removeprefix("sw_")]
        out = out.withColumn(c, F.when(F.abs(F.col(c)) < F.lit(limit) * minutes, F.col(c) / minutes))
    if "course" in have:
        tenths = F.when(F.col("course") < 3600, F.col("course") / F.lit(10.0))
        out = out.withColumn("course", F.when(kind == 27, F.when(F.col("course") < 360, F.col("course").cast("double"))).otherwise(tenths))
    if "speed" in have:
        x = F.col("speed")
        words = F.when(kind == 27, F.when(x == 63, "nan")).when(x == 1023, "nan").when(x == 1022, "fast")
        out = out.withColumns({"speed_text": words, "speed": F.when(words.isNull(), F.when(kind.isin(9, 27), x.cast("double")).otherwise(x / F.lit(10.0)))})
    if "alt" in have:
        words = F.when(F.col("alt") == 4095, "nan").when(F.col("alt") == 4094, "high")
        out = out.withColumns({"alt_text": words, "alt": F.when(words.isNull(), F.col("alt"))})
    if "turn" in have:
        t = F.col("turn")
        words = F.when(t == -128, "nan").when(t == -127, "fastleft").when(t == 127, "fastright")
        rate = (t / F.lit(4.733)) * (t / F.lit(4.733)) * F.signum(t.cast("double"))
        out = out.withColumns({"turn_text": words, "turn": F.when(words.isNull(), F.round(rate))})
    if "heading" in have:
        out = out.withColumn("heading", F.when(F.col("heading") != 511, F.col("heading")))
    return out.withColumn("draught", F.col("draught") / F.lit(10.0)) if "draught" in have else out


def messages(lines: DataFrame, device: str = "file", value: str = "value") -> DataFrame:
    """Sentence lines to whole messages with their bits."""
    return header(assemble_fragments(ais_lines(lines, device, value)))
