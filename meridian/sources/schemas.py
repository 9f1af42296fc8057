"""Schemas of the report classes, as Spark DDL. All fields but class are nullable; absent means null."""

from __future__ import annotations

from meridian.operators.ais import APPLICATIONS, LAYOUTS, _layout

_SAT = "PRN INT, gnssid INT, svid INT, sigid INT, freqid INT, az DOUBLE, el DOUBLE, ss DOUBLE, pr DOUBLE, prRate DOUBLE, prRes DOUBLE, qual INT, used BOOLEAN, health INT"
_MEAS = "gnssid INT, svid INT, snr INT, obs STRING, lli INT, locktime BIGINT, sigid INT, freqid INT, pseudorange DOUBLE, carrierphase DOUBLE, doppler DOUBLE, c2c DOUBLE, l2c DOUBLE"


def _doubles(names: str) -> str:
    return ", ".join(f"{n} DOUBLE" for n in names.split())


_ATT = "class STRING, device STRING, time TIMESTAMP, " + _doubles("heading mheading pitch roll yaw rot dip mag_len mag_x mag_y mag_z acc_len acc_x acc_y acc_z gyro_temp gyro_x gyro_y gyro_z depth temp") + ", mag_st STRING, pitch_st STRING, roll_st STRING, yaw_st STRING, msg STRING, timeTag BIGINT"
_CLOCK = "class STRING, device STRING, real_sec BIGINT, real_nsec BIGINT, clock_sec BIGINT, clock_nsec BIGINT, `precision` INT, shm STRING, qErr BIGINT"

#: Scaled values of vessel messages; other numbers are whole.
_SCALED = {"lat", "lon", "ne_lat", "ne_lon", "sw_lat", "sw_lon", "speed", "course", "turn", "draught"}
#: Texts that reports of vessel messages add to the fields of the messages.
_TEXTS = "part status_text turn_text speed_text alt_text epfd_text aid_type_text shiptype_text stationtype_text class_text direction_text hazard_text ice_text light_text loaded_text nextsignal_text position_text preciptype_text racon_text rtype_text signal_text type_text wind_text timestamp eta text data"


def _vessel_fields() -> str:
    """Every field of every message type and binary application, once."""
    layouts = [*LAYOUTS.values(), *(layout for _, _, _, _, _, layout, _ in APPLICATIONS)]
    kinds = {"type": "INT", "repeat": "INT", "mmsi": "BIGINT", "scaled": "BOOLEAN", **{c: "STRING" for c in _TEXTS.split()}, "dest1": "BIGINT", "dest2": "BIGINT", "app_id": "BIGINT"}
    for layout in layouts:
        for name, _, _, kind in _layout(layout):
            kinds.setdefault(name, {"t": "STRING", "b": "BOOLEAN"}.get(kind, "DOUBLE" if name in _SCALED else "BIGINT"))
    for _, _, _, _, _, _, more in APPLICATIONS:
        if more:
            fields = ",".join(f"{n}:{'STRING' if k == 't' else 'DOUBLE' if n in _SCALED else 'BIGINT'}" for n, _, _, k in _layout(more[3]))
            kinds.setdefault(more[0], f"ARRAY<STRUCT<{fields}>>")
    return ", ".join(f"`{n}` {k}" for n, k in kinds.items())


#: One table per class. SUBFRAME has names that differ by case only: read it with spark.sql.caseSensitive=true.
SCHEMAS = {
    "TPV": "class STRING, device STRING, time TIMESTAMP, mode INT, status INT, leapseconds INT, datum STRING, dgpsSta INT, jam INT, ant INT, antPwr INT, baseS INT, sats INT, week INT, rollovers INT, chars BIGINT, "
    + _doubles("ept lat lon altHAE altMSL alt epx epy epv eph sep track magtrack magvar speed climb eps epc epd ecefx ecefy ecefz ecefvx ecefvy ecefvz ecefpAcc ecefvAcc velN velE velD relN relE relD geoidSep depth dgpsAge dgpsRatio wanglem wangler wanglet wspeedr wspeedt wtemp temp clockbias clockdrift baseE baseN baseU baseL baseC errEllOr errEllMaj errEllMin rtime pps sor tow"),
    "SKY": f"class STRING, device STRING, time TIMESTAMP, nSat INT, uSat INT, {_doubles('xdop ydop vdop tdop hdop gdop pdop')}, satellites ARRAY<STRUCT<{_SAT.replace(' ', ':').replace(',:', ',')}>>",
    "GST": "class STRING, device STRING, time TIMESTAMP, " + _doubles("rms major minor orient lat lon alt ve vn vu"),
    "ATT": _ATT,
    "IMU": _ATT,
    "TOFF": _CLOCK,
    "PPS": _CLOCK,
    "OSC": "class STRING, device STRING, running BOOLEAN, reference BOOLEAN, disciplined BOOLEAN, delta INT",
    "RAW": f"class STRING, device STRING, time BIGINT, nsec BIGINT, rawdata ARRAY<STRUCT<{_MEAS.replace(' ', ':').replace(',:', ',')}>>",
    "SUBFRAME": "class STRING, device STRING, gnssId INT, tSV INT, frame INT, WN INT, TOW17 BIGINT, SOW BIGINT, TOW BIGINT, scaled BOOLEAN, dataid INT, "
    "EPHEM1 STRUCT<WN:INT,IODC:INT,L2:INT,ura:INT,hlth:INT,L2P:INT,Tgd:DOUBLE,toc:DOUBLE,af2:DOUBLE,af1:DOUBLE,af0:DOUBLE>, "
    "EPHEM2 STRUCT<IODE:INT,Crs:DOUBLE,deltan:DOUBLE,M0:DOUBLE,Cuc:DOUBLE,e:DOUBLE,Cus:DOUBLE,sqrtA:DOUBLE,toe:DOUBLE,FIT:INT,AODO:INT>, "
    "EPHEM3 STRUCT<IODE:INT,IDOT:DOUBLE,Cic:DOUBLE,Omega0:DOUBLE,Cis:DOUBLE,i0:DOUBLE,Crc:DOUBLE,omega:DOUBLE,Omegad:DOUBLE>, "
    "ALMANAC STRUCT<ID:INT,Health:INT,e:DOUBLE,toa:DOUBLE,deltai:DOUBLE,Omegad:DOUBLE,sqrtA:DOUBLE,Omega0:DOUBLE,omega:DOUBLE,M0:DOUBLE,af0:DOUBLE,af1:DOUBLE>, "
    "HEALTH MAP<STRING,INT>, HEALTH2 MAP<STRING,INT>, "
    "IONO STRUCT<A0:DOUBLE,A1:DOUBLE,a0:DOUBLE,a1:DOUBLE,a2:DOUBLE,a3:DOUBLE,b0:DOUBLE,b1:DOUBLE,b2:DOUBLE,b3:DOUBLE,ls:INT,tot:DOUBLE,WNt:INT,WNlsf:INT,DN:INT,lsf:INT>",
    "RTCM2": "class STRING, device STRING, type INT, station_id INT, zcount DOUBLE, seqnum INT, length INT, station_health INT, satellites ARRAY<STRUCT<ident:INT,udre:INT,iod:INT,prc:DOUBLE,rrc:DOUBLE>>",
    "RTCM3": "class STRING, device STRING, type INT, length INT, station_id INT, tow BIGINT",
    "AIS": f"class STRING, device STRING, {_vessel_fields()}",
    "LOG": "class STRING, device STRING, time TIMESTAMP, idx INT, mode INT, " + _doubles("lat lon altHAE altMSL gSpeed heading tAcc hAcc vAcc sAcc headAcc velN velE velD pDOP"),
    "DEVICE": "class STRING, path STRING, activated STRING, driver STRING, subtype STRING, subtype1 STRING, bps INT, parity STRING, stopbits INT, native INT, cycle DOUBLE, mincycle DOUBLE, flags INT",
}
#: Classes kept as lines in a table of session events.
SESSION = ("VERSION", "WATCH", "POLL", "ERROR", "DEVICES")
