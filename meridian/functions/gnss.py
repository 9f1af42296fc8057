"""Satellite systems, signals and reports: labels and codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Satellite systems by their number.
GNSS = {0: "GPS", 1: "SBAS", 2: "Galileo", 3: "BeiDou", 4: "IMES", 5: "QZSS", 6: "GLONASS", 7: "NavIC"}
#: Fixed values. Observation-file letters of the systems.
RINEX = {0: "G", 1: "S", 2: "E", 3: "C", 5: "J", 6: "R", 7: "I"}
#: Fixed values. Observation-code suffixes by (system, signal).
OBS_CODE = {
    (0, 0): "1C", (0, 3): "2L", (0, 4): "2S", (0, 6): "5I", (0, 7): "5Q",
    (1, 0): "1C",
    (2, 0): "1C", (2, 1): "1B", (2, 3): "5I", (2, 4): "5Q", (2, 5): "7I", (2, 6): "7Q", (2, 8): "6B", (2, 9): "6C", (2, 10): "6A",
    (3, 0): "2I", (3, 1): "2I", (3, 2): "7I", (3, 3): "7I", (3, 4): "6I", (3, 5): "1P", (3, 6): "1D", (3, 7): "5P", (3, 8): "5P", (3, 10): "6I",
    (5, 0): "1C", (5, 1): "1Z", (5, 4): "2S", (5, 5): "2L", (5, 8): "5I", (5, 9): "5Q", (5, 12): "1E",
    (6, 0): "1C", (6, 2): "2C",
    (7, 0): "5A",
}
#: Fixed values. Fix modes and statuses.
MODE = {0: "unknown", 1: "no fix", 2: "2D", 3: "3D"}
STATUS = {0: "unknown", 1: "GPS", 2: "DGPS", 3: "RTK fixed", 4: "RTK float", 5: "DR", 6: "GNSSDR", 7: "time", 8: "simulated", 9: "P(Y)"}
#: Fixed values. Ranges of sentence satellite numbers: first, last, system, and what is taken off for the number within
#: the system (SBAS: 87 added below 65, the number itself above).
PRN_RANGES = ((1, 32, 0, 0), (33, 64, 1, -87), (65, 96, 6, 64), (120, 158, 1, 0), (173, 182, 4, 172), (193, 197, 5, 192), (201, 237, 3, 200), (301, 356, 2, 300), (401, 437, 3, 400), (500, 509, 7, 500), (901, 918, 7, 900))
#: Fixed values. The same where a system field (1 GPS and SBAS, 2 GLONASS, 3 Galileo, 4 BeiDou, 5 QZSS, 6 NavIC) comes
#: with the sentence: field, first, last, system, taken off.
SYSTEM_RANGES = (
    (1, 1, 32, 0, 0), (1, 33, 64, 1, -87), (1, 65, 136, 2, 100), (1, 152, 157, 1, 0), (1, 193, 199, 5, 192), (1, 200, 264, 3, 200),
    (2, 1, 63, 6, 0), (2, 64, 255, 6, 64),
    (3, 1, 99, 2, 0), (3, 101, 199, 2, 100), (3, 301, 399, 2, 300),
    (4, 1, 99, 3, 0), (4, 201, 299, 3, 200), (4, 401, 499, 3, 400),
    (5, 1, 99, 5, 0), (5, 100, 255, 5, 192),
    (6, 1, 255, 7, 0),
)
#: Fixed values. Precision exponents of time pulses by the kind of line they come over.
PULSE_PRECISION = {"tcp": -1, "udp": -1, "usb": -10, "serial": -20}


def label(column: Column, names: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items()))[column]


def snr_flag(ss: Column) -> Column:
    """Signal strength (dB-Hz) as a digit from 0 (absent) to 9."""
    out = F.when(ss == 0, 0)
    for digit, (limit, open_) in enumerate(((12, True), (18, False), (23, False), (29, False), (35, False), (41, False), (47, False), (53, False)), 1):
        out = out.when(ss < limit if open_ else ss <= limit, digit)
    return out.when(ss.isNotNull(), 9)


def obs_code(gnssid: Column, sigid: Column, kind: str = "C") -> Column:
    """Observation code of a signal: C (pseudorange), L (phase) or D (Doppler) and the signal's suffix."""
    codes = F.create_map(*chain.from_iterable((F.lit(g * 16 + s), F.lit(c)) for (g, s), c in OBS_CODE.items()))
    return F.concat(F.lit(kind), codes[gnssid * 16 + sigid])


def rinex_system(gnssid: Column) -> Column:
    return label(gnssid, RINEX)


def gnssid_of(letter: Column) -> Column:
    return label(letter, {v: k for k, v in RINEX.items()})


def pulse_precision(path: Column) -> Column:
    """Precision exponent of pulses by the device's path."""
    kind = F.when(path.startswith("tcp:"), "tcp").when(path.startswith("udp:"), "udp").when(path.contains("USB") | path.contains("ACM"), "usb").otherwise("serial")
    return label(kind, PULSE_PRECISION)
