"""Explode, flatten and unpivot of nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions.gnss import label

#: Fixed values. Subframe variants with the frames that they come in.
VARIANT_FRAMES = {"ALMANAC": (4, 5), "HEALTH": (4,), "HEALTH2": (5,), "IONO": (4,), "NMCT": (4,), "EPHEM1": (1,), "EPHEM2": (2,), "EPHEM3": (3,)}


def sat_records(sky: DataFrame) -> DataFrame:
    """One row per satellite with its skyview's device and time; skyviews without time are left out."""
    return sky.filter("time is not null").select("device", "time", F.explode("satellites").alias("s")).select("device", "time", "s.*")


def subframe_records(subframes: DataFrame, variant: str) -> DataFrame:
    rows = subframes.filter(F.col("frame").isin(*VARIANT_FRAMES[variant]) & F.col(variant).isNotNull())
    kind = subframes.schema[variant].dataType.typeName()
    return rows.select("TOW17", "tSV", f"{variant}.*") if kind == "struct" else rows.select("TOW17", "tSV", F.explode(variant).alias("name", "value"))


def obs_records(raw: DataFrame) -> DataFrame:
    return raw.select("device", "time", "nsec", F.explode("rawdata").alias("m")).select("device", "time", "nsec", "m.*")


def correction_records(rtcm2: DataFrame) -> DataFrame:
    """One row per satellite of correction messages; messages without list keep one row."""
    return rtcm2.filter(F.col("type").isin(1, 5, 9, 31)).select("device", "type", "station_id", "zcount", F.explode_outer("satellites").alias("s")).select("device", "type", "station_id", "zcount", "s.*")


#: Fixed values. Configurations and health of satellites.
CONFIG_TEXT = {0: "Reserved", 1: "Block II/Block IIA/IIR SV", 2: "M-code, L2C, Block IIR-M SV", 3: "M-code, L2C, L5, Block IIF SV", 4: "M-code, L2C, L5, No SA,  Block III SV", 5: "Reserved", 6: "Reserved", 7: "Reserved"}
HEALTH_TEXT = {
    0: "All Signals OK", 1: "All Signals Weak", 2: "All Signals Dead", 3: "All Signals Have No Data Modulation",
    4: "L1 P Signal Weak", 5: "L1 P Signal Dead", 6: "L1 P Signal Has No Data Modulation",
    7: "L2 P Signal Weak", 8: "L2 P Signal Dead", 9: "L2 P Signal Has No Data Modulation",
    10: "L1C Signal Weak", 11: "L1C Signal Dead", 12: "L1C Signal Has No Data Modulation",
    13: "L2C Signal Weak", 14: "L2C Signal Dead", 15: "L2C Signal Has No Data Modulation",
    16: "L1 & L2 P Signal Weak", 18: "L1 & L2 P Signal Dead", 19: "L1 & L2 P Signal Has No Data Modulation",
    20: "L1 & L2C Signal Weak", 21: "L1 & L2C Signal Dead", 22: "L1 & L2C Signal Has No Data Modulation",
    23: "L1 Signal Weak", 24: "L1 Signal Dead", 25: "L1 Signal Has No Data Modulation",
    26: "L2 Signal Weak", 27: "L2 Signal Dead", 28: "L2 Signal Has No Data Modulation",
    29: "SV Is Temporarily Out", 30: "SV Will Be Temporarily Out", 31: "Multiple Anomalies",
}
#: Health of a satellite that isn't there.
NO_SATELLITE = 0x3F


def health_unpivot(health: DataFrame, column: str = "HEALTH") -> DataFrame:
    """Health maps (SV1, SVH25, ...) as rows: satellite, flags, anti-spoof bit, configuration, data bad, text.

    The text is that of the configuration or of the health; n/a where there is no satellite.
    """
    rows = health.select("TOW17", "tSV", F.explode(column).alias("name", "flags")).withColumn("sv", F.regexp_extract("name", r"^SV[H]?([0-9]+)$", 1).try_cast("int")).filter("sv is not null")
    short, there = ~F.col("name").startswith("SVH"), F.col("flags") != NO_SATELLITE
    return rows.withColumns(
        {
            "anti_spoof": F.when(short, F.col("flags").bitwiseAND(8) != 0),
            "config": F.when(short, F.col("flags").bitwiseAND(7)),
            "data_bad": F.when(~short & there, F.col("flags").bitwiseAND(0x20) != 0),
            "text": F.when(short, label(F.col("flags").bitwiseAND(7), CONFIG_TEXT)).when(there, label(F.col("flags").bitwiseAND(0x1F), HEALTH_TEXT)).when(~there, "n/a"),
        }
    )


def device_inventory(devices: DataFrame, order: str = "time") -> DataFrame:
    """The last description of each device path in lists of devices."""
    rows = devices.select(F.col(order).alias("__at"), F.explode("devices").alias("d")).select("__at", "d.*")
    last = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("path", "__at")]), "__at").alias("d"))
    return last.select("path", "d.*")


def sorted_satellites(sky: DataFrame) -> DataFrame:
    """Satellites for display: used ones first, then by system, number and signal."""
    key = F.transform("satellites", lambda s: F.struct((~F.coalesce(s["used"], F.lit(False))).alias("k1"), s["gnssid"].alias("k2"), s["svid"].alias("k3"), s["sigid"].alias("k4"), s.alias("s")))
    return sky.withColumn("satellites", F.transform(F.array_sort(key), lambda x: x["s"]))


def sorted_measurements(raw: DataFrame) -> DataFrame:
    """Each report's measurements by system, satellite and signal."""
    key = F.transform("rawdata", lambda m: F.struct(m["gnssid"].alias("k1"), m["svid"].alias("k2"), m["sigid"].alias("k3"), m.alias("m")))
    return raw.withColumn("rawdata", F.transform(F.array_sort(key), lambda x: x["m"]))
