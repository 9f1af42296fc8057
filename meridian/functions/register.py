"""SQL functions, table functions and profile plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions import geo
from meridian.operators import ais, nmea, profile, sequence

_A, _B, _E2 = f"{geo.WGS84_A!r}D", f"{geo.WGS84_B!r}D", f"{geo.WGS84_E2!r}D"
_EP2 = f"{(geo.WGS84_A**2 - geo.WGS84_B**2) / geo.WGS84_B**2!r}D"
#: SQL bodies of the closed-form functions: name, parameters, result. Later ones call earlier ones.
SQL_FUNCTIONS = {
    "earth_distance_small": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "DOUBLE",
        "(111132.954D - 559.822D * cos(2D * radians((lat1 + lat2) / 2D)) + 1.175D * cos(4D * radians((lat1 + lat2) / 2D))) * sqrt(pow(lat2 - lat1, 2) + pow((lon2 - lon1) * cos(radians((lat1 + lat2) / 2D)), 2))",
    ),
    "norm_deg": ("x DOUBLE", "DOUBLE", "pmod(x, 360D)"),
    "posix2gps": ("t BIGINT, leap INT", "BIGINT", "t - 315964800L + leap"),
    "meter_offset": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "STRUCT<east DOUBLE, north DOUBLE>",
        "named_struct('east', if(lon1 < lon2, -1D, 1D) * earth_distance_small(lat1, lon1, lat1, lon2), 'north', if(lat1 < lat2, -1D, 1D) * earth_distance_small(lat1, lon1, lat2, lon1))",
    ),
    "normal_radius": ("lat DOUBLE", "DOUBLE", f"{_A} / sqrt(1D - {_E2} * pow(sin(radians(lat)), 2))"),
    "lla2ecef": (
        "lat DOUBLE, lon DOUBLE, alt DOUBLE",
        "STRUCT<x DOUBLE, y DOUBLE, z DOUBLE>",
        f"named_struct('x', (normal_radius(lat) + alt) * cos(radians(lat)) * cos(radians(lon)), 'y', (normal_radius(lat) + alt) * cos(radians(lat)) * sin(radians(lon)), 'z', (normal_radius(lat) * (1D - {_E2}) + alt) * sin(radians(lat)))",
    ),
    "ecef_latitude": (
        "x DOUBLE, y DOUBLE, z DOUBLE",
        "DOUBLE",
        f"degrees(atan2(z + {_EP2} * {_B} * pow(sin(atan2(z * {_A}, sqrt(x * x + y * y) * {_B})), 3), sqrt(x * x + y * y) - {_E2} * {_A} * pow(cos(atan2(z * {_A}, sqrt(x * x + y * y) * {_B})), 3)))",
    ),
    "ecef2lla": (
        "x DOUBLE, y DOUBLE, z DOUBLE",
        "STRUCT<lat DOUBLE, lon DOUBLE, alt DOUBLE>",
        f"named_struct('lat', ecef_latitude(x, y, z), 'lon', degrees(atan2(y, x)), 'alt', if(sqrt(x * x + y * y) < 1e-6D, abs(z) - {_B}, sqrt(x * x + y * y) / cos(radians(ecef_latitude(x, y, z))) - normal_radius(ecef_latitude(x, y, z))))",
    ),
    "ecef2enu": (
        "dx DOUBLE, dy DOUBLE, dz DOUBLE, lat DOUBLE, lon DOUBLE",
        "STRUCT<east DOUBLE, north DOUBLE, up DOUBLE>",
        "named_struct('east', cos(radians(lon)) * dy - sin(radians(lon)) * dx, 'north', cos(radians(lat)) * dz - sin(radians(lat)) * (cos(radians(lon)) * dx + sin(radians(lon)) * dy), 'up', cos(radians(lat)) * (cos(radians(lon)) * dx + sin(radians(lon)) * dy) + sin(radians(lat)) * dz)",
    ),
    "enu2aer": (
        "east DOUBLE, north DOUBLE, up DOUBLE",
        "STRUCT<az DOUBLE, el DOUBLE, distance DOUBLE>",
        "named_struct('az', pmod(degrees(atan2(east, north)), 360D), 'el', degrees(atan2(up, sqrt(east * east + north * north))), 'distance', sqrt(east * east + north * north + up * up))",
    ),
}


_M2, _D = "sigma * sigma * (n - 1)", "if(kind = 'reference', mean - sigma, 0D)"
_M3, _M4 = f"skew * sqrt(pow({_M2}, 3) / n)", f"(kurt + 3D) * pow({_M2}, 2) / n"
SQL_FUNCTIONS["shape_of"] = (
    "n BIGINT, mean DOUBLE, sigma DOUBLE, skew DOUBLE, kurt DOUBLE, kind STRING",
    "STRUCT<skewness DOUBLE, kurtosis DOUBLE>",
    f"named_struct('skewness', if(sigma > 0.0001D, ({_M3} + 3D * {_D} * {_M2} + n * pow({_D}, 3)) / (n * pow(sigma, 3)), null), 'kurtosis', if(sigma > 0.0001D, ({_M4} + 4D * {_D} * {_M3} + 6D * pow({_D}, 2) * {_M2} + n * pow({_D}, 4)) / (n * pow(sigma, 4)), null))",
)


def register_functions(spark: SparkSession) -> None:
    """earth_distance (Vincenty, Arrow batches), the closed forms and shape_of as SQL functions of the session.

    shape_of(count(x), avg(x), stddev_samp(x), skewness(x), kurtosis(x), kind) gives skewness and kurtosis as profiles
    have them (kind standard or reference) in any grouped or windowed query: its arguments are Spark's own mergeable aggregates.
    """

    @F.pandas_udf(T.DoubleType())
    def earth_distance(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        return pd.Series(geo.vincenty(*[s.to_numpy(float) for s in (lat1, lon1, lat2, lon2)])[0])

    spark.udf.register("earth_distance", earth_distance)
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


@dataclass(frozen=True)
class Profile:
    """A profile: the classes it watches, what it takes of their rows, and its summary."""

    name: str
    watch_classes: tuple[str, ...]
    sample: Callable[[DataFrame], DataFrame]
    summarise: Callable[[DataFrame], DataFrame]

    def run(self, df: DataFrame) -> DataFrame:
        return self.summarise(self.sample(df))


PROFILES = {
    p.name: p
    for p in (
        Profile("space", ("TPV",), lambda df: df.filter("mode >= 2"), profile.space_profile),
        Profile("cep", ("TPV",), lambda df: df.filter("mode >= 2"), profile.cep_percentiles),
        Profile("signal", ("SKY",), lambda df: df, profile.signal_profile),
        Profile("latency", ("TPV",), profile.latency_total, lambda df: profile.stats_1d(df, "latency")),
        Profile("pps", ("PPS",), profile.clock_drift, lambda df: profile.stats_1d(df, "offset_ns")),
    )
}


def nmea_decode(lines: DataFrame) -> DataFrame:
    return nmea.fixes(lines)


def ais_decode(lines: DataFrame, type_: int) -> DataFrame:
    return ais.scale_ais(ais.decode_type(ais.messages(lines), type_), type_)


def tracks(tpv: DataFrame, timeout: int = 5) -> DataFrame:
    return sequence.segment_tracks(tpv, timeout)
