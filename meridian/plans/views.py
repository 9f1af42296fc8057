"""The given event table seen as fixes and satellite observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The same expressions run in Spark and in the oracle's engine.
FIX_COLUMNS = """
  event_id as line_no, user_id as device, ts as time, event_type,
  case event_type when 'error' then 1 when 'signup' then 2 else 3 end as mode,
  case when event_id % 7 = 0 then 2 else 1 end as status,
  45e0 + ((event_id * 7919) % 100000) / 1e6 as lat,
  7e0 + ((event_id * 104729) % 100000) / 1e6 as lon,
  300e0 + value as altHAE,
  cast(regexp_extract(props, '([0-9]+)', 1) as int) % 32 + 1 as prn,
  (event_id * 37) % 360 as az, (event_id * 11) % 91 as el,
  least(60e0, value / 4e0) as ss,
  (event_id % 3 <> 0) as used,
  value
"""
FIX_SQL = f"fix_view as (select {FIX_COLUMNS} from events)"


def fix_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_split(FIX_COLUMNS))


def _split(columns: str) -> list[str]:
    """The top-level comma-separated parts of a select list."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(columns[start:i].strip())
            start = i + 1
    return [*parts, columns[start:].strip()]


def day_of(time: str = "time") -> str:
    return f"cast({time} as date)"
