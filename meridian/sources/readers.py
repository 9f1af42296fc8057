"""Readers. Text in, typed rows out; what doesn't parse goes to a quarantine frame, never away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.sources.schemas import SCHEMAS, SESSION


def _nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c, t in df.dtypes if t == "double"})


def parse_reports(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(reports with class and the line itself, quarantine) of lines. Batch or streaming."""
    tagged = lines.withColumn("class", F.when(F.col(value).startswith("{"), F.get_json_object(value, "$.class")))
    return tagged.filter("class is not null"), tagged.filter("class is null").drop("class")


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A report log: JSON lines by class; sentences, comments and broken lines in quarantine."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_reports(lines)


def stream_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same as an unbounded input: files as they arrive in a folder."""
    return parse_reports(spark.readStream.text(path))


def stream_reports_kafka(spark: SparkSession, servers: str, topic: str) -> tuple[DataFrame, DataFrame]:
    """The same from Kafka; takes Spark's Kafka connector on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_reports(rows.select(F.col("value").cast("string").alias("value")))


def report_table(reports: DataFrame, class_: str, value: str = "value") -> DataFrame:
    """The typed table of a class. Unknown attributes stay in _raw; NaN and infinities become null."""
    if class_ in SESSION:
        return reports.filter(F.col("class") == class_).select("class", F.col(value).alias("payload"))
    rows = reports.filter(F.col("class") == class_)  # the cheap test comes before the parse
    parsed = rows.select(F.from_json(value, SCHEMAS[class_]).alias("r"), F.col(value).alias("_raw")).select("r.*", "_raw")
    return _nan_to_null(parsed)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): sentences with their place in the file, counted from 1 with empty lines; these are left out.

    A file is read in as many parts as Spark cuts it into. A line's number is its place in its part, which a task
    knows, plus the lines of all parts before: a prefix sum over a table of one row per part. A part's rows come one
    after the other in one task, whose row numbers only have to be told from the part's first one.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("__part"), F.monotonically_increasing_id().alias("__row"))
    parts = lines.groupBy("file", "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("file").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("file", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    numbered = lines.join(parts, ["file", "__part"]).select("file", (F.col("__row") + F.col("__shift")).alias("line_no"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("value"))
    return numbered.filter("value <> ''")


def log_headers(lines: DataFrame, names: tuple[str, ...] = ("Name", "Chipset", "Submitter", "Date", "Time", "Location")) -> DataFrame:
    """One row per file with its header lines (# Name: value) as columns; the first of a name counts."""
    pairs = lines.filter(F.col("value").startswith("#")).select("file", "line_no", F.regexp_extract("value", "^# ([A-Za-z-]+): *(.*)$", 1).alias("key"), F.regexp_extract("value", "^# ([A-Za-z-]+): *(.*)$", 2).alias("text"))
    return pairs.filter("key <> ''").groupBy("file").pivot("key", list(names)).agg(F.min_by("text", "line_no"))


def _fields(df: DataFrame, columns: list[tuple[str, str]], parts: str = "p") -> DataFrame:
    return df.select(*[F.try_element_at(parts, F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(columns)])


def read_station_list(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, server) lines; # starts a comment."""
    text = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("value")).filter("value <> ''")
    return _fields(text.select(F.split("value", r"\s+").alias("p")), [("lat", "double"), ("lon", "double"), ("server", "string")])


SOURCETABLE = [(n, t) for t, ns in (("string", "rec mountpoint identifier format format_details"), ("int", "carrier"), ("string", "nav_system network country"), ("double", "lat lon"), ("int", "nmea solution"), ("string", "generator compression authentication fee"), ("int", "bitrate")) for n in ns.split()]


def read_sourcetable(spark: SparkSession, path: str) -> DataFrame:
    """STR records of a caster's source table."""
    rows = spark.read.text(path).filter(F.col("value").startswith("STR;"))
    return _fields(rows.select(F.split("value", ";").alias("p")), SOURCETABLE)


def _nanoseconds(text) -> F.Column:
    """Whole nanoseconds of decimal seconds in text, never through a double."""
    whole, fraction = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    return whole.try_cast("long") * F.lit(1_000_000_000) + F.rpad(fraction, 9, "0").substr(1, 9).try_cast("long")


def parse_clock_samples(lines: DataFrame, value: str = "value") -> DataFrame:
    """`sample NAME seen clock real leap prec` lines, with times in nanoseconds; other lines are dropped."""
    p = lines.filter(F.col(value).startswith("sample ")).select(*[c for c in lines.columns if c != value], F.split(F.trim(value), r"\s+").alias("p")).filter(F.size("p") >= 7)
    at = lambda i: F.get("p", F.lit(i))
    return p.withColumns({"unit": at(1), "seen_ns": _nanoseconds(at(2)), "clock_ns": _nanoseconds(at(3)), "real_ns": _nanoseconds(at(4)), "leap": at(5).try_cast("int"), "precision": at(6).try_cast("int")}).drop("p")


def read_clock_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_clock_samples(read_sentences(spark, path))


def read_peerstats(spark: SparkSession, path: str) -> DataFrame:
    """(day, second, peer, status, offset, delay, dispersion, skew) of NTP peerstats."""
    names = [("day", "int"), ("second", "double"), ("peer", "string"), ("status", "string"), ("offset", "double"), ("delay", "double"), ("dispersion", "double"), ("skew", "double")]
    return _fields(spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")), names)
