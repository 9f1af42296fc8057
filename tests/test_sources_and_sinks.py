"""Readers, writers and streaming operators on rows of their own."""

import re

import pytest
from pyspark.sql import functions as F

from meridian.functions.register import PROFILES
from meridian.operators import filters, sinks
from meridian.sources import readers
from meridian.streaming import operators as streaming


def test_headers_of_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("# Name: BT-Q818\n# Chipset: MTK\n# Name: later\n# no header\n$GPGGA,1*00\n")
    (tmp_path / "b.log").write_text("$GPGGA,1*00\n# Date: 2010-06-03\n# Location: here, there\n")
    got = {r.file.rpartition("/")[2]: r for r in readers.log_headers(readers.read_sentences(spark, str(tmp_path))).collect()}
    assert (got["a.log"].Name, got["a.log"].Chipset, got["a.log"].Date) == ("BT-Q818", "MTK", None)
    assert (got["b.log"].Date, got["b.log"].Location, got["b.log"].Name) == ("2010-06-03", "here, there", None)


def test_peerstats(spark, tmp_path):
    (tmp_path / "peerstats").write_text("55000 120.5 127.127.28.0 9014 0.001 0.000 0.0005 0.0002\n  55000 136.5 10.0.0.1 9614 -0.25 0.01 0.002 0.001\nshort 1\n")
    rows = readers.read_peerstats(spark, str(tmp_path / "peerstats")).collect()
    assert [tuple(r) for r in rows[:2]] == [(55000, 120.5, "127.127.28.0", "9014", 0.001, 0.0, 0.0005, 0.0002), (55000, 136.5, "10.0.0.1", "9614", -0.25, 0.01, 0.002, 0.001)]
    assert (rows[2].day, rows[2].second, rows[2].peer) == (None, 1.0, None)


def test_streamed_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"class":"TPV","mode":3}\n$GPGGA\n{"class":"SKY"}\n')
    reports, rest = readers.stream_reports(spark, str(tmp_path / "in"))
    for df, name in ((reports.select("class"), "r"), (rest.select("value"), "q")):
        run = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}s")).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "r")).collect()) == ["SKY", "TPV"]
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "q")).collect()] == ["$GPGGA"]


@pytest.mark.parametrize(("header", "first"), [(0, None), (1, "a,b"), (2, "# a,b")])
def test_written_csv(spark, tmp_path, header, first):
    df = spark.createDataFrame([(1, None, 9), (2, "x", 9)], "a int, b string, c int").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"), ("a", "b"), header)
    lines = sum((f.read_text().splitlines() for f in sorted((tmp_path / "out").glob("part-*"))), [])
    assert sorted(x for x in lines if x != first) == ["1,", "2,x"] and (first is None or first in lines)


def test_written_tables(spark, tmp_path):
    df = spark.createDataFrame([("d", 1_700_000_000), ("d", 1_700_100_000)], "device string, s long").withColumn("time", F.timestamp_seconds("s"))
    sinks.write_tables({"TPV": df, "DEVICE": df.drop("time")}, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "tpv").glob("date=*")) == ["date=2023-11-14", "date=2023-11-16"]
    assert spark.read.parquet(str(tmp_path / "device")).count() == 2


def test_timestamped_lines(spark):
    rows = filters.timestamp_lines(spark.createDataFrame([("$GPGGA",)], "value string")).collect()
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d: \$GPGGA", rows[0].value)


def test_profiles_by_name(spark):
    rows = [("d", k, 3 if k else 1, 45.0 + k / 1e5, 7.0, 300.0 + k) for k in range(30)]
    df = spark.createDataFrame(rows, "device string, line_no long, mode int, lat double, lon double, altHAE double")
    assert [r.n for r in PROFILES["space"].run(df).collect()] == [29]
    assert [r.n for r in PROFILES["cep"].run(df).collect()] == [29]
    pps = spark.createDataFrame([(1, 5, 1, 3), (2, 9, 2, 3)], "real_sec long, real_nsec long, clock_sec long, clock_nsec long")
    assert PROFILES["pps"].run(pps).first().mean == 4.0


def test_one_input_for_many_subscribers(spark, tmp_path):
    spark.createDataFrame([("TPV", 1), ("SKY", 2), ("TPV", 3)], "class string, k int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("class string, k int").parquet(str(tmp_path / "in"))
    sinks_ = {c: (lambda df, c=c: df.filter(F.col("class") == c), str(tmp_path / c)) for c in ("TPV", "SKY")}
    assert streaming.fan_out(stream, sinks_, str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "TPV")).collect()) == [1, 3]
    assert [r.k for r in spark.read.parquet(str(tmp_path / "SKY")).collect()] == [2]


def test_latest_state_and_repeated_reports_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 7), ("b", 2, 6), ("a", 3, 8)], "device string, s long, mode int").withColumn("time", F.timestamp_seconds("s"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = streaming.latest_state(stream, ("s",)).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert {(r.device, r.s) for r in spark.table("latest").collect()} == {("a", 3), ("b", 2)}
    run = streaming.dedupe(stream, ("device", "time")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted((r.device, r.s) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("a", 3), ("b", 2)]
