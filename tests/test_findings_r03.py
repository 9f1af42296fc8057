"""What the review of round 3 found, held against plain forms."""

import functools
import operator

import pytest
from pyspark.sql import functions as F

from meridian.operators import ais, joins, nmea, sequence
from meridian.operators.scan import scan
from meridian.plans import QUERIES


def test_sorted_counts_go_over_five_digits(spark, tmp_path):
    rows = spark.range(100_001).selectExpr("id * 3 + 1 as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "1L as user_id", "'view' as event_type", "1D as value", "'{\"k\": 0}' as props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    assert [r["n"] for r in QUERIES["sorted_counts"](spark, str(tmp_path)).collect()] == [100_001]


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_walks_of_many_keys_share_tasks(spark, size):
    """No Python call of its own for each key and slice; the rows are those of a plain walk."""
    rows = [(i % 40 if i % 41 else None, i, (i * 7919 % 13) + i / 20.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "device long, line_no long, x double").repartition(5)
    far = lambda a, b: b[0] - a[0] >= 9
    out = sequence.keep_far(df, ("device",), "line_no", ("x",), far, size=size)
    assert "CoGroups" not in out._jdf.queryExecution().toString()
    kept, last = set(), {}
    for device, line, x in rows:
        if device not in last or x - last[device] >= 9:
            last[device] = x
            kept.add(line)
    assert {r["line_no"] for r in out.collect()} == kept


@pytest.mark.parametrize("at", [66, 68, 70, 67])
def test_long_texts_of_short_messages_are_read_to_the_end(spark, at):
    """From any bit on, in a field that is much longer than the message."""
    bits = "0" * at + "000001000010" * 9
    payload = "".join(ais.ARMOR[int(bits[i : i + 6].ljust(6, "0"), 2)] for i in range(0, len(bits), 6))
    df = spark.createDataFrame([(payload, -len(bits) % 6)], "payload string, pad int")
    assert df.select(ais.sixbit(ais.unarmor(F.col("payload"), F.col("pad")), at, 942)).collect()[0][0] == "AB" * 9


def test_checksums_of_any_length_and_alphabet(spark):
    bodies = ["", "G", "GPGGA,1", "GPGGA,12", "x" * 1000 + "y", "é,1", "GPTXT,ü"]
    want = [functools.reduce(operator.xor, map(ord, b), 0) for b in bodies]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    assert [r[0] for r in df.orderBy("k").select(nmea.checksum(F.col("body"))).collect()] == want


def test_scans_of_costly_rows_make_them_once(spark):
    """Both sides read one shuffle; the columns that only one of them needs are the same."""
    df = spark.range(3000).selectExpr("id % 7 as device", "id as line_no", "if(id % 5 = 0, null, (id * 37) % 11) as x", "cast(id as string) as text").repartition(3)
    step = lambda now, before: F.when(before.isNull() | (now > before), 1).otherwise(0)
    plain, costly = (scan(df, ("device",), "line_no", {"b": F.col("x")}, total=("t", "b", step), size=500, costly=c) for c in (False, True))
    assert sorted(map(tuple, costly.collect()), key=lambda r: r[1]) == sorted(map(tuple, plain.collect()), key=lambda r: r[1])
    assert "ReusedExchange" in costly._jdf.queryExecution().executedPlan().toString()


def test_a_way_of_sentences_reads_its_lines_once(spark):
    """nmea.fixes scans for dates, epochs and lost locks, over one reading."""
    bodies = ["GPRMC,120000.00,A,4500.0,N,00700.0,E,5.0,90.0,010124,,,A", "GPGGA,120000.00,4500.0,N,00700.0,E,1,08,1.0,300.0,M,0.0,M,,"]
    lines = spark.createDataFrame([("d", k, b) for k, b in enumerate(bodies)], "file string, line_no long, body string")
    out = nmea.fixes(lines.select("file", "line_no", F.concat(F.lit("$"), "body", F.lit("*"), nmea.hex_checksum(F.col("body"))).alias("value")))
    assert [(r["mode"], r["lat"], str(r["time"])) for r in out.collect()] == [(3, 45.0, "2024-01-01 12:00:00")]
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ExistingRDD") == 1


def test_stations_of_cells_below_and_over_the_list_size(spark):
    """Lists and windows give the same ranks; no window where cells are small."""
    fixes = spark.createDataFrame([(k, 45.0 + k % 10 * 3, 178.0 + k % 4) for k in range(40)], "line_no long, lat double, lon double")
    stations = spark.createDataFrame([(f"s{k:02}", 44.0 + k / 10, -179.0 + k % 3) for k in range(60)], "server string, lat double, lon double")
    rows = {n: sorted(map(tuple, joins.nearest_stations(fixes, stations, 5, 400_000.0, listed=n).collect())) for n in (0, 30, 1000)}
    assert rows[0] == rows[30] == rows[1000] and rows[0]
