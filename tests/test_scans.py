"""Segmented scans give the rows of one unsliced pass; moments and spans hold where they used to fail."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.operators import ais, enrich, nmea, profile, sequence
from meridian.operators.scan import scan


def rows_of(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), k * 3, r.choice([None, 1, 2, 5, 9]), r.choice([0, 1])) for k in range(n)]
    return spark.createDataFrame(rows, "device string, line_no long, v int, edge int").repartition(5)


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 20])
def test_scan_against_a_fold(spark, size):
    df = rows_of(spark)
    step = lambda now, before: F.when(before.isNull(), 10).when(now > before, 1).otherwise(0)
    mark = lambda now, before: F.coalesce(now < before, F.lit(False))
    out = scan(df, ("device",), "line_no", {"b": F.col("v"), "e": F.struct("edge", "line_no")}, total=("t", "b", step), held=("h", "b", mark), whole="w", size=size)
    want, ends = {}, {}
    state = {}
    for r in sorted(df.collect(), key=lambda r: r.line_no):
        before, total, held, last = state.get(r.device, (None, 0, None, None))
        now_total, now_held = total, held
        if r.v is not None:
            now_total += 10 if before is None else int(r.v > before)
            now_held = before if before is not None and r.v < before else held
        want[r.line_no] = (before, now_total, now_held, last)
        ends[r.device] = now_total
        state[r.device] = (before if r.v is None else r.v, now_total, now_held, (r.edge, r.line_no))
    got = out.collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.b, r.t, r.h, r.e and tuple(r.e)) == want[r.line_no] and r.w == ends[r.device]


@pytest.mark.parametrize("size", [3, 40])
def test_sliced_operators_give_the_unsliced_rows(spark, size):
    r = random.Random(4)
    n, t = 500, 1_600_000_000.0
    rows = []
    for k in range(n):
        t += r.choice([0, 0.004, 0.5, 1, 1, 1, 30, -2])
        rows.append((r.choice("xy"), k, t, r.choice([1, 2, 3, 3, 3]), r.random(), r.random(), r.random() * 9, r.randrange(1024), r.choice([None, None, "2024-02-28", "2024-02-29"]), r.choice([None, (t * 7) % 86400]), r.randrange(5), r.choice([0, 1])))
    df = spark.createDataFrame(rows, "device string, line_no long, s double, mode int, lat double, lon double, altHAE double, week int, date string, tod double, PRN int, edge int")
    df = df.withColumns({"time": F.timestamp_micros((F.col("s") * 1e6).cast("long")), "date": F.to_date("date"), "az": F.col("week") % 4, "el": F.col("mode"), "us": F.col("line_no") * 100_000})
    same = {
        "tracks": lambda z: sequence.segment_tracks(df, 5, size=z),
        "streak": lambda z: sequence.fix_streak(df, F.col("mode") >= 2, size=z),
        "second": lambda z: sequence.one_per_second(df, size=z),
        "samples": lambda z: sequence.dedupe_samples(df, "device", "mode", "PRN", "line_no", size=z),
        "rollovers": lambda z: sequence.rollover_count(df, size=z),
        "pulses": lambda z: sequence.classify_pulses(df, size=z * 100_000),
        "sky": lambda z: sequence.sat_tracks(df.withColumn("update", F.col("line_no")), keep=7, stale=4, size=z),
        "offsets": lambda z: profile.clock_offsets(df, "device", size=z),
        "previous": lambda z: enrich.previous_fix(df, ("lat", "mode"), size=z),
        "date": lambda z: nmea.carry_date(df, size=z),
        "epochs": lambda z: nmea.epochs(df, size=z),
    }
    for name, f in same.items():
        sliced, whole = (sorted(map(str, f(z).drop("time").collect())) for z in (size, 1 << 40))
        assert sliced == whole and sliced, name


def test_previous_fix_against_plain_windows(spark):
    r = random.Random(9)
    t, rows = 1_600_000_000.0, []
    for k in range(300):
        t += r.choice([0, 0.004, 0.02, 1])
        rows.append(("d", k, t, float(k)))
    df = spark.createDataFrame(rows, "device string, line_no long, s double, lat double").withColumn("time", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    got = {x.line_no: x.old_lat for x in enrich.previous_fix(df, ("lat",), size=11).collect()}
    micros = [round(x[2] * 1e6) for x in rows]
    old = None
    for k in range(300):
        if k and abs(micros[k] - micros[k - 1]) > 9900:
            old = float(k - 1)
        assert got[k] == old


def test_fragments_and_halves_in_slices(spark):
    r = random.Random(2)
    rows, line = [], 0
    for _ in range(120):
        n = r.choice([1, 1, 2, 3])
        for k in range(1, n + 1):
            if r.random() < 0.9:
                rows.append(("f", r.choice("AB") if r.random() < 0.1 else "A", line, n, k, f"p{line}", 0))
            line += 1
    fragments = spark.createDataFrame(rows, "device string, channel string, line_no long, nfrags int, ifrag int, payload string, pad int")
    assert sorted(ais.assemble_fragments(fragments, size=4).collect()) == sorted(ais.assemble_fragments(fragments, size=1 << 40).collect())
    halves = [("f", "A", k, 970000000 + r.randrange(4), r.choice("AB"), f"ship {k}", None) for k in range(200)]
    df = spark.createDataFrame(halves, "device string, channel string, line_no long, mmsi long, part string, shipname string, callsign string")
    got = {x.line_no: (x.part, x.shipname) for x in ais.merge_24(df, size=5).collect()}
    ring = []
    for _, _, k, mmsi, part, name, _ in halves:  # a ring of the last eight A halves, as a list
        if part == "A":
            ring = [*ring, (mmsi, name)][-8:]
            assert got[k] == ("A", name)
            continue
        at = max((i for i, (m, _) in enumerate(ring) if m == mmsi), default=None)
        if at is not None and ring[at][1]:
            assert got[k] == ("both", ring[at][1])
            ring[at] = (mmsi, None)
        else:
            assert got[k] == ("B", name)


@pytest.mark.parametrize(("at", "spread"), [(45.123456, 2e-4), (-122.4, 1.5e-4), (2e6, 100.0), (0.0, 1.0)])
def test_moments_far_from_zero(spark, at, spread):
    x = at + np.random.default_rng(3).exponential(size=5000) * spread
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    r = profile.stats_1d(df, "x").first()
    s = x.std(ddof=1)
    for kind, point in (("standard", x.mean()), ("reference", s)):
        r = profile.stats_1d(df, "x", (), kind).first()
        if spread > 0.001 or kind == "standard":
            for got, k in ((r.skewness, 3), (r.kurtosis, 4)):
                want = ((x - point) ** k).sum() / (len(x) * s**k)
                assert got == pytest.approx(want, rel=1e-6, abs=1e-6)
    assert (r.n, r.min, r.max) == (5000, x.min(), x.max())


def test_spans_over_midnight(spark):
    fixes = spark.createDataFrame([(1.0, 3, 1.0, 2.0, 3.0)], "time double, mode int, ecefx double, ecefy double, ecefz double")
    span = lambda *t: profile.obs_span(spark.createDataFrame([(float(x),) for x in t], "time double"), fixes).first()
    assert span(86370, 86400).interval == 30
    assert span(86370, 86400, 86400, 90000, 400_000).interval == 30
    assert span(5).interval is None and (span(5, 200_000).first, span(5, 200_000).last, span(5, 200_000).interval) == (5, 200_000, 199_995)


def plain_walk(rows, far):
    kept = []
    for r in sorted(rows, key=lambda r: r.line_no):
        if not kept or far(kept[-1], r):
            kept.append(r)
    return [r.line_no for r in kept]


@pytest.mark.parametrize("size", [100, 1 << 20])
def test_walks_over_several_days_and_slices(spark, size):
    """A receiver that stands, creeps and moves over three days, in slices that its rests span."""
    r = random.Random(5)
    lat, rows = 45.0, []
    for k in range(600):
        lat += r.choice([0, 0, 0, 2e-5, 3e-4]) if k % 250 > 120 else 0
        rows.append(("x" if k % 3 else "y", k, 1_600_000_000.0 + k * 400 + r.choice([0, 0, 200]), lat, 7.0))
    df = spark.createDataFrame(rows, "device string, line_no long, s double, lat double, lon double").withColumn("time", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).repartition(3)
    moved = lambda a, b: abs(b.lat - a.lat) * 111_140 >= 25 and a.s != b.s
    far = lambda a, b: (np.abs(b[0] - a[0]) * 111_140 >= 25) & (a[2] != b[2])
    later = lambda a, b: b.s - a.s >= 5000
    by = {d: [x for x in df.collect() if x.device == d] for d in "xy"}
    got = sequence.thin(df, 25.0, far=far, size=size).collect()
    assert sorted(x.line_no for x in got) == sorted(sum((plain_walk(x, moved) for x in by.values()), [])) and len(got) > 20
    got = sequence.decimate_exact(df, 5000, size=size).collect()
    assert sorted(x.line_no for x in got) == sorted(sum((plain_walk([y for y in x if round(y.s) % 5000 == 0], later) for x in by.values()), []))


def test_a_standing_receiver_keeps_one_fix(spark):
    df = spark.createDataFrame([("d", k, 86_390.0 + k, 45.0, 7.0) for k in range(40)], "device string, line_no long, s double, lat double, lon double").withColumn("time", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    assert [r.line_no for r in sequence.thin(df, 10.0, size=8).collect()] == [0]
    assert sorted(r.line_no for r in sequence.decimate_exact(df, 20, size=8).collect()) == [10, 30]
    tracks = sequence.segment_tracks(sequence.thin(df.withColumn("mode", F.lit(3)).withColumn("lat", F.when(F.col("line_no") < 30, 45.0).otherwise(46.0)), 10.0), 5)
    assert [(r.line_no, r.track_id) for r in tracks.orderBy("line_no").collect()] == [(0, 1), (30, 2)]  # the gap counts from the last one kept


def test_walks_keep_what_a_loop_keeps():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 400):
        for spread in (0.1, 1.0, 30.0):
            x = np.cumsum(r.normal(size=n) * spread)
            far = lambda a, b: np.abs(np.asarray(b[0]) - a[0]) >= 10
            for last in (None, [3.0]):
                want, kept = [], last and last[0]
                for k, v in enumerate(x):
                    if kept is None or abs(v - kept) >= 10:
                        want.append(k)
                        kept = v
                assert sequence.picked([x], far, last) == want


def test_clock_log_only_goes_on(spark):
    tpv = spark.createDataFrame([("d", k, t) for k, t in enumerate([100, 160, 130, 150, 170, 30])], "device string, line_no long, s long").withColumn("time", F.timestamp_seconds("s"))
    sky = spark.createDataFrame([("d", 90, 7, 1.5), ("d", 165, 8, 1.25)], "device string, s long, uSat int, tdop double").withColumn("time", F.timestamp_seconds("s"))
    got = [(int(r.time.timestamp()), r.uSat) for r in sequence.clock_log(tpv, sky).orderBy("time").collect()]
    assert got == [(100, 7), (170, 8)]


def test_late_rows_of_several_batches(spark, tmp_path, no_idle_batches):
    """The newest time goes from batch to batch."""
    from meridian.streaming import operators as streaming

    schema = "device string, line_no long, s long"
    batches = [[("a", 1, 100), ("a", 2, 50), ("b", 3, 5)], [("a", 4, 95), ("a", 5, 89), ("a", 6, 200), ("b", 7, None), ("b", 8, 4)], [("a", 9, 150), ("b", 10, -6), ("c", 11, 1)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("time", F.timestamp_seconds("s"))
        run = streaming.split_late(stream, 10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    got = {r.line_no: r.is_late for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: False, 9: True, 10: True, 11: False}


def test_documents_of_any_number_of_files(spark, tmp_path):
    """The files of a document one after the other are what one task writes."""
    from meridian.operators import sinks

    rows = [(f"d{k % 3}", k, 1_700_000_000 + k * 40 + k // 90 * 500, 3, 45.0 + k / 1e4, 7.0, 300.0, 1, 1.5) for k in range(300)]
    df = spark.createDataFrame(rows, "device string, line_no long, s long, mode int, lat double, lon double, altHAE double, status int, speed double").withColumns({"time": F.timestamp_seconds("s"), "track": F.lit(90.0)})
    for name, lines in (("gpx", sinks.gpx_lines(sequence.segment_tracks(df, 200))), ("kml", sinks.kml_lines(df))):
        texts = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            sinks.write_document(lines, str(tmp_path / f"{name}{n}"))
            files = sorted((tmp_path / f"{name}{n}").glob("part-*"))
            texts.append("".join(f.read_text() for f in files))
            assert len(files) > 1 or n == "1"
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert texts[0] == texts[1] and texts[0].startswith("<?xml") and texts[0].endswith("</gpx>\n" if name == "gpx" else "</kml>\n")
        if name == "gpx":
            from xml.etree import ElementTree

            tree = ElementTree.fromstring(texts[0])
            assert len(tree) == 3 * 4 and sum(len(seg) for trk in tree for seg in trk) == 300
