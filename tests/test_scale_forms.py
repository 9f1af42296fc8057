"""Operators that split a hot device over tasks, against plain forms that don't."""

import random

import pytest
from pyspark.sql import functions as F

from meridian.operators import profile, sequence

SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _plain_ranks(rows):
    out = []
    for device in sorted({r[0] for r in rows}):
        ranked = [r for r in sorted((r for r in rows if r[0] == device), key=lambda r: (r[2] is not None, r[2] or 0.0, r[1]))]
        out.append((device, len(ranked), *(ranked[int(len(ranked) * p)][3] for p in SHARES.values()), ranked[-1][3]))
    return out


@pytest.mark.parametrize("kind", ["spread", "tied", "one value", "nulls"])
def test_ranks_are_exact_whoever_is_sorted_together(spark, kind):
    rng = random.Random(7)
    value = {"spread": lambda: rng.gauss(0, 5), "tied": lambda: float(rng.choice([1, 1, 1, 2, 3, 9])), "one value": lambda: 4.0, "nulls": lambda: rng.choice([None, None, 1.0, rng.random()])}[kind]
    rows = [(1 if i % 3 else i % 7, i, value(), float(i % 101)) for i in range(4000)] + [(99, 5000, value(), 1.0)]
    df = spark.createDataFrame(rows, "device long, line_no long, d double, m double").repartition(5)
    got = profile.at_ranks(df, SHARES, "d", "m", "line_no", chunk=64).orderBy("device").collect()
    assert [tuple(r) for r in got] == _plain_ranks(rows)


def test_ranks_of_no_rows(spark):
    df = spark.createDataFrame([], "device long, line_no long, d double, m double")
    assert profile.at_ranks(df, SHARES, "d", "m", "line_no").collect() == []


@pytest.mark.parametrize("kind", ["string", "double", "timestamp"])
def test_asof_carries_rows_into_later_days(spark, kind):
    rng = random.Random(11)
    seconds = lambda n, days: [(rng.choice("ab"), rng.choice(days) * 86400 + rng.randrange(0, 86400, 3600), i) for i in range(n)]
    left, right = seconds(200, range(40)), seconds(30, (3, 4, 11, 30)) + [("c", 0, 1)]
    left += [("d", 5, 1000), ("a", None, 1001)]
    time = {"double": "cast(s as double)", "timestamp": "timestamp_seconds(s)", "string": "date_format(timestamp_seconds(s), \"yyyy-MM-dd'T'HH:mm:ss\")"}[kind]
    frame = lambda rows, name: spark.createDataFrame(rows, f"device string, s long, {name} long").selectExpr("device", f"{time} as time", name)
    got = {r["n"]: r["k"] for r in sequence.asof(frame(left, "n"), frame(right, "k"), ("k",)).collect()}
    want = {n: max(((t, k) for e, t, k in right if e == d and s is not None and t <= s), default=(0, None))[1] for d, s, n in left}
    assert got == want


def _reports(spark, n=600):
    """Reports of devices of all sizes, a null one too, with gaps, repeated and missing times."""
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 1, 1, 2, 9, -20])
        rows.append((rng.choice(["a", "a", "a", "b", None]), i, 1_700_000_000 + t if rng.random() < 0.95 else None, rng.choice([1, 2, 3, 3, 3, 3, None])))
    rows += [("a", n + k, 1_700_000_000, 3) for k in range(50)]
    return rows, spark.createDataFrame(rows, "device string, line_no long, s long, mode int").selectExpr("*", "timestamp_seconds(s) as time").repartition(5)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_tracks_and_streaks_are_the_same_in_any_slices(spark, size):
    rows, df = _reports(spark)
    tracks, streaks = {}, {}
    for device in ("a", "b", None):
        last, track, streak = None, 0, 0
        for _, line, s, mode in (r for r in rows if r[0] == device):
            good = mode is not None and mode >= 2
            streak = streak + 1 if good else 0
            streaks[line] = streak
            if not good or s is None or s == last:
                continue
            track += last is None or abs(s - last) > 5
            last, tracks[line] = s, track
    assert {r["line_no"]: r["track_id"] for r in sequence.segment_tracks(df, size=size).collect()} == tracks
    got = sequence.fix_streak(df, F.col("mode") >= 2, size=size)
    assert {r["line_no"]: r["streak"] for r in got.collect()} == streaks
    assert got.columns == [*df.columns, "streak"]


def test_asof_without_right_rows(spark):
    left = spark.createDataFrame([("a", 5.0, 1)], "device string, time double, n long")
    right = spark.createDataFrame([], "device string, time double, k long")
    assert [tuple(r) for r in sequence.asof(left, right, ("k",)).select("n", "k").collect()] == [(1, None)]
