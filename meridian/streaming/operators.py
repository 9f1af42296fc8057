"""Streaming forms. Most operators run on streams unchanged; here are those that need state, windows or watermarks.

A stream with event time takes a watermark: rows later than it are dropped by Spark; split_late keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridian.functions.geo import earth_distance_small


def event_time(df: DataFrame, time: str = "time", late: str = "10 minutes") -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def window_stats(df: DataFrame, value: str, width: str = "1 day", slide: str | None = None, time: str = "time", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean and extremes of a value by tumbling or sliding window: signal, used, latency, offsets."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = event_time(df, time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "mean", "low", "high")


def moving_accuracy(df: DataFrame, width: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Spread of positions by sliding window and device, in metres, from sums that stream (no second pass)."""
    w = F.window("time", width, slide)
    agg = event_time(df, "time", late).groupBy(w.alias("w"), "device").agg(F.stddev_samp("lat").alias("s_lat"), F.stddev_samp("lon").alias("s_lon"), F.avg("lat").alias("lat_c"), F.count("*").alias("n"))
    x, y = F.col("s_lon") * 111320.0 * F.cos(F.radians("lat_c")), F.col("s_lat") * 111132.954
    return agg.select(F.col("w.start").alias("start"), "device", "n", (F.lit(0.5887) * (x + y)).alias("cep"))


def moving_percentiles(df: DataFrame, lat: float, lon: float, width: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes", accuracy: int = 10000) -> DataFrame:
    """Per device and sliding window: fixes, and the distances in metres from a known place within which 50, 95 and 99 % of
    them are. Quantiles come from a sketch that Spark merges from partial ones: ranks are off by 1 / accuracy of
    the fixes at most, and exact up to accuracy fixes."""
    metres = earth_distance_small("lat", "lon", lat, lon)
    w = F.window("time", width, slide)
    shares = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    agg = event_time(df.withColumn("__m", metres), "time", late).groupBy(w.alias("w"), "device").agg(F.count("__m").alias("n"), F.percentile_approx("__m", shares, accuracy).alias("p"))
    return agg.select(F.col("w.start").alias("start"), "device", "n", *[F.col("p")[k].alias(c) for k, c in enumerate(("cep50", "cep95", "cep99"))])


def session_tracks(df: DataFrame, timeout: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Tracks as sessions by device: for streams in order of time, where only gaps cut."""
    w = F.session_window("time", timeout)
    return event_time(df.filter("mode >= 2"), "time", late).groupBy(w.alias("w"), "device").agg(F.count("*").alias("n")).select("device", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def latest_state(df: DataFrame, columns: tuple[str, ...], time: str = "time") -> DataFrame:
    """The last report of each device; for output modes update and complete."""
    return df.groupBy("device").agg(F.max_by(F.struct(*columns), time).alias("last")).select("device", "last.*")


def dedupe(df: DataFrame, keys: tuple[str, ...], time: str = "time", late: str = "10 minutes") -> DataFrame:
    """One report per key within the watermark: seconds already reported, repeated samples."""
    return event_time(df, time, late).dropDuplicatesWithinWatermark(list(keys))


def split_late(df: DataFrame, late: float = 600.0, time: str = "time", order: str = "line_no", ttl_ms: int | None = 3_600_000, key: str = "device") -> DataFrame:
    """The rows of a stream with is_late: whether their time is over late seconds before the newest time of their device
    so far, in order of arrival. Nothing is dropped: late rows go to a side table by a filter, the others on.

    State is one number per device, the newest time; it is forgotten after ttl_ms without a row (never, if that is
    None), from when on the device starts anew. Rows without time are never late. For sinks in append mode.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", is_late boolean"

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        at = rows[time].map(lambda t: None if pd.isna(t) else pd.Timestamp(t).timestamp())
        so_far = at.astype(float).cummax().shift()
        so_far = so_far.ffill() if newest is None else so_far.ffill().fillna(newest).clip(lower=newest)
        yield rows.assign(is_late=(at.astype(float) < so_far - late).fillna(False).astype(bool))
        seen = [t for t in (newest, at.astype(float).max()) if t is not None and not pd.isna(t)]
        if seen:
            state.update((max(seen),))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(key).applyInPandasWithState(step, schema, "newest double", "append", timeout)


_FRAGMENT_STATE = "nfrags int, next int, payload string, line_no long"


def assemble_fragments(fragments: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """Whole vessel messages of a stream of fragments, by device and channel, as the batch operator makes them. The
    state of a key is one open message; it is forgotten after ttl_ms without a fragment."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_ = list(state.get) if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values("line_no", kind="stable")
        for r in rows.itertuples():
            if r.ifrag == 1:
                open_ = [int(r.nfrags), 2, r.payload, int(r.line_no)]
            elif open_ and r.ifrag == open_[1] and r.nfrags == open_[0]:
                open_ = [open_[0], open_[1] + 1, open_[2] + r.payload, int(r.line_no)]
            else:
                open_ = None
                continue
            if open_[1] > open_[0]:
                out.append((key[0], key[1], open_[3], open_[2], int(r.pad)))
                open_ = None
        if open_:
            state.update(tuple(open_))
            state.setTimeoutDuration(ttl_ms)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["device", "channel", "line_no", "payload", "pad"])

    return fragments.groupBy("device", "channel").applyInPandasWithState(step, "device string, channel string, line_no long, payload string, pad int", _FRAGMENT_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def merge_24(halves: DataFrame, ring: int = 8, ttl_ms: int = 3_600_000) -> DataFrame:
    """Type 24 halves of a stream put together, with a ring of the last A halves per device and channel as state; it is
    forgotten after ttl_ms without a half."""
    schema = "device string, channel string, line_no long, mmsi long, part string, shipname string, callsign string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ships, names = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for r in pd.concat(list(batches)).sort_values("line_no", kind="stable").itertuples():
            if r.part == "A":
                ships, names = ([*ships, int(r.mmsi)])[-ring:], ([*names, r.shipname])[-ring:]
                out.append((key[0], key[1], r.line_no, r.mmsi, "A", r.shipname, None))
                continue
            at = next((k for k in reversed(range(len(ships))) if ships[k] == r.mmsi), None)
            name = None if at is None else names[at]
            if at is not None:
                ships.pop(at), names.pop(at)
            out.append((key[0], key[1], r.line_no, r.mmsi, "B" if at is None else "both", name, r.callsign))
        state.update((ships, names))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["device", "channel", "line_no", "mmsi", "part", "shipname", "callsign"])

    return halves.groupBy("device", "channel").applyInPandasWithState(step, schema, "ships array<long>, names array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def end_of_cycle(rows: DataFrame, quiet_ms: int = 1000, step_s: float = 0.01) -> DataFrame:
    """Reports at the end of each cycle of a stream of decoded sentences (device string, line_no, tod, lat, lon, mode): a
    cycle ends when the time goes on, or when nothing comes for quiet_ms. Last values count, as in the batch merge."""
    schema = "device string, tod double, lat double, lon double, mode int, n int"

    def row(device, s):
        return pd.DataFrame([(device, s[0], s[1], s[2], None if s[3] is None else int(s[3]), int(s[4]))], columns=["device", "tod", "lat", "lon", "mode", "n"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield row(key[0], s)
            return
        for r in pd.concat(list(batches)).sort_values("line_no", kind="stable").itertuples():
            tod = None if pd.isna(r.tod) else float(r.tod)
            if s is None and tod is None:
                continue
            if s is not None and tod is not None and abs(tod - s[0]) > step_s:
                yield row(key[0], s)
                s = None
            s = s or [tod, None, None, None, 0]
            for k, v in ((1, r.lat), (2, r.lon), (3, r.mode)):
                s[k] = s[k] if pd.isna(v) else v
            s[4] += 1
        if s is not None:
            state.update((s[0], s[1], s[2], None if s[3] is None else int(s[3]), s[4]))
            state.setTimeoutDuration(quiet_ms)

    return rows.groupBy("device").applyInPandasWithState(step, schema, "tod double, lat double, lon double, mode int, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def offline_devices(df: DataFrame, silence_ms: int = 2000) -> DataFrame:
    """A row for each device that fell silent for silence_ms, two cycles usually."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame([(str(key[0]), n)], columns=["device", "reports"])
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        state.setTimeoutDuration(silence_ms)

    return df.groupBy("device").applyInPandasWithState(step, "device string, reports long", "reports long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def cycle_enders(rows: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Tags learnt to be the last timed ones of a cycle, by device, as a stream goes: (device, tag, n so far). What was
    learnt of a device is forgotten after ttl_ms without a sentence."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, tod, tags, counts = (list(state.get) if state.exists else [None, None, [], []])
        seen = dict(zip(list(tags), list(counts), strict=True))
        for r in pd.concat(list(batches)).sort_values("line_no", kind="stable").itertuples():
            if pd.isna(r.tod):
                continue
            if tod is not None and abs(r.tod - tod) > 0.01:
                seen[last] = seen.get(last, 0) + 1
            last, tod = r.tag, float(r.tod)
        state.update((last, tod, list(seen), list(seen.values())))
        state.setTimeoutDuration(ttl_ms)
        if seen:
            yield pd.DataFrame([(str(key[0]), t, n) for t, n in seen.items()], columns=["device", "tag", "n"])

    return rows.groupBy("device").applyInPandasWithState(step, "device string, tag string, n long", "last string, tod double, tags array<string>, counts array<long>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def fan_out(stream: DataFrame, sinks: dict[str, tuple[Callable[[DataFrame], DataFrame], str]], checkpoint: str):
    """One input, many subscribers: each micro-batch is filtered for each subscriber and appended to its folder."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        for choose, path in sinks.values():
            choose(batch).write.mode("append").parquet(path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
