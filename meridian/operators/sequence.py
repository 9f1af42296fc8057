"""Window and sequence operators: tracks, thinning, streaks, pulses, as-of joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators.scan import SLICE, scan
from meridian.operators.tables import written


def seconds(time: str | Column) -> Column:
    c = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def _slices(df: DataFrame, order: str, size: int) -> DataFrame:
    return df.withColumn("__slice", F.floor(F.col(order) / size))


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows with the columns of their device's slice; a null device is one too."""
    named = carried.withColumnsRenamed({"device": "__of_device", "__slice": "__of_slice"})
    same = F.col("device").eqNullSafe(F.col("__of_device")) & F.col("__slice").eqNullSafe(F.col("__of_slice"))
    return rows.join(named, same).drop("__of_device", "__of_slice")


def segment_tracks(tpv: DataFrame, timeout: int = 5, time: str = "time", order: str = "line_no", size: int = SLICE) -> DataFrame:
    """Fixes of at least 2D with a track_id per device: a new track where the whole seconds to the fix before, in
    order of arrival, are over timeout, forwards or back. A fix at the time of the one before is dropped, and so is one
    without a time. One scan."""
    fixes = tpv.filter("mode >= 2").withColumn("__t", F.unix_micros(F.col(time).cast("timestamp"))).filter("__t is not null")
    apart = lambda t, before: F.when(before.isNull() | (F.floor(F.abs(t - before) / 1_000_000) > timeout), 1).otherwise(0)
    rows = scan(fixes, ("device",), order, {"__before": F.col("__t")}, total=("track_id", "__before", apart), size=size)
    return rows.filter("__before is null or __t <> __before").drop("__t", "__before")


Far = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def picked(values: list[np.ndarray], far: Far, last: list[float] | None) -> list[int]:
    """Places of the rows that a walk keeps: each is the first one after the one kept before that is far from it; last is
    what was kept before the first row, None if nothing.

    The next row to keep is known for most rows at once, by array operations over NEAR steps; from the others it is sought
    in stretches of doubling length. So the cost is linear in the rows, however many are kept.
    """
    n = len(values[0])
    following = np.full(n, -1)
    for step in range(1, min(NEAR, n - 1) + 1):
        open_ = np.flatnonzero(following[: n - step] < 0)
        hit = far([v[open_] for v in values], [v[open_ + step] for v in values])
        following[open_[hit]] = open_[hit] + step

    def sought(kept: list, at: int) -> int:
        width = 64
        while at < n:
            hit = far(kept, [v[at : at + width] for v in values])
            if hit.any():
                return at + int(hit.argmax())
            at, width = at + width, width * 2
        return n

    out, at = [], 0 if last is None else sought(last, 0)
    while at < n:
        out.append(at)
        at = int(following[at]) if following[at] >= 0 else sought([v[at] for v in values], at + NEAR + 1)
    return out


def _ends(ended: list[tuple[pa.RecordBatch, list[float] | None]]) -> pa.RecordBatch:
    """Keys of slices, a row each, with what was kept last."""
    keys = pa.Table.from_batches([k for k, _ in ended]).combine_chunks().to_batches()[0]
    return keys.append_column("last", pa.array([last for _, last in ended], pa.list_(pa.float64())))


#: Rows ahead that picked() looks at for all rows at once.
NEAR = 8


def keep_far(df: DataFrame, by: tuple[str, ...], order: str, values: tuple[str, ...], far: Far, size: int = SLICE) -> DataFrame:
    """Of each key's rows, in order, the first one, and each that is far (in its values, numbers without nulls) from the one
    kept before it.

    A walk, cut into slices of the order: what a slice keeps depends on the last row kept before it alone. Slices are
    walked as if that were what the slices before end with, so far as they are known, until no slice's last row changes;
    only slices whose start has changed are walked again. As a slice mostly comes to the same rows from any start, a few
    rounds do (one if keys fit in a slice), and no task has a whole key. Between rounds there is a table of a row per
    slice in the shared folder. Slices are dealt to tasks and sorted by Spark, and walked batch by batch: a task has many,
    and holds a batch.
    """
    keys = [f"__k{k}" for k in range(len(by))]
    mine = {f"__x{k}": F.col(v).cast("double") for k, v in enumerate(values)}
    rows = df.withColumns({**{k: F.col(c) for k, c in zip(keys, by, strict=True)}, "__slice": F.floor(F.col(order) / size), "__order": F.col(order), **mine})
    keys, numbers, given = [*keys, "__slice"], list(mine), df.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    state = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", last array<double>"
    slices = rows.select(*keys).distinct().withColumn("last", F.lit(None).cast("array<double>"))
    before = W.partitionBy(*keys[:-1]).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)

    def walk(whole: bool):
        """Over sorted rows, each slice behind the row of its start: the rows kept, or of each slice the last of them."""

        def run(batches):
            held = last = None
            for batch in batches:
                x = [batch.column(c).to_numpy(zero_copy_only=False) for c in numbers]
                starts, known = np.flatnonzero(batch.column("__begins").to_numpy(zero_copy_only=False)), batch.column(numbers[0]).is_valid().to_numpy(zero_copy_only=False)
                kept, ended, at = [], [], 0
                for begin in [*starts.tolist(), batch.num_rows]:
                    part = [v[at:begin] for v in x]
                    places = picked(part, far, last) if begin > at else []
                    if places:
                        kept += [at + i for i in places]
                        last = [float(v[places[-1]]) for v in part]
                    if begin < batch.num_rows:
                        if held is not None:
                            ended.append((held, last))
                        held, last, at = batch.slice(begin, 1).select(keys), [float(v[begin]) for v in x] if known[begin] else None, begin + 1
                if whole:
                    yield batch.take(pa.array(kept, pa.int64())).select(given)
                elif ended:
                    yield _ends(ended)
            if held is not None and not whole:
                yield _ends([(held, last)])

        return run

    def walked(of: DataFrame, starts: DataFrame, whole: bool) -> DataFrame:
        begin = starts.select(*keys, F.lit(True).alias("__begins"), *[F.col("last")[k].alias(c) for k, c in enumerate(numbers)])
        both = of.withColumn("__begins", F.lit(False)).unionByName(begin, allowMissingColumns=True)
        ordered = both.repartition(*keys).sortWithinPartitions(*keys, F.desc("__begins"), "__order")
        return ordered.mapInArrow(walk(whole), df.schema if whole else state)

    slices = written(slices)
    if slices.groupBy(*keys[:-1]).count().filter("count > 1").isEmpty():
        return walked(rows, slices, whole=True)
    narrow = rows.select(*keys, "__order", *mine)
    done = todo = None
    while todo is None or not todo.isEmpty():
        if todo is None:
            todo, now = slices, narrow
        else:
            now = narrow.join(todo.select(*[F.col(k).alias(f"_{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
        new = walked(now, todo, whole=False)
        if done is not None:
            again = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            old = done.select(*keys, "last").join(todo.select(*[F.col(k).alias(f"_{k}") for k in keys]), again, "left_anti")
            new = old.unionByName(new)
        starts = new.withColumn("start", F.last("last", ignorenulls=True).over(before))
        was = slices.withColumnRenamed("last", "was").withColumnsRenamed({k: f"_{k}" for k in keys})
        done = written(starts.join(was, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*keys, "last", "start", "was"))
        slices = done.select(*keys, F.col("start").alias("last"))
        todo = done.filter(~F.col("start").eqNullSafe(F.col("was"))).select(*keys, F.col("start").alias("last"))
    return walked(rows, slices, whole=True)


def vincenty_far(min_move: float) -> Far:
    """Far: at least min_move metres away and not at the same time, of latitude, longitude and seconds."""
    return lambda a, b: (np.nan_to_num(geo.vincenty(*(np.broadcast_to(np.asarray(v, float), np.shape(b[0])) for v in a[:2]), b[0], b[1])[0], nan=np.inf) >= min_move) & (a[2] != b[2])


def thin(tpv: DataFrame, min_move: float, time: str = "time", order: str = "line_no", far: Far | None = None, size: int = SLICE) -> DataFrame:
    """Drops fixes closer than min_move metres to the last one kept of the device, and those at its time. Fixes without
    position or time are dropped. segment_tracks after it cuts where the gap to the last fix kept is too long."""
    rows = tpv.withColumn("__s", seconds(time)).filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and __s is not null")
    return keep_far(rows, ("device",), order, ("lat", "lon", "__s"), far or vincenty_far(min_move), size).drop("__s")


def decimate(df: DataFrame, interval: int, time: str = "time", tie: str = "line_no") -> DataFrame:
    """Per device the first report of each second that the interval divides: for epochs on whole seconds."""
    whole = F.round(seconds(time)).cast("long")
    rows = df.withColumn("__s", whole).filter(F.col("__s") % interval == 0)
    w = W.partitionBy("device", "__s").orderBy(tie)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__s", "__n")


def decimate_exact(df: DataFrame, interval: float, time: str = "time", order: str = "line_no", size: int = SLICE) -> DataFrame:
    """As decimate, for epochs at any time: at least interval after the last one kept, on a rounded multiple."""
    rows = df.withColumn("__s", seconds(time)).filter(F.col("__s").isNotNull() & (F.rint("__s") % interval == 0))
    return keep_far(rows, ("device",), order, ("__s",), lambda a, b: b[0] - a[0] >= interval, size).drop("__s")


def slip_flag(obs: DataFrame, interval_ms: int) -> DataFrame:
    """Marks observations whose lock is younger than the interval."""
    return obs.withColumn("lli", F.when(F.col("locktime") < interval_ms, F.coalesce("lli", F.lit(0)).bitwiseOR(2)).otherwise(F.col("lli")))


def dedupe_samples(samples: DataFrame, unit: str, received: str, clock: str, order: str, size: int = SLICE) -> DataFrame:
    """Drops a sample whose reception or clock time is that of the unit's sample before."""
    rows = scan(samples, (unit,), order, {"__before": F.struct(F.col(received).alias("r"), F.col(clock).alias("c"))}, size=size)
    same = F.coalesce((F.col(received) == F.col("__before.r")) | (F.col(clock) == F.col("__before.c")), F.lit(False))
    return rows.filter(~same).drop("__before")


def fix_streak(tpv: DataFrame, good: Column, order: str = "line_no", size: int = SLICE) -> DataFrame:
    """Adds streak: how many good fixes in a row end here; 0 at one that isn't good.

    Counted within slices of a device's order, as segment_tracks does; a slice's rows and the place of its last bad one
    tell how long the streak is that goes on into the next slice.
    """
    w = W.partitionBy("device", "__slice").orderBy(order)
    rows = _slices(tpv, order, size).withColumn("__at", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("__bad", F.max(F.when(good, None).otherwise(F.col("__at"))).over(w.rowsBetween(W.unboundedPreceding, 0)))

    sums = rows.groupBy("device", "__slice").agg(F.max("__at").alias("__rows"), F.max("__bad").alias("__last"))
    earlier = W.partitionBy("device").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__start", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    open_ = F.col("__start") - F.coalesce(F.max(F.col("__start") + F.col("__last")).over(earlier), F.lit(0))
    out = _with_carried(rows, sums.select("device", "__slice", open_.alias("__open")))
    return out.withColumn("streak", F.col("__at") - F.coalesce(F.col("__bad"), -F.col("__open"))).drop("__slice", "__at", "__bad", "__open")


def one_per_second(tpv: DataFrame, min_good: int = 3, time: str = "time", order: str = "line_no", size: int = SLICE) -> DataFrame:
    """Reports of a second that isn't the one reported last, once over min_good good fixes have come in a row. Every
    eligible row is of the second reported last or reported itself, so the eligible row before tells that second."""
    rows = fix_streak(tpv, F.col("mode") >= 2, order, size).filter(F.col("streak") > min_good).withColumn("__s", F.floor(seconds(time))).filter("__s <> 0")
    rows = scan(rows, ("device",), order, {"__last": F.col("__s")}, size=size)
    return rows.filter(F.col("__last").isNull() | (F.col("__s") != F.col("__last"))).drop("__s", "__last")


def classify_pulses(edges: DataFrame, time_us: str = "us", edge: str = "edge", size: int = SLICE << 15) -> DataFrame:
    """Adds cycle (since the last same edge), duration (since the last other edge), in microseconds, kind, and
    whether the edge starts a second. size is of microseconds, some ten hours."""
    t, up = F.col(time_us), F.col(edge) == 1
    rows = scan(edges, ("device",), time_us, {"__up": F.when(up, t), "__down": F.when(F.col(edge) == 0, t)}, size=size)
    same, other = F.when(up, F.col("__up")).otherwise(F.col("__down")), F.when(up, F.col("__down")).otherwise(F.col("__up"))
    out = rows.withColumns({"cycle": t - same, "duration": t - other}).drop("__up", "__down")
    c, d = F.col("cycle"), F.col("duration")
    kind = (
        F.when(c.isNull() | d.isNull(), "too early")
        .when(c < 0, "clock went back")
        .when(c < 180000, "too short for 5 Hz")
        .when(c < 201000, F.when(d < 100000, "5 Hz").otherwise("5 Hz, long part"))
        .when(c < 900000, "too long for 5 Hz, too short for 1 Hz")
        .when(c < 1100000, F.when(d == 0, "1 Hz invisible").when(d < 450000, "1 Hz trailing").when(d < 555000, "1 Hz square").otherwise("1 Hz leading"))
        .when(c < 1800000, "too long for 1 Hz, too short for 0.5 Hz")
        .when(c < 2200000, F.when(d < 990000, "0.5 Hz, too short").when(d < 1100000, "0.5 Hz square").otherwise("0.5 Hz, too long"))
        .otherwise("too long for 0.5 Hz")
    )
    starts = kind.isin("5 Hz", "1 Hz invisible", "1 Hz leading", "0.5 Hz square") | ((kind == "1 Hz square") & (F.col(edge) == 1))
    return out.withColumns({"kind": kind, "starts": starts})


def sat_tracks(sats: DataFrame, keep: int = 1024, stale: int = 10, update: str = "update", size: int = SLICE) -> DataFrame:
    """Per satellite the last keep positions that differ from the one before; the track is forgotten, and begun
    anew, where the satellite went unseen for over stale updates."""
    lost = lambda now, before: F.when(now["u"] - before["u"] > stale, 1).otherwise(0)
    rows = scan(sats, ("PRN",), update, {"__b": F.struct(F.col(update).alias("u"), "az", "el")}, total=("__island", "__b", lost), whole="__last", size=size)
    moved = F.coalesce((F.col("az") != F.col("__b.az")) | (F.col("el") != F.col("__b.el")) | (F.col(update) - F.col("__b.u") > stale), F.lit(True))
    rows = rows.filter(F.col("__island") == F.col("__last")).filter(moved).drop("__b", "__island", "__last")
    rows = scan(rows, ("PRN",), update, {"__one": F.lit(1)}, total=("__k", "__one", lambda *_: F.lit(1)), whole="__n", size=size)
    return rows.filter(F.col("__n") - F.col("__k") < keep).drop("__one", "__k", "__n")


def asof(left: DataFrame, right: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("device",), time: str = "time") -> DataFrame:
    """Each left row with the latest right row at or before its time, per key: union, then the last one seen.

    Of right rows at one time the one with the largest columns counts. A key is cut into days, so that no task sorts
    all of its rows: each day begins with the last right row before it, from a table of one row per key and day. One
    shuffle of both sides, by key and day. Times are timestamps, dates, texts that sort as times, or seconds.
    """
    kind = left.schema[time].dataType
    day = {"timestamp": F.to_date(time), "timestamp_ntz": F.to_date(time), "date": F.col(time), "string": F.substring(time, 1, 10)}.get(kind.simpleString(), F.floor(F.col(time) / 86400))
    value = F.struct(*columns)
    nothing = F.lit(None).cast(left.schema).alias("__left")
    r = right.select(*by, day.alias("__day"), F.col(time).alias("__t"), F.lit(0).alias("__side"), value.alias("__right"), nothing)
    le = left.select(*by, day.alias("__day"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__right"].dataType).alias("__right"), F.struct(*left.columns).alias("__left"))

    ends = r.groupBy(*by, "__day").agg(F.max(F.struct("__t", "__right")).alias("__end"))
    days = ends.unionByName(le.select(*by, "__day").distinct(), allowMissingColumns=True).groupBy(*by, "__day").agg(F.max("__end").alias("__end"))
    earlier = F.last("__end", ignorenulls=True).over(W.partitionBy(*by).orderBy("__day").rowsBetween(W.unboundedPreceding, -1))
    carried = days.withColumn("__end", earlier).filter("__end is not null")
    carried = carried.select(*by, "__day", F.lit(None).cast(kind).alias("__t"), F.lit(-1).alias("__side"), F.col("__end.__right").alias("__right"), nothing)

    w = W.partitionBy(*by, "__day").orderBy("__t", "__side", "__right").rowsBetween(W.unboundedPreceding, 0)
    both = r.unionByName(carried).unionByName(le).withColumn("__seen", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select("__left.*", *[F.col(f"__seen.{c}").alias(f"{c}_seen" if c in left.columns else c) for c in columns])


def attach_sky(tpv: DataFrame, sky: DataFrame, columns: tuple[str, ...] = ("uSat", "hdop", "vdop", "pdop")) -> DataFrame:
    return asof(tpv, sky, columns)


def clock_log(tpv: DataFrame, sky: DataFrame, wait: int = 60, order: str = "line_no", size: int = SLICE) -> DataFrame:
    """Per device and interval of wait seconds: the last time, and satellites used and tdop of the latest skyview. A fix
    counts only if its time is later than that of the fix before, in order of arrival."""
    rows = scan(tpv, ("device",), order, {"__before": F.col("time")}, size=size)
    rows = rows.filter("__before is null or time > __before").drop("__before")
    seen = asof(rows, sky.filter("uSat is not null"), ("uSat", "tdop"))
    last = seen.groupBy("device", F.window(F.col("time").cast("timestamp"), f"{wait} seconds").alias("interval"))
    return last.agg(F.max_by(F.struct("time", "uSat", "tdop"), "time").alias("last")).select("device", "last.*")


def strip_chart(tpv: DataFrame, fields: tuple[str, ...], step: str = "1 minute", system: str | None = None) -> DataFrame:
    """Means of fields by step of time."""
    from meridian.operators.filters import convert_units

    rows = convert_units(tpv, system) if system else tpv
    return rows.groupBy("device", F.window(F.col("time").cast("timestamp"), step)["start"].alias("start")).agg(*[F.avg(f).alias(f) for f in fields])


def rollover_count(df: DataFrame, week: str = "week", order: str = "line_no", size: int = SLICE) -> DataFrame:
    """Adds rollovers: how often the ten-bit week has dropped so far."""
    drop = lambda now, before: F.when(now < before % 1024, 1).otherwise(0)
    return scan(df, ("device",), order, {"__week": F.col(week)}, total=("rollovers", "__week", drop), size=size).drop("__week")
