"""Sharding by balanced label propagation: copies move together under the shards' capacity. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.llm.common import drop, materialize, table

#: A document of over 1 / HEAVY of a shard's share is placed on its own: there are shards * HEAVY of them at most.
HEAVY = 64
#: Rounds of propagation at most; they end once less than SETTLED of the linked bytes moves.
ROUNDS, SETTLED = 8, 0.0005
#: Steps in which movers are let in.
STEPS = 1024
#: Groups of more documents than this are split where they have to be, document by document; smaller ones move whole.
WHOLE = 1000
#: Rows of a bucket in which places on a line are numbered.
BUCKET_ROWS = 20_000


def _unit(c: Column, seed: int) -> Column:
    """A double in [0, 1) from a 64-bit hash."""
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _below(values: list[float], c: Column) -> Column:
    """How many of the (rising) values are at most c: the interval that c is in."""
    return F.size(F.filter(F.array(*[F.lit(float(v)) for v in values]), lambda v: v <= c))


def _running(values: list[float]) -> list[float]:
    out, total = [], 0.0
    for v in values:
        total += v
        out.append(total)
    return out


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, size, crc, link) of each document; rows with equal texts have equal links."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    data = text.cast("binary")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        (F.octet_length(data).cast("long") + 8).alias("size"),
        F.crc32(data).alias("crc"),
        F.xxhash64(data, F.octet_length(data)).alias("link"),
    )


def place_heavy(heavy: DataFrame, shards: int, share: float) -> DataFrame:
    """(row, shard) of the few heavy documents: by falling size each to the emptiest shard, copies to that of the copy
    before where its share allows. One fold over an array of shards * HEAVY items at most."""
    items = heavy.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "link", "row"))).alias("items"))

    def step(done, x):
        with_copy = (x["link"] == done["link"]) & (F.get(done["loads"], done["at"]) - x["less"] <= share)
        at = F.when(with_copy, done["at"]).otherwise((F.array_position(done["loads"], F.array_min(done["loads"])) - 1).cast("int"))
        loads = F.transform(done["loads"], lambda v, k: v - F.when(k == at, x["less"]).otherwise(F.lit(0).cast("long")))
        return F.struct(loads.alias("loads"), F.concat(done["picks"], F.array(at)).alias("picks"), x["link"].alias("link"), at.alias("at"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("picks"), F.lit(None).cast("long").alias("link"), F.lit(0).alias("at"))
    picked = items.select("items", F.aggregate("items", start, step)["picks"].alias("picks"))
    return picked.select(F.inline(F.arrays_zip(F.col("items.row").alias("row"), F.col("picks").alias("shard"))))


def fractions(loads: list[float], share: float, flow: dict[tuple[int, int], float]) -> list[float]:
    """The part of the movers towards each shard that it can let in: the largest ones for which no shard ends up over
    its share, or over its load if that is more, counting what leaves. flow: bytes by (from, to)."""
    shards = range(len(loads))
    wanted = [sum(v for (_, t), v in flow.items() if t == s) for s in shards]
    part = [1.0] * len(loads)
    for _ in range(200):
        leaving = [sum(v * part[t] for (f, t), v in flow.items() if f == s) for s in shards]
        part = [min(part[s], max(0.0, share - loads[s] + leaving[s]) / wanted[s]) if wanted[s] else part[s] for s in shards]
    return part


def propagate(linked: DataFrame, shards: int, share: float, fixed: list[float], rounds: int = ROUNDS) -> DataFrame:
    """linked (row, link, size, total, unit, shard, ...) with the shards to which propagation has moved the rows.

    In each round a link's documents that aren't in the shards where most of its bytes are (one; as many as it fills,
    if it is larger than a shard's share) move there. Of a link's shards only those with room are asked, but in the
    first rounds, when others leave as many. What a shard lets in is bounded by its share, less its fixed bytes; movers are let
    in by a hash of their unit, so that those of one link are let in together. A round is a count by (link, shard), pre-aggregated, and
    a join of the rows to it by link, which Spark splits where a link is hot.
    """
    stage, shard = None, F.col("shard")
    bytes_ = None
    for round_ in range(rounds):
        sums = {r.shard: r.n for r in linked.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        bytes_ = bytes_ or sum(sums.values())
        if not bytes_:
            return linked
        loads = [fixed[s] + sums.get(s, 0) for s in range(shards)]
        room = [round_ < 3 or loads[s] < 0.998 * share for s in range(shards)]
        held = linked.groupBy("link", "shard").agg(F.sum("size").alias("held"), F.first("total").alias("total"))
        order = F.array_sort(F.collect_list(F.struct((-F.col("held")).alias("less"), F.xxhash64("link", "shard").alias("tie"), "shard")))
        by_link = held.groupBy("link").agg(order.alias("order"), F.first("total").alias("total"))  # shards entries at most
        spread = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(share))).cast("int")
        where = F.transform("order", lambda x: x["shard"])
        enterable = F.filter(where, lambda s: F.get(F.array(*map(F.lit, room)), s))
        by_link = by_link.select(F.col("link").alias("of"), where.alias("where"), F.slice(where, 1, spread).alias("homes"), F.slice(enterable, 1, spread).alias("doors"))
        both = linked.join(by_link, F.col("link") == F.col("of"))
        door = F.get("doors", F.pmod(F.xxhash64("unit", F.lit(round_)), F.greatest(F.size("doors"), F.lit(1))).cast("int"))
        better = F.array_position("where", door) < F.array_position("where", F.col("shard"))
        to = F.when(~F.array_contains("homes", F.col("shard")) & better, door)
        step = F.floor(_unit(F.col("unit"), 100 + round_) * STEPS).cast("int")
        moving = materialize(both.select(*linked.columns, to.alias("to"), step.alias("step")))
        if stage is not None:
            drop(stage)
        stage = moving
        flow, wanted = {}, {}
        for r in moving.filter("to is not null").groupBy("shard", "to", F.col("step")).agg(F.sum("size").alias("n")).groupBy("to", "step").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("n")).collect():
            wanted.setdefault(r.to, {})[r.step] = sum(r.n.values())
            for f, n in r.n.items():
                flow[f, r.to] = flow.get((f, r.to), 0) + n
        part, until, moved = fractions(loads, share, flow), [0] * shards, 0
        for t, steps in wanted.items():
            quota, total = part[t] * sum(steps.values()) + 0.5, 0
            for k in range(STEPS):
                if total + steps.get(k, 0) > quota:
                    break
                total += steps.get(k, 0)
                until[t] = k + 1
            moved += total
        let_in = F.col("step") < F.get(F.array(*map(F.lit, until)), F.col("to"))
        shard = F.when(F.col("to").isNotNull() & let_in, F.col("to")).otherwise(F.col("shard"))
        linked = moving.select(*[shard.alias("shard") if c == "shard" else c for c in linked.columns])
        if moved < SETTLED * bytes_:
            break
    return linked


def fill(pool: DataFrame, missing: list[float], buckets: int) -> DataFrame:
    """pool (row, unit, size, ...) with the shards that it fills up: rows line up by unit, and a shard takes the stretch
    of the line that it misses. The line's sums are taken by bucket first."""
    bucket = F.floor(_unit(F.col("unit"), 7) * buckets).cast("int")
    pool = pool.withColumn("bucket", bucket)
    sums = pool.groupBy("bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")  # a row for each bucket
    offsets = sums.select(F.col("bucket").alias("in"), before.alias("offset"), F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("whole"))
    inside = F.sum("size").over(W.partitionBy("bucket").orderBy("unit", "row").rowsBetween(W.unboundedPreceding, W.currentRow))
    at = (F.col("offset") + F.col("inside") - F.col("size") / 2) / F.col("whole") * F.lit(sum(missing))
    placed = pool.withColumn("inside", inside).join(F.broadcast(offsets), F.col("bucket") == F.col("in"))
    return placed.withColumn("shard", _below(_running(missing)[:-1], at))


def slotted(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with slot: their place in their shard, gapless from 0, counted by bucket first."""
    rows = rows.withColumn("bucket", F.floor(_unit(F.col("row"), 11) * buckets).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    offsets = counts.select(F.col("shard").alias("of"), F.col("bucket").alias("in"), before.alias("offset"))
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("row")) - 1
    return rows.withColumn("place", place).join(F.broadcast(offsets), (F.col("shard") == F.col("of")) & (F.col("bucket") == F.col("in"))).withColumn("slot", F.col("offset") + F.col("place"))


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each document, in shards of nearly equal bytes in which
    equal texts stand together.

    size: UTF-8 bytes of the text plus 8; text_crc32: of these bytes; slot: place in the shard, gapless from 0. The law
    is `bytes`: each shard gets its share of all sizes, but for documents at its edges, none of which is over 1 / 64 of a share if
    there are enough lighter ones. grown_shard is null, as this law has none.

    1. Documents heavier than 1 / 64 of a share, a bounded number, are placed by size.
    2. Lighter ones whose text others have start in hashed shards and move to their copies by propagate().
    3. What is above a shard's share goes to the pool of documents without copies, which fills the shards up.

    Null texts count as empty and are linked with empty ones. Every row is a document: repeated ids and rows have
    their own slots, null ids too. A text whose copies are more than a shard's share is spread over as many shards as it
    fills. Fewer documents than shards leave shards empty. Empty table: no rows. Other columns are ignored. The
    same files read by the same number of partitions give the same shards.

    Texts are read once; only numbers are shuffled. Windows run over buckets of some BUCKET_ROWS rows; what is
    broadcast or collected is counts by shard, bucket or step, never by document (but for the heavy ones).
    """
    base = materialize(numbered(docs, id_col, text_col))
    every = base.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    n, share = every.n, (every.size or 0) / shards
    buckets = min(1 << 16, max(512, n // BUCKET_ROWS))
    heavy = F.col("size") > F.lit(share / HEAVY)
    of_heavy = place_heavy(base.filter(heavy), shards, share)
    placed = materialize(base.filter(heavy).join(F.broadcast(of_heavy.withColumnRenamed("row", "heavy_row")), F.col("row") == F.col("heavy_row")).select("row", "id", "size", "crc", "shard"))
    sums = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    fixed = [float(sums.get(s, 0)) for s in range(shards)]
    room = [max(0.0, share - x) for x in fixed]
    ends = [x / (sum(room) or 1) for x in _running(room)][:-1]

    copies = base.filter(~heavy).groupBy(F.col("link").alias("of")).agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1")
    unit = F.when(F.col("n") <= WHOLE, F.col("link")).otherwise(F.xxhash64("row"))
    light = materialize(base.filter(~heavy).join(copies, F.col("link") == F.col("of"), "left").select("row", "id", "size", "crc", "link", "total", F.coalesce(unit, F.xxhash64("row")).alias("unit"), _below(ends, _unit(F.col("row"), 3)).alias("shard")))
    drop(base)
    linked = propagate(light.filter("total is not null"), shards, share, fixed, rounds)
    sums = {r.shard: r.n for r in linked.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    excess = [max(0.0, fixed[s] + sums.get(s, 0) - share) / max(1, sums.get(s, 0)) for s in range(shards)]
    leaves = _unit(F.col("unit"), 5) < F.get(F.array(*[F.lit(float(x)) for x in excess]), F.col("shard"))
    columns = ["row", "id", "size", "crc", "shard"]
    stays = linked.filter(~leaves)
    sums = {r.shard: r.n for r in stays.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    missing = [max(0.0, share - fixed[s] - sums.get(s, 0)) for s in range(shards)]
    pool = light.filter("total is null").select("row", "unit", *columns[1:4]).union(linked.filter(leaves).select("row", "unit", *columns[1:4]))
    rows = placed.union(stays.select(columns)).union(fill(pool, missing, buckets).select(columns))
    out = slotted(materialize(rows), max(32, buckets // 16))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return shard_documents(table(spark, sf_dir, "documents"))
