"""Embedding near-dedup by E8 lattice hashing."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import drop, materialize, table
from meridian.llm.components import components

#: Production parameters. With them a pair at cosine 0.9 shares a probed cell in about two tables of three, and meets
#: surer the closer it is; tests measure recall against brute force.
TABLES, PROBES, CELL = 8, 8, 0.5
#: Sign sketches prune what meets by chance: bits, and differing bits up to which a pair is verified. At cosine
#: 0.9 about 18 of 128 bits differ, with a standard deviation of 4.
SKETCH_BITS, SKETCH_DIFFER = 128, 42


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    rows = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            rows.append(v)
    rows += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(rows)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even coordinate sum: round, and if odd re-round the worst coordinate."""
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 = D8 and D8 + 1/2."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cell_ids(points: np.ndarray, t: int) -> np.ndarray:
    """64-bit ids of lattice points (last axis) in table t."""
    weights = np.random.default_rng(97).integers(1, 2**63, 8, dtype=np.int64) | 1
    h = ((2 * points).astype(np.int64) * weights).sum(axis=-1) + np.array((t + 1) * 0x5851F42D4C957F2D % 2**63, np.int64)
    h = (h ^ (h >> np.int64(29))) * np.int64(0x1B03738712FAD5C9)
    return h ^ (h >> np.int64(32))


class Hasher:
    def __init__(self, dims: int, tables: int, probes: int, cell: float, seed: int = 41) -> None:
        r = np.random.default_rng(seed)
        projections = r.normal(size=(tables, dims, 8))
        if dims >= 8:  # orthonormal columns keep cells even
            projections = np.stack([np.linalg.qr(p)[0] * np.sqrt(dims) for p in projections])
        self.projections = projections / np.sqrt(8.0) / cell
        self.signs = r.normal(size=(dims, SKETCH_BITS))
        self.probes, self.near = probes, shortest()

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cells, probed cells with the home ones, sketches) of unit vectors."""
        homes, probed = [], []
        for t, p in enumerate(self.projections):
            y = x @ p
            home = nearest_e8(y)
            order = np.argsort(-((y - home) @ self.near.T), axis=1, kind="stable")[:, : self.probes]
            homes.append(cell_ids(home, t)[:, None])
            probed += [homes[-1], cell_ids(home[:, None, :] + self.near[order], t)]
        bits = np.packbits(x @ self.signs > 0, axis=1)
        return np.concatenate(homes, axis=1), np.concatenate(probed, axis=1), np.ascontiguousarray(bits).view(">i8").astype(np.int64)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors in double precision; None: null, empty, zero, or with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = None if not v or None in v else np.array(v, dtype=np.float64)
        if x is not None:
            with np.errstate(over="ignore"):
                size = np.abs(x).max() if np.isfinite(x).all() else 0.0
                x = x / size if size else None  # by the largest component first: no overflow
        out.append(x / np.linalg.norm(x) if x is not None else None)
    return out


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], kind))


def _verified(pairs: DataFrame, units: DataFrame, at_least: float) -> DataFrame:
    """Of pairs (a, b), those of cosine at_least or more, in double precision; of unequal lengths none."""

    def verify(batches):
        for batch in batches:
            a, b, u, v = (batch.column(k) for k in range(4))
            keep = np.zeros(len(a), dtype=bool)
            nu, nv = np.diff(u.offsets.to_numpy()), np.diff(v.offsets.to_numpy())
            fu, fv = u.values.to_numpy(), v.values.to_numpy()
            su, sv = u.offsets.to_numpy(), v.offsets.to_numpy()
            for n in np.unique(nu[nu == nv]):
                rows = np.flatnonzero((nu == n) & (nv == n))
                x, y = fu[su[rows][:, None] + np.arange(n)], fv[sv[rows][:, None] + np.arange(n)]
                keep[rows] = np.einsum("ij,ij->i", x, y) >= at_least
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    left, right = units.select(F.col("id").alias("a"), F.col("unit").alias("ua")), units.select(F.col("id").alias("b"), F.col("unit").alias("ub"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub").mapInArrow(verify, "a long, b long")


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.9,
    tables: int = TABLES,
    probes: int = PROBES,
    cell: float = CELL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) of each vector: links found at cosine or above, their components.

    Each table projects unit vectors to 8 dimensions and decodes them to a point of E8, their home cell; the
    probed cells are the home cell and the lattice neighbours nearest to the vector. A pair meets where the one's
    home cell is probed by the other.

    1. In each home cell every vector is compared with the cell's smallest id. The smallest of those within half
       the angle of the threshold becomes its leader: vectors of one leader all link, by the triangle inequality,
       so a group of copies is counted without its pairs.
    2. Pairs of different leaders that meet, and whose sign sketches don't rule them out, are verified in double
       precision.

    Equal vectors are one class, hashed and compared once and counted as often as they stand. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, as do those of unequal lengths. One row per
    given row: rows that repeat an id, or have none, are vectors of their own; component_id is the smallest id of the
    component that isn't null, and a row without id is kept only where its component has none. (Components without
    ids go by stand-ins above 2^62 inside; ids are expected below that.) Empty table: no rows. Other columns are
    ignored.
    """
    half = float(np.sqrt((1 + cosine) / 2)) + 1e-9
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def unit_batches(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                units = _vectors(some.column(1))
                keys = [xxhash.xxh3_128_digest(u.tobytes()) if u is not None else bytes(16) for u in units]
                k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                usable = np.array([u is not None for u in units])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(k[:, 0], mask=~usable), pa.array(k[:, 1], mask=~usable), pa.array([None if u is None else u.tolist() for u in units], pa.list_(pa.float64()))],
                    names=["id", "k1", "k2", "unit"],
                )

    def hash_batches(batches):
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            ids, sizes = batch.column(0), np.diff(batch.column(1).offsets.to_numpy())
            flat, starts = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                hasher = hashers.setdefault(n, Hasher(n, tables, probes, cell))
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    homes, probed, sketch = hasher(flat[starts[some][:, None] + np.arange(n)])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), _lists(list(homes), pa.int64()), _lists(list(probed), pa.int64()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], names=["id", "homes", "probed", "s1", "s2"])

    rows = materialize(given.mapInArrow(unit_batches, "id long, k1 long, k2 long, unit array<double>"))
    stand_in = F.lit((1 << 63) - 1) - F.shiftrightunsigned("k1", 2)
    classes = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("members"), F.first("unit").alias("unit"))
    # an id that repeats may be the least of two classes: the second one and those after it get stand-ins too
    turn = F.row_number().over(Window.partitionBy("least").orderBy("k1", "k2"))
    ranked = classes.filter("least is not null").withColumn("turn", turn)
    own = classes.filter("least is null").withColumn("turn", F.lit(2)).unionByName(ranked).withColumn("id", F.when(F.col("turn") == 1, F.col("least")).otherwise(stand_in))
    classes = materialize(own.select("id", "least", "k1", "k2", "members", "unit"))
    units = classes.select("id", "unit")
    hashed = materialize(units.mapInArrow(hash_batches, "id long, homes array<long>, probed array<long>, s1 long, s2 long"))
    homes = hashed.select("id", F.explode("homes").alias("cell"))
    first = materialize(homes.groupBy("cell").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("cell", "b"))
    near = homes.join(first, "cell").filter("b < id").select(F.col("id").alias("a"), "b").distinct()
    leaders = _verified(near, units, half).groupBy("a").agg(F.min("b").alias("leader"))
    found = hashed.join(leaders, F.col("id") == F.col("a"), "left").select("id", "homes", "probed", "s1", "s2", F.coalesce("leader", "id").alias("leader"))
    led = materialize(found.join(classes.select(F.col("id").alias("of"), "members"), F.col("id") == F.col("of")).drop("of"))
    own = materialize(led.groupBy("leader").agg(F.count("*").alias("led"), F.sum("members").alias("inside"), F.min("id").alias("smallest"))).withColumnRenamed("leader", "of")

    # alone: nothing else has its leader. Of others, cells only pair members of different leaders, by pairs of leaders.
    sized = led.join(own.select("of", "led"), F.col("leader") == F.col("of")).select("id", "leader", "s1", "s2", "homes", "probed", (F.col("led") == 1).alias("alone"))
    x, y = (sized.select("id", "leader", "s1", "s2", "alone", F.explode(c).alias("cell")) for c in ("homes", "probed"))
    alike = f"bit_count(x.s1 ^ y.s1) + bit_count(x.s2 ^ y.s2) <= {SKETCH_DIFFER}"
    pair = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    meets = x.filter("alone").alias("x").join(y.alias("y"), F.expr(f"x.cell = y.cell and x.id <> y.id and {alike}")).select(*pair)
    meets = meets.union(x.filter("not alone").alias("x").join(y.filter("alone").alias("y"), F.expr(f"x.cell = y.cell and {alike}")).select(*pair))
    bundled_x, bundled_y = x.filter("not alone"), y.filter("not alone")
    leader_pairs = bundled_x.groupBy("cell", "leader").count().alias("l").join(bundled_y.groupBy("cell", "leader").count().alias("r"), F.expr("l.cell = r.cell and l.leader <> r.leader"))
    leader_pairs = leader_pairs.select(F.col("l.cell").alias("at"), F.col("l.leader").alias("one"), F.col("r.leader").alias("two"))
    across = bundled_x.alias("x").join(leader_pairs, F.expr("x.cell = at and x.leader = one")).join(bundled_y.alias("y"), F.expr(f"y.cell = at and y.leader = two and {alike}"))
    meets = meets.union(across.select(*pair)).distinct()
    links = materialize(_verified(meets, units, cosine))
    drop(hashed, first)

    weight = classes.select(F.col("id").alias("w"), "members")
    both = links.union(links.select("b", "a")).toDF("id", "other")
    across = both.join(weight, F.col("other") == F.col("w")).groupBy("id").agg(F.sum("members").alias("across"))
    counts = led.select("id", "leader").join(own, F.col("leader") == F.col("of")).join(across, "id", "left").select(F.col("id").alias("counted"), (F.col("inside") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
    # members of a leader link with each other even where the leader follows another one: tie them to their smallest
    ties = led.select("id", "leader").join(own, F.col("leader") == F.col("of")).select(F.col("id").alias("a"), F.col("smallest").alias("b"))
    groups = components(links.union(ties))
    named = classes.select("id", "least", "k1", "k2").join(groups, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    # the smallest id of any row of a component: an id that repeats may have been given away to another class
    names = named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("name"))
    judged = named.join(names, F.col("component") == F.col("c")).join(counts, F.col("id") == F.col("counted")).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "name", "n_links")
    judged = materialize(judged)
    drop(classes, led, own, links, groups)
    component = F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("name"))
    return (
        rows.select("id", "k1", "k2")
        .join(judged, F.expr("k1 = c1 and k2 = c2"), "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component.eqNullSafe(F.col("id")), F.lit(False)).alias("kept"))
    )


def op10_lattice_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v
  where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
l as (select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_dot_product(x.e, y.e) >= 0.9),
r as (select vec_id as node, vec_id as root from embeddings union select l.b, r.root from r join l on l.a = r.node),
c as (select node, min(root) as root from r group by node)
select e.vec_id, (select count(*) from l where l.a = e.vec_id)::bigint as n_links, c.root as component_id, c.root = e.vec_id as kept from embeddings e join c on c.node = e.vec_id
"""
