"""Exact n-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.llm.common import by_bytes, drop, fresh, materialize, table
from meridian.llm.components import components
from meridian.llm.words import shingle_hashes, word_hashes

#: Counters of the frequency sketch, whatever the input's size: 4 MB, so that its broadcast is bounded.
COUNTERS = 1 << 20
SLICE = 1 << 12
#: Largest prefix extension, and the cost of examining a candidate against that of reading a posting.
MAX_MATCHES, EXAMINE = 4, 20
#: Bits of the parity sketch that postings carry.
POSTING_BITS = 512


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set linked to it."""
    return -(-percent * n // 100)


def choose_matches(excess: np.ndarray, n: int, overlap: int) -> int:
    """Matches to require of a document, from the estimated document counts of its shingles, rarest first.

    Requiring m matches lengthens the prefix to n - overlap + m shingles. Its cost: the postings read, and
    candidates, at most a m-th of those postings, examined.
    """
    best, best_cost = 1, None
    for m in range(1, min(MAX_MATCHES, overlap) + 1):
        postings = float(excess[: n - overlap + m].sum())
        cost = postings + EXAMINE * postings / m
        if best_cost is None or cost < 0.95 * best_cost:
            best, best_cost = m, cost
    return best


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(id, sorted distinct shingle hashes) of a batch of (id, text); only A-Z are lower-cased."""
    for part in by_bytes(batch):
        texts = [(t or b"").lower() for t in part.column(1).cast(pa.binary()).to_pylist()]
        for i, words in zip(part.column(0).to_pylist(), word_hashes(texts), strict=True):
            yield i, shingle_hashes(words, width)


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Documents a shingle occurs in, summed over all that share its counter: COUNTERS numbers."""

    def count(batches):
        sums = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            for _, s in _sets(batch, width):
                np.add.at(sums, (s % np.uint64(COUNTERS)).astype(np.int64), 1)
        parts = [sums[k : k + SLICE] for k in range(0, COUNTERS, SLICE)]
        used = [k for k, p in enumerate(parts) if p.any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(used, pa.int32()), "sums": pa.array([parts[k].tobytes() for k in used], pa.binary())})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, dtype=np.uint64)
        for x in group["sums"]:
            total += np.frombuffer(x, dtype=np.uint32)
        return pd.DataFrame({"slice": [key[0]], "sums": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    parts = docs.mapInArrow(count, "slice int, sums binary").groupBy("slice").applyInPandas(add, "slice int, sums binary").collect()
    sketch = np.zeros(COUNTERS, dtype=np.uint32)
    for row in parts:
        sketch[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["sums"], dtype=np.uint32)
    return sketch


def parity(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as bytes: two bits a shingle, POSTING_BITS at least, each the parity of the shingles
    that fall on it. Bits that differ between two sets never outnumber the shingles that do."""
    bits = max(POSTING_BITS, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of size bytes that the same set has: halves are added bit by bit."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def prefixes(docs: DataFrame, sketch: np.ndarray, width: int, percent: int) -> tuple[DataFrame, Broadcast]:
    """(id, n, s1, s2, m, central, prefix, sketch, bits): set size, 128-bit signature of the set, required matches, mean
    of the logarithms of the shingles' estimated document counts (in thousandths), prefix rarest first, parity sketch,
    and that sketch folded to POSTING_BITS; with the broadcast they are made from."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def index(batches):
        counts = shared.value
        typical = int(np.median(counts))
        for batch in batches:
            rows: list[tuple] = []
            for i, s in _sets(batch, width):
                n = len(s)
                if not n:
                    rows.append((i, 0, 0, 0, 0, 0, s, b"", None))
                    continue
                overlap = least_overlap(n, percent)
                excess = np.maximum(counts[(s % np.uint64(COUNTERS)).astype(np.int64)].astype(np.int64) - typical, 1)
                rank = excess // max(4, int(2 * np.sqrt(typical)))  # two standard deviations of what else shares a counter
                order = np.lexsort((s, rank))
                m = choose_matches(excess[order], n, overlap)
                sums = np.cumsum(s, dtype=np.uint64)
                own = parity(s)
                bits = folded(own, POSTING_BITS // 8).view(np.int64)
                rows.append((i, n, sums[-1], np.bitwise_xor.reduce(s * (s | np.uint64(1))), m, int(1000 * np.log(excess).mean()), s[order[: n - overlap + m]], own.tobytes(), bits))
            if rows:
                ids, n, s1, s2, m, central, p, own, bits = zip(*rows, strict=True)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in p]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(m, pa.int32()), pa.array(central, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(p).view(np.int64))), pa.array(own, pa.binary()), pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "s1", "s2", "m", "central", "prefix", "sketch", "bits"],
                )

    return docs.mapInArrow(index, "id long, n long, s1 long, s2 long, m int, central int, prefix array<long>, sketch binary, bits array<long>"), shared


def _linked(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those that link. Parity sketches (id, n, sketch) drop almost all others; the whole sets of what
    is left, computed anew for the documents in these pairs, are intersected."""

    def whole(batches):
        for batch in batches:
            ids, sets = [], []
            for i, s in _sets(batch, width):
                ids.append(i)
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "s"])

    def alike(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            keep = np.zeros(len(a), dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                keep[k] = (100 + percent) * differ <= (100 - percent) * (na[k] + nb[k])
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    def verify(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), dtype=bool)
            for at in range(0, len(a), 256):  # a few whole sets at a time
                some = batch.slice(at, 256)
                for k, (x, y) in enumerate(zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True), at):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    sketched = pairs.join(sketches.toDF("a", "na", "ka"), "a").join(sketches.toDF("b", "nb", "kb"), "b")
    near = materialize(sketched.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(alike, "a long, b long"))
    needed = materialize(near.select(F.col("a").alias("id")).union(near.select("b")).distinct())
    sets = materialize(docs.join(needed, "id", "left_semi").select("id", "text").mapInArrow(whole, "id long, s binary"))
    out = materialize(near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long"))
    drop(near, needed, sets)
    return out


def jaccard_components(
    docs: DataFrame,
    width: int = 3,
    percent: int = 90,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id): groups of documents linked at 100 * intersection >= percent * union.

    Sets are distinct width-word shingles of the whole text (A-Z lower-cased), as 64-bit hashes; fewer words make
    one shingle. Documents without words, or of null text, have the empty set and link with nothing. Documents of
    equal sets form one class, represented by its smallest id; repeated ids are one document per text. Null ids
    are kept, as rows that link with nothing. Empty table: no rows. Other columns are ignored.

    1. A sketch of bounded size estimates in how many documents each shingle occurs, over all documents.
    2. Each class indexes a prefix of its set, rarest shingles first: n - ceil(percent * n / 100) + m of them. m is
       chosen per document by estimated candidate cost; two linked sets share at least the smaller m within their
       prefixes.
       Shingles that no other class indexes are dropped from the posting lists.
    3. Within each posting list every document meets the most central one, whose shingles are the most frequent on
       the whole: in a group of near copies, the text they come from. Per document the one with most matches is
       verified. These few links tie most groups of copies together.
    4. All pairs of one posting list that are not yet in one component, of compatible sizes and with enough
       matches, whose matches and what is left of their sets allow a link, and whose parity sketches do, are verified
       on their whole sets. Nothing is capped: after this, every link is either found or inside a component already
       found.

    Sketches prune exactly: two sets link only if at most (100 - percent) / (100 + percent) of their sizes' sum
    differs, and sketch bits never differ more often than the sets. So sets travel for pairs close to a link only.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = frequency_sketch(docs.filter("id is not null"), width)
    indexed, shared = prefixes(docs, sketch, width, percent)
    indexed = materialize(indexed)
    shared.destroy()
    rows = materialize(indexed.select("id", "n", "s1", "s2"))
    whole = indexed.filter("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("m", "central", "prefix", "sketch", "bits")))
    whole = materialize(whole.select("id", "n", "m", "central", "prefix", "sketch", "bits"))
    drop(indexed)
    in_list = W.partitionBy("shingle")
    postings = materialize(
        whole.select("id", "n", "m", "central", F.posexplode("prefix").alias("pos", "shingle")).withColumn("documents", F.count("*").over(in_list)).filter("documents > 1").drop("documents")
    )
    sketches = whole.select("id", "n", "sketch")

    # a pair's overlap is at most its matches up to the last one and what is left of the shorter rest
    bounded = f"{percent} * (nx + ny) <= {100 + percent} * (matches + least(nx - lx, ny - ly) - 1)"
    by_centre = W.partitionBy("shingle").orderBy(F.desc("central"), "id")
    other = F.struct("id", "n", "pos")
    met = (
        postings.select("id", "n", "pos", F.first(other).over(by_centre).alias("centre"), F.lag(other).over(by_centre).alias("before"))
        .withColumn("other", F.when(F.expr(f"100 * least(n, centre.n) >= {percent} * greatest(n, centre.n)"), F.col("centre")).otherwise(F.col("before")))
        .filter(F.expr(f"other.id <> id and 100 * least(n, other.n) >= {percent} * greatest(n, other.n)"))
        .groupBy("id", F.col("other.id").alias("other"))
        .agg(F.count("*").alias("matches"), F.max("pos").alias("lx"), F.max("other.pos").alias("ly"), F.first("n").alias("nx"), F.first("other.n").alias("ny"))
        .filter(bounded)
        .groupBy("id")
        .agg(F.max(F.struct("matches", -F.col("other"), "other")).alias("best"))
        .select(F.least("id", "best.other").alias("a"), F.greatest("id", "best.other").alias("b"))
        .distinct()
    )
    met = materialize(met)
    first = _linked(met, docs, sketches, width, percent)
    known = components(first)

    # Lists that hold more than one component. r: how many of the document's earlier shingles are in such lists, so
    # that at most r matches come before this one, and the document can't link where they and the rest are too few.
    in_document = W.partitionBy("id").orderBy("pos")
    lists = (
        postings.join(known, F.col("id") == F.col("node"), "left")
        .select("id", "n", "m", F.coalesce("component", "id").alias("component"), "pos", "shingle")
        .withColumns({"low": F.min("component").over(in_list), "high": F.max("component").over(in_list)})
        .filter("low < high")
        .drop("low", "high")
        .withColumn("r", F.row_number().over(in_document) - 1)
        .filter(f"pos - r <= n - ceil({float(percent)} * n / 100)")
        .join(whole.select("id", "bits"), "id")
    )
    lists = materialize(lists)
    drop(postings, met, known)
    # x is the larger one of a pair; the smaller one shares 2 * percent / (100 + percent) of its set, so that a
    # shorter prefix of it does.
    x, y = lists.alias("x"), lists.filter(f"pos < n - ceil({2.0 * percent} * n / {100 + percent}) + m").alias("y")
    ordered = "(x.n > y.n or x.n = y.n and x.id > y.id)"
    possible = f"{percent} * (x.n + y.n) <= {100 + percent} * (least(x.r, y.r) + least(x.n - x.pos, y.n - y.pos))"
    differ = " + ".join(f"bit_count(x.bits[{k}] ^ y.bits[{k}])" for k in range(POSTING_BITS // 64))
    alike = f"{100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n)"
    meets = (
        x.join(y, F.expr(f"x.shingle = y.shingle and x.component <> y.component and {ordered} and 100 * y.n >= {percent} * x.n and {possible} and {alike}"))
        .groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .agg(F.count("*").alias("matches"), F.max("x.pos").alias("lx"), F.max("y.pos").alias("ly"), F.first("x.n").alias("nx"), F.first("y.n").alias("ny"), F.first(F.least("x.m", "y.m")).alias("need"))
        .filter(f"matches >= need and {bounded}")
        .select("a", "b")
    )
    meets = materialize(meets)
    drop(lists)
    second = _linked(meets, docs, sketches, width, percent)
    drop(meets, whole)
    links = first.union(second)
    groups = components(links)

    members = rows.filter("n > 0 and id is not null").groupBy(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("cn")).agg(F.min("id").alias("class_id"))
    of_class = materialize(members.join(groups, F.col("class_id") == F.col("node"), "left").select("c1", "c2", "cn", F.coalesce("component", "class_id").alias("component")))
    drop(first, second, groups)
    return rows.join(of_class, F.expr("s1 = c1 and s2 = c2 and n = cn and id is not null"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that represent their component: the smallest id. Columns stay as they are.

    A row whose id is null or repeated is identified by its id and text instead, and yields to rows of unique ids:
    of rows that repeat id and text one stays; rows of one id and different texts are judged each. (Those stand-ins
    are ids above 2^62; ids are expected below that.) Documents without words all stay, except such repeated rows.
    Empty table: no rows.

    The ids that go are written as a table first: Spark broadcasts them only if that table is small.
    """
    key, other = fresh(docs, "key"), fresh(docs, "other")
    repeated = materialize(docs.select(F.col(id_col).cast("long").alias(other)).groupBy(other).count().filter(f"`count` > 1 or `{other}` is null").select(other))
    stand_in = F.lit((1 << 63) - 1) - F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), 2)
    keyed = docs.withColumn(key, F.col(id_col).cast("long"))
    some = not repeated.isEmpty()
    if some:
        keyed = keyed.join(repeated, F.col(key).eqNullSafe(F.col(other)), "left").withColumn(key, F.when(F.col(key).isNull() | F.col(other).isNotNull(), stand_in).otherwise(F.col(key))).drop(other)
    found = jaccard_components(keyed, id_col=key, text_col=text_col, **how)
    others = materialize(found.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias(other)).distinct())
    kept = keyed.join(others, F.col(key) == F.col(other), "left_anti")
    if some:
        kept = kept.filter(F.col(key) < 1 << 62).union(kept.filter(F.col(key) >= 1 << 62).dropDuplicates([key]))
    return kept.drop(key)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """jaccard_components of all documents: three words, 90 percent."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP9_SQL = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select distinct doc_id, case when len(w) < 3 then w else w[i : i + 2] end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
f as (select g, doc_id, n from g join n using (doc_id)),
l as (select x.doc_id as a, y.doc_id as b from f x join f y on x.g = y.g and x.doc_id < y.doc_id and 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
e as (select a, b from l union all select b, a from l),
r as (select a as node, a as root from e union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as root from r group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.root, d.doc_id) as component_id
from d left join n on n.doc_id = d.doc_id left join c on c.node = d.doc_id
"""
