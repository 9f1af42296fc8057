"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.llm.common import WORD, fresh, materialize, table, unit_hash


def source_targets(sizes: DataFrame, share: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """One row per source (source, source_size) -> target words.

    Sources in code-point order (null last) take the weights in turn. With cap_i = max_epochs * size_i, the
    level l of capped water-filling solves sum(min(cap_i, l * w_i)) = share * sum(size_i). That sum is concave in
    l, so l is the largest of the solutions of its linear pieces, taken in the order cap_i / w_i. A source of no
    words gets a target of 0. All sources capped (share >= max_epochs): targets are the caps.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_code_point = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    turn = F.array(*map(F.lit, map(float, weights)))
    return (
        sizes.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(by_code_point) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("piece", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.max("piece").over(everything))
        .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def mix(
    docs: DataFrame,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = (3, 1, 2),
    seed: int = 17,
    fraction: str = "words",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix repeats each document.

    A document of a source whose target is r times its size is repeated floor(r) times whole, and for the rest of
    r fractionally: fraction="words" takes that part of its words (rounded up or down by a seeded hash of its id),
    fraction="documents" takes the whole document once more with that probability (by the same hash). Reruns and
    other partitionings give the same rows.

    Returns id, source, size, source_size, target, copies (whole repetitions), part (words of the fractional one),
    taken = copies * size + part. Null text: size 0, nothing taken. Null source: a source of its own. Repeated
    rows: each is a document. Empty table: no rows. Other columns are ignored.

    Scale: one narrow pass counts words; the totals are pre-aggregated by source before their shuffle; the join
    back to documents carries (id, source, size) only, and Spark broadcasts the sources only if their measured
    size is under spark.sql.autoBroadcastJoinThreshold, otherwise it splits hot sources (skew join).
    """
    sized = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, max_epochs, weights)
    targets = targets.withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rest = F.col("rate") - F.floor("rate")
    if fraction == "words":
        copies, part = F.floor("rate"), F.least(F.floor(rest * F.col("size") + F.col("u")), F.col("size"))
    elif fraction == "documents":
        copies, part = F.floor("rate") + F.when(F.col("u") < rest, 1).otherwise(0), F.lit(0)
    else:
        raise ValueError(f"fraction: {fraction}")
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rate", rate)
        .withColumn("u", unit_hash(F.col("id"), seed))
        .withColumn("copies", copies.cast("long"))
        .withColumn("part", part.cast("long"))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))
    )


def mixed_documents(
    docs: DataFrame,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = (3, 1, 2),
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: docs' rows and columns, each row as often as mix(fraction="documents") repeats it.

    Texts don't move: the sources' targets, written as a table first, are broadcast if that is small. Null sources
    are a source of their own, null texts of size 0; null ids draw alike; an empty table gives no rows.
    """
    sized = docs.select(F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, max_epochs, weights)
    source, rate, copy = fresh(docs, "of_source"), fresh(docs, "rate"), fresh(docs, "copy")
    targets = materialize(targets.select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate)))
    joined = docs.join(targets, docs[source_col].cast("string").eqNullSafe(F.col(source)))
    again = F.when(unit_hash(docs[id_col], seed) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    copies = (F.floor(rate) + again).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*[joined[c] for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3e0 when 1 then 1e0 else 2e0 end as weight,
  source_size * 2e0 as cap, (sum(source_size) over ())::bigint * 1.5e0 as budget from s),
p as (select *, (budget - coalesce(sum(cap) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0e0))
  / sum(weight) over (order by cap / weight, source asc nulls last rows between current row and unbounded following) as piece from w),
t as (select source, source_size, least(cap, max(piece) over () * weight) as target from p),
r as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0e0 end as rate,
  ('0x' || substr(md5(coalesce(d.doc_id::varchar, '') || ':17'), 1, 13))::bigint / 4503599627370496e0 as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (floor(rate)::bigint * size + least(floor((rate - floor(rate)) * size + u)::bigint, size))::bigint as taken from r
"""
