"""Segmented scans: what a row needs of the rows before it, without a task that sorts all rows of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers of order that make a slice: what one task sorts of a key.
SLICE = 1 << 20

Step = Callable[[Column, Column], Column]


def scan(
    df: DataFrame,
    by: tuple[str, ...],
    order: str,
    befores: dict[str, Column],
    total: tuple[str, str, Step] | None = None,
    held: tuple[str, str, Step] | None = None,
    whole: str | None = None,
    size: int = SLICE,
    costly: bool = False,
) -> DataFrame:
    """Adds what is carried along each key's rows, in the order of a number that is unique within the key.

    befores: name -> value. The column holds the last value that isn't null of the rows before this one.
    total: (name, one of befores, step). The column sums step(value, value before) over the rows so far whose value isn't
    null, this one included; for the first of them the value before is null.
    held: (name, one of befores, mark). The column holds the value that stood before the last row so far, this one
    included, whose mark(value, value before) is true.
    whole: a column with the total at the key's end.
    costly: rows are dear to make. Both sides of the join then read one shuffle of whole rows, so that rows are made once;
    otherwise each side makes them, the one that sums up with the few columns that it needs.

    These are associative: a key is cut into slices of size numbers of order, each is summed up in one row (first and last
    value, inner total, last value held), and what comes before a slice is told from these rows. So the rows are shuffled
    once, by key and slice; tables of one row for each key and slice are what is sorted by key. Null keys are a key.
    """
    w = W.partitionBy("__scan_by", "__scan_slice").orderBy(order)
    until, earlier = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    boxed = lambda c: F.when(c.isNotNull(), F.struct(c.alias("v")))  # noqa: E731  a value of any type, null where there is none
    names = {name: f"__scan_v{k}" for k, name in enumerate(befores)}
    place = {"__scan_by": F.struct(*by), "__scan_slice": F.coalesce(F.floor(F.col(order) / size), F.lit(-1 << 62))}
    if costly:  # one column, so that what is unused on one side isn't left out there and the shuffles are the same
        rows = df.select(*[c.alias(n) for n, c in place.items()], F.array(F.struct(*df.columns)).alias("__scan_row")).repartition("__scan_by", "__scan_slice")
        rows = rows.select("__scan_by", "__scan_slice", *[F.element_at("__scan_row", 1)[c].alias(c) for c in df.columns])
    else:
        rows = df.withColumns(place)
    rows = rows.withColumns({names[n]: boxed(c) for n, c in befores.items()})
    rows = rows.withColumns({f"{v}_b": F.last(v, ignorenulls=True).over(earlier) for v in names.values()})
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    ends = {f"{v}_end": F.max_by(v, at(v)) for v in names.values()}
    inner = {}
    for kind, spec in (("t", total), ("h", held)):
        if spec:
            v, b = names[spec[1]], f"{names[spec[1]]}_b"
            ends[f"{v}_first"] = F.min_by(v, at(v))
            known = F.col(v).isNotNull() & F.col(b).isNotNull()
            said = spec[2](F.col(f"{v}.v"), F.col(f"{b}.v"))
            inner[f"__scan_{kind}"] = F.when(known, said).otherwise(0).cast("long") if kind == "t" else F.when(known & said, F.col(b))
    rows = rows.withColumns(inner)
    if total:
        ends["__scan_t_sum"] = F.sum("__scan_t")
    if held:
        ends["__scan_h_end"] = F.max_by("__scan_h", at("__scan_h"))

    of_key = W.partitionBy("__scan_by").orderBy("__scan_slice")
    before = of_key.rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("__scan_by", "__scan_slice").agg(*[c.alias(n) for n, c in ends.items()])
    sums = sums.withColumns({f"{v}_last": F.last(f"{v}_end", ignorenulls=True).over(before) for v in names.values()})
    kept = [f"{v}_last" for v in names.values()]
    if total:
        v = names[total[1]]
        first, last = F.col(f"{v}_first"), F.col(f"{v}_last")
        sums = sums.withColumn("__scan_t_opens", F.when(first.isNotNull(), F.coalesce(total[2](first["v"], last["v"]).cast("long"), F.lit(0))).otherwise(0))
        added = F.col("__scan_t_sum") + F.col("__scan_t_opens")
        sums = sums.withColumns({"__scan_t_begun": F.coalesce(F.sum(added).over(before), F.lit(0)), "__scan_t_all": F.sum(added).over(W.partitionBy("__scan_by"))})
        kept += ["__scan_t_opens", "__scan_t_begun", "__scan_t_all"]
    if held:
        v = names[held[1]]
        first, last = F.col(f"{v}_first"), F.col(f"{v}_last")
        sums = sums.withColumn("__scan_h_opens", F.when(first.isNotNull() & held[2](first["v"], last["v"]), last))
        sums = sums.withColumn("__scan_h_before", F.last(F.coalesce("__scan_h_end", "__scan_h_opens"), ignorenulls=True).over(before))
        kept += ["__scan_h_opens", "__scan_h_before"]
    out = rows.join(sums.select("__scan_by", "__scan_slice", *kept), ["__scan_by", "__scan_slice"])
    new = {n: F.coalesce(f"{v}_b", f"{v}_last")["v"] for n, v in names.items()}
    if total:
        v = names[total[1]]
        here = F.when(F.col(v).isNull(), 0).when(F.col(f"{v}_b").isNull(), F.col("__scan_t_opens")).otherwise(F.col("__scan_t"))
        new[total[0]] = F.col("__scan_t_begun") + F.sum(here).over(until)
        if whole:
            new[whole] = F.col("__scan_t_all")
    if held:
        v = names[held[1]]
        opened = F.when(F.coalesce(v, f"{v}_b").isNotNull(), F.col("__scan_h_opens"))
        new[held[0]] = F.coalesce(F.last("__scan_h", ignorenulls=True).over(until), opened, F.col("__scan_h_before"))["v"]
    return out.select(*df.columns, *[c.alias(n) for n, c in new.items()])
