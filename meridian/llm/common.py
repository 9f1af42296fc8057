"""What the operators of this subpackage share: reading tables, shared scratch space, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, which all executors share.

    Where that is unset only a local master may go on, with a folder of its own: its executor is the driver. On a
    cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "root" not in _local:
            _local["root"] = "file://" + tempfile.mkdtemp(prefix="meridian-")
        root = _local["root"]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def by_bytes(batch: pa.RecordBatch, column: int = 1, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts (that column) hold limit bytes at most, or one row: what a task turns into
    Python objects at a time. An empty batch is one slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes) or not len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
        if not len(sizes):
            break


def unit_hash(col, seed: int):
    """A double in [0, 1) from a column's text and a seed, the same in every engine that has md5."""
    digest = F.md5(F.concat(F.coalesce(col.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
