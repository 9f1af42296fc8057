"""Quality classifier: nearest-neighbour voting on latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_bytes, table
from meridian.llm.words import word_hashes

#: Terms: hashed byte trigrams, trigrams of character classes, and distances at which words recur.
TRIGRAMS, SHAPES, REPEATS = 2048, 512, 16
BLOCKS = ((0, TRIGRAMS, 1.0), (TRIGRAMS, TRIGRAMS + SHAPES, 1.0), (TRIGRAMS + SHAPES, TRIGRAMS + SHAPES + REPEATS, 0.7))
TERMS = TRIGRAMS + SHAPES + REPEATS
#: Labelled documents the classifier is fitted on at most, latent dimensions, and neighbours that vote.
LABELLED, DIMENSIONS, NEIGHBOURS = 5000, 48, 15
#: Bytes of text turned into terms at a time.
GROUP = 1 << 19

_CLASS = np.full(256, 7, np.int64)  # 7: bytes of non-ASCII letters
for _chars, _class in ((b" \t\r\x0b\x0c", 0), (b"\n", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), (b"0123456789", 4), (b".,;:?'\"()-", 5), (b"!#$%&*+/<=>@[\\]^_`{|}~", 6)):
    _CLASS[list(_chars)] = _class


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of all terms of each whole text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP):
            size += len(texts[end])
            end += 1
        some = texts[at:end]
        for piece in range(0, max(1, size if end - at == 1 else 1), GROUP):  # a longer text alone, piece by piece
            parts = [t[piece : piece + GROUP + 2] for t in some] if end - at == 1 else some
            data = np.frombuffer(b"".join(parts), np.uint8)
            of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            if len(data) < 3:
                continue
            inside = of[:-2] == of[2:]
            row = of[:-2][inside]
            x = data.astype(np.int64)
            code = ((x[:-2] * 961 + x[1:-1] * 31 + x[2:]) * 40503 >> 4) % TRIGRAMS
            c = _CLASS[data]
            shape = c[:-2] * 64 + c[1:-1] * 8 + c[2:]
            for codes, start, width in ((code, 0, TRIGRAMS), (shape, TRIGRAMS, SHAPES)):
                out[at:end, start : start + width] += np.bincount(row * width + codes[inside], minlength=len(parts) * width).reshape(len(parts), width)
        for k, h in enumerate(word_hashes(some)):
            n = len(h)
            repeats = out[at + k, TRIGRAMS + SHAPES :]
            for d in range(1, 6):
                repeats[d - 1] = (h[d:] == h[:-d]).sum() if n > d else 0
            if n:
                distinct = len(np.unique(h)) / n
                repeats[5 + min(9, int(10 * distinct))] = n
                repeats[15] = n
        at = end
    return out


def rounded(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the counts as they are kept for fitting: in half precision, which holds them at any length."""
    return np.log1p(counts).astype(np.float16).astype(np.float32)


def weighted(logs: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log-scaled counts times idf, each block of terms at its share of the vector's length."""
    x = logs * idf
    for a, b, share in BLOCKS:
        x[:, a:b] *= share / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


class Voters:
    """Labelled documents in the latent space, with what takes other documents there."""

    def __init__(self, logs: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, seed: int = 3) -> None:
        self.idf = (np.log((1 + len(logs)) / (1 + (logs > 0).sum(axis=0))) + 1).astype(np.float32)
        x = weighted(logs, self.idf)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        q = np.random.default_rng(seed).normal(size=(x.shape[1], min(dimensions + 10, *x.shape))).astype(np.float32)
        for _ in range(4):  # randomized subspace iteration
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = (q @ v.T)[:, :dimensions].astype(np.float32)
        self.labels, self.prior, self.neighbours = labels.astype(np.float32), float(labels.mean()), neighbours
        self.vectors = self._unit(x)

    def _unit(self, centred: np.ndarray) -> np.ndarray:
        z = centred @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, texts: list[bytes]) -> np.ndarray:
        z = self._unit(weighted(rounded(term_counts(texts)), self.idf) - self.mean)
        out = np.empty(len(z))
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(z), 256):  # exact cosines with every labelled vector, block by block
            cosines = z[i : i + 256] @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** 4 + 1e-6
            out[i : i + 256] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Voters | None:
    """Voters from the limit labelled documents of the lowest id hashes; terms are counted on the executors.

    Labels that are null don't count; of an id with several labels the least counts. None without labels.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(limit)  # bounds what is broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(chosen.withColumnRenamed(id_col, "of")), F.col("id") == F.col("of")).select("id", "text", "label")

    def count(batches):
        for batch in batches:
            for part in by_bytes(batch):
                c = term_counts([t.encode("utf-8", "replace") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in np.log1p(c).astype(np.float16)], pa.binary()), part.column(2).cast(pa.int32())], names=["id", "counts", "label"])

    # of an id that repeats one row stays, the one of the least counts: the limit bounds rows too
    counted = rows.mapInArrow(count, f"id {docs.schema[id_col].dataType.simpleString()}, counts binary, label int")
    found = counted.groupBy("id").agg(F.min("counts").alias("counts"), F.first("label").alias("label")).toArrow().sort_by([("id", "ascending")])
    if not found.num_rows:
        return None
    counts = np.frombuffer(b"".join(found["counts"].to_pylist()), np.float16).reshape(found.num_rows, TERMS).astype(np.float32)
    return Voters(counts, found["label"].to_numpy())


def score_quality(docs: DataFrame, voters: Voters | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each whole text; score is the weighted share of label 1 among its neighbours.

    Null text counts as empty, which has a vector too; without labelled documents every score is 0.5. Ties among
    neighbours are broken by position. Repeated rows are scored each, other columns ignored, empty tables give no
    rows. A narrow job: the labelled vectors, bounded by LABELLED, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        voters = shared.value
        for batch in batches:
            for part in by_bytes(batch):
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                s = np.concatenate([voters.vote(texts[i : i + 512]) for i in range(0, len(texts), 512)]) if voters and texts else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def op4_quality_knn(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents by votes of the labelled ones that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    scored = score_quality(docs, fit(docs, labels.filter(~held_out)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
