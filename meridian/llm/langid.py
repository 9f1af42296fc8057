"""Language identification by a byte convolutional network in numpy, trained in Spark's tasks on all labelled texts."""

from __future__ import annotations

import copy
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_bytes, table

WINDOW, WIDTHS, FILTERS = 256, (2, 4, 6), 8
#: Zero bytes after each window, so that no filter sees two windows.
PAD = max(WIDTHS)
#: The fit: windows of a group of rows, about, which one task learns from at a time; how many times as large a round is as
#: all before it; windows that a small table's are repeated up to, and how often at most.
GROUP, GROWTH, REPEATED, EPOCHS = 1 << 15, 4, 1 << 17, 4
#: Weight of a language's windows at most, where the average is 1.
MOST = 8.0
#: Share of the held-out rows that may score under what the rejection of texts is set by, and steps that scores are counted in.
BELOW, STEPS = 0.001, 1 << 16
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    if not text or not (m := _LETTER.search(text)):
        return False
    return m.group().isalpha() or any(map(str.isalpha, text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fixed-length windows of the texts, zero-padded; the text each is of; its bytes. Empty texts: one window."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    out = np.zeros((counts.sum(), WINDOW + PAD), np.uint8)
    used = np.empty(len(out), np.int64)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        data = np.zeros(n * WINDOW, np.uint8)
        data[: len(t)] = np.frombuffer(t, np.uint8)
        out[at : at + n, :WINDOW] = data.reshape(n, WINDOW)
        used[at : at + n] = WINDOW
        used[at + n - 1] = max(1, len(t) - (n - 1) * WINDOW)
        at += n
    return out, np.repeat(np.arange(len(texts)), counts), used


class ByteCNN:
    """One-hot bytes -> filters of several widths -> max pooling -> ReLU -> softmax over languages."""

    def __init__(self, languages: list[str], seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.languages = languages
        self.unsure = 0.0
        self.filters = [(r.normal(0, 0.3, (w, 256, FILTERS))).astype(np.float32) for w in WIDTHS]
        self.out = r.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pair_tables(self) -> list[list[np.ndarray]]:
        """Per width, tables by byte pair: a filter of width w is the sum of w / 2 lookups."""
        return [[(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, len(t), 2)] for t in self.filters]

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]], where: bool = False):
        codes = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        best, at = [], []
        for parts in tables:
            y = parts[0].take(codes[:, :WINDOW], axis=0)
            for k, part in enumerate(parts[1:], 1):
                y += part.take(codes[:, 2 * k : 2 * k + WINDOW], axis=0)
            if where:
                at.append(y.argmax(axis=1))
            best.append(y.max(axis=1))
        return np.concatenate(best, axis=1), at

    def logits(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        return np.maximum(self.pooled(x, tables)[0], 0) @ self.out + self.bias

    def params(self) -> list[np.ndarray]:
        return [*self.filters, self.out, self.bias]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 6, weight: np.ndarray | None = None) -> None:
        """Adam over the windows x of classes y; weight: of each class."""
        r = np.random.default_rng(seed)
        params = self.params()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        columns = np.arange(FILTERS)[None, :]
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                codes = xb.astype(np.int32)
                peaks, at = [], []
                for t in self.filters:
                    z = t[0].take(codes[:, :WINDOW], axis=0)
                    for k in range(1, len(t)):
                        z += t[k].take(codes[:, k : k + WINDOW], axis=0)
                    at.append(z.argmax(axis=1))
                    peaks.append(np.take_along_axis(z, at[-1][:, None, :], axis=1)[:, 0])
                m = np.concatenate(peaks, axis=1)
                h = np.maximum(m, 0)
                p = h @ self.out + self.bias
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                if weight is not None:
                    p *= weight[yb][:, None]
                p /= len(yb)
                back = (p @ self.out.T) * (m > 0)
                grads = []
                for j, t in enumerate(self.filters):
                    g = np.zeros_like(t)
                    part = back[:, j * FILTERS : (j + 1) * FILTERS]
                    for k in range(len(t)):
                        np.add.at(g[k], (np.take_along_axis(codes, at[j] + k, axis=1), np.broadcast_to(columns, part.shape)), part)
                    grads.append(g)
                grads += [h.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, a, b in zip(params, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def predict(self, texts: list[bytes], tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(class, probability) of each text: softmax of its windows' logits, averaged by their bytes."""
        x, of, used = windows(texts)
        z = np.concatenate([self.logits(x[i : i + 512], tables) for i in range(0, len(x), 512)]) * used[:, None]
        starts = np.searchsorted(of, np.arange(len(texts)))
        mean = np.add.reduceat(z, starts, axis=0) / np.add.reduceat(used, starts)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def rounds(rows: DataFrame, total: int, group: int) -> list[DataFrame]:
    """The rows, each in one of the rounds and of its groups, by their draw; total: their windows."""
    ends = [1.0]
    while ends[0] * total > group:
        ends.insert(0, ends[0] / GROWTH)
    place = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    dealt = []
    for low, high in zip([0.0, *ends], ends, strict=False):
        groups = max(1, round((high - low) * total / group))
        dealt.append(rows.filter((place >= low) & (place < high)).withColumn("group", F.pmod(F.shiftright("draw", 30), F.lit(groups))))
    return dealt


def train(rows: DataFrame, group: int = GROUP) -> ByteCNN | None:
    """The network of labelled (id, text, lang), fitted on all windows of every whole text with a letter; None without any.

    Rows are dealt by hash into rounds, each GROWTH - 1 times as large as all before it, and within a round into groups of
    about `group` windows. The groups of a round go on side by side from one network, each over its own rows; the
    networks that come out are averaged by their windows. So each row is learned from, in one round, once (in tables
    under REPEATED windows up to EPOCHS times), and a group, a network and the driver hold no more in larger tables.
    Averages are integer sums: the same whatever the partitions and the order of rows. Languages weigh alike, up to MOST.
    """
    rows = rows.filter(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("id", "text").alias("draw"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("n")).collect()}
    if not counts:
        return None
    model, total = ByteCNN(sorted(counts)), sum(counts.values())
    weight = np.array([min(MOST, total / len(counts) / counts[k]) for k in model.languages], np.float32)
    epochs = min(EPOCHS, max(1, REPEATED // total))
    for k, dealt in enumerate(rounds(rows, total, group)):
        learned = dealt.groupBy("group").applyInArrow(_learner(model, weight, epochs, 0.01 / (1 + k)), "at int, value long")
        sums = learned.groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at")["value"].to_numpy()
        if len(sums):  # a small table's round may have no rows
            average, at = sums[1:] / (sums[0] * _UNIT), 0
            for p in model.params():
                p[...] = average[at : at + p.size].reshape(p.shape)
                at += p.size
    return model


#: Parameters are summed in units of its inverse.
_UNIT = float(1 << 24)


def _learner(model: ByteCNN, weight: np.ndarray, epochs: int, rate: float):
    """A group's (lang, text, draw) -> its number of windows (at 0) and that many times each parameter of its network."""
    number = {k: i for i, k in enumerate(model.languages)}

    def learn(rows):
        rows = rows.sort_by([("draw", "ascending"), ("lang", "ascending")])
        x, of, used = windows([t.encode("utf-8", "replace").lower() for t in rows["text"].to_pylist()])
        y = np.array([number[k] for k in rows["lang"].to_pylist()])[of]
        whole = (used >= 16) | np.concatenate(([True], of[1:] != of[:-1]))  # no shreds at the ends of longer texts
        x, y = x[whole], y[whole]
        mine = copy.deepcopy(model)
        mine.train(x, y, epochs=epochs, rate=rate, weight=weight)
        flat = np.concatenate([[1.0], *(np.rint(p.ravel().astype(np.float64) * _UNIT) for p in mine.params())]).astype(np.int64) * len(x)
        return pa.table({"at": pa.array(np.arange(len(flat)), pa.int32()), "value": flat})

    return learn


def identify(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each whole text: all its fixed-length byte windows, in batches.

    Null text, or text without a letter: `und`, score 0; without a model, every text is. Ties go to the language
    first in code-point order. Repeated rows are each identified, other columns ignored, empty tables give no rows.
    A narrow job: no shuffle; a text is read window by window, so memory follows the batch and not the corpus.
    """
    label = labeller(model)

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                lang, score = label(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def labeller(model: ByteCNN | None):
    """texts -> (languages, scores). The network, some 100 KB, travels with the task's function."""
    tables = None

    def label(texts: list) -> tuple[list[str], list[float]]:
        nonlocal tables
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not model:
            return lang, score
        tables = tables or model.pair_tables()
        group: list[int] = []
        size = 0

        def flush():
            best, p = model.predict([texts[i].encode("utf-8", "replace").lower() for i in group], tables)
            for i, b, q in zip(group, best.tolist(), p.tolist(), strict=True):
                lang[i], score[i] = model.languages[b], q
            group.clear()

        for i, t in enumerate(texts):
            if has_letter(t):
                group.append(i)
                size += len(t)
                if size > 1 << 18:
                    flush()
                    size = 0
        if group:
            flush()
        return lang, score

    return label


def keep_identified(docs: DataFrame, model: ByteCNN | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that have a language; a null lang_col becomes the predicted one. Same columns, no shuffle.

    Rejected are null texts, texts without a letter, and those that the network scores under its `unsure`, which
    calibrate() sets. Without a model every text with a letter stays, as it is. Repeated rows are judged each; an
    empty table gives no rows.
    """
    label = labeller(model)
    unsure = model.unsure if model else 0.0
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, at_text):
                texts = part.column(at_text).to_pylist()
                if model:
                    lang, score = label(texts)
                    keep = [p != "und" and s >= unsure for p, s in zip(lang, score, strict=True)]
                    given = part.column(at_lang).to_pylist()
                    part = part.set_column(at_lang, lang_col, pa.array([g if g is not None else p for g, p in zip(given, lang, strict=True)], pa.string()))
                else:
                    keep = [has_letter(t) for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def calibrate(model: ByteCNN | None, held_out: DataFrame, below: float = BELOW, margin: float = 0.25) -> ByteCNN | None:
    """The model, whose `unsure` lies margin of the way from chance to the score that all but a share `below` of the held-out
    labelled (id, text, lang) reach: well below what texts known to be of a language get. Every such row is scored; scores
    are counted in STEPS steps and taken from a step's lower end. Without such rows, or with one language, nothing counts as
    unsure."""
    if model and len(model.languages) > 1:
        scored = identify(held_out, model, id_col="id").filter("lang_pred <> 'und'")
        levels = sorted(map(tuple, scored.groupBy(F.floor(F.col("score") * STEPS)).count().collect()))
        if levels:
            steps, counts = np.array(levels).T
            lowest = steps[np.searchsorted(counts.cumsum(), below * counts.sum(), side="right")] / STEPS
            chance = 1 / len(model.languages)
            model.unsure = chance + margin * max(0.0, float(lowest) - chance)
    return model


def fold(id_col: str = "doc_id", folds: int = 3):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def labelled(docs: DataFrame, held_out: bool) -> DataFrame:
    """(id, text, lang) of labelled documents, of the fold that is held out or of the others."""
    chosen = docs.filter(((fold() == 1) if held_out else (fold() != 1)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return chosen.select(F.col("doc_id").alias("id"), "text", "lang")


def train_on_folds(docs: DataFrame) -> ByteCNN | None:
    """The network of the documents that aren't held out; null ids belong to no fold and aren't learned from."""
    return train(labelled(docs, held_out=False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Language and score of all documents, by the network of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train_on_folds(docs))
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
