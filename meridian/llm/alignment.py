"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often each pair does."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm import bpe
from meridian.llm.common import by_bytes, drop, materialize, table

#: Between a visible character and a space both tokenizers end a token, whatever surrounds them.
_EDGE = re.compile(r"(?<=\S)(?= )")
_BLANK_SPACE = re.compile(r"\s ")
#: Segments (from edge to edge) that one lane of the alignment walks.
LANE = 64
#: End positions that a probe compares first; it doubles as long as all agree.
PROBE = 4
#: Bytes of text that a task aligns at a time, and of segments that it keeps encoded.
BATCH_BYTES, CACHE_BYTES = 1 << 20, 64 << 20
#: Pairs of ids whose counts are broadcast at most; the others are joined.
HOT_PAIRS = 1 << 20
#: Pairs that a task counts before it hands them on.
FLUSH = 1 << 20


def align(ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens end a group: flags for the tokens of A and of B, from the byte offsets at which tokens end.

    Diagonal run skipping. A lane is a stretch that begins at start_a, start_b, where tokens of both sides begin, and
    ends where the next one does. Each lane holds a place (i, j), whose difference is its shift: probes compare the
    ends from i on with those from j on at that shift, PROBE of them, then twice as many and so on, until one
    differs; what agreed is a stretch of one-to-one groups and is jumped. There the irregular group is resolved: the
    side that ends first goes on until both end together, which updates the shift. Lanes move in step, so that a
    step is a few array operations whatever their number.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    i, j = start_a.astype(np.int64), start_b.astype(np.int64)
    stop = np.append(start_a[1:], len(ends_a)).astype(np.int64)
    while True:
        open_ = i < stop
        if not open_.all():
            i, j, stop = i[open_], j[open_], stop[open_]
        if not len(i):
            return cut_a, cut_b
        probing, width = np.arange(len(i)), PROBE
        while len(probing):
            ahead = np.arange(width)
            at_a, at_b = i[probing, None] + ahead, j[probing, None] + ahead
            # a lane's last tokens end together, so a probe never passes beyond them on one side alone
            inside = at_a < stop[probing, None]
            same = inside & (ends_a[np.minimum(at_a, len(ends_a) - 1)] == ends_b[np.minimum(at_b, len(ends_b) - 1)])
            run = np.where(same.all(axis=1), width, same.argmin(axis=1))
            agreed = ahead < run[:, None]
            cut_a[at_a[agreed]] = True
            cut_b[at_b[agreed]] = True
            i[probing] += run
            j[probing] += run
            probing = probing[(run == width) & (i[probing] < stop[probing])]
            width *= 2
        apart = np.flatnonzero(i < stop)
        while len(apart):
            a, b = ends_a[i[apart]], ends_b[j[apart]]
            i[apart] += a < b
            j[apart] += b < a
            met = apart[a == b]
            cut_a[i[met]] = True
            cut_b[j[met]] = True
            i[met] += 1
            j[met] += 1
            apart = apart[a != b]


class Store:
    """Token ids of many segments in one growing array."""

    def __init__(self) -> None:
        self.ids, self.size, self.first = np.zeros(1 << 16, np.int32), 0, [0]

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Appends segments, which end at ends among ids."""
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.size : self.size + len(ids)] = ids
        self.first += (self.size + ends).tolist()
        self.size += len(ids)

    def take(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments one after the other, and how many there are up to each."""
        first = np.array(self.first)
        n = (first[1:] - first[:-1])[segments]
        until = np.concatenate(([0], np.cumsum(n)))
        return self.ids[np.arange(until[-1]) + np.repeat(first[segments] - until[:-1], n)], until


class Pair:
    """Two tokenizers: byte-level BPE of a file (A, of space + text) and a sentencepiece model (B, which adds the space).

    Ids are those of the whole text. Distinct segments from edge to edge are encoded once and put together: for A an
    edge ends a pre-token; for B no piece has a space after another character, which is looked up in the model,
    and texts are encoded whole if that or A's form isn't so.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = bpe.Encoder(path_a, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.bytes_a = self.a.token_bytes()
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.whole = self.a.ranked is None or any("▁" in p.lstrip("▁") for p in pieces) or self.bytes_b[self.space] != b" "
        self.shown = [b"%d%c" % (k, c) for y, last in ((self.bytes_a, "|"), (self.bytes_b, ";")) for c in (ord(","), ord(last)) for k in range(len(y))]
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.kept: list[bool] = []
        self.of_a, self.of_b, self.size = Store(), Store(), 0

    def segments(self, text: str) -> list[str]:
        """Where the text may be cut for both, without each segment's first space."""
        if self.whole:
            return [text]
        if _BLANK_SPACE.search(" " + text):
            return [x[1:] for x in _EDGE.split(" " + text)]
        return text.split(" ")  # every space is an edge

    def learn(self, segments: list[str]) -> None:
        """Encodes the segments that aren't known. What begins with a space and ends visibly is encoded as one text, in
        which segments end at edges; others, and all where bytes don't come out, one by one."""
        new = [s for s in set(segments) if s not in self.known]
        plain = [] if self.whole else [s for s in new if s and len(s) < bpe.BLANK and not s[-1].isspace() and "▁" not in s]
        joined = " ".join(plain)
        data = (" " + joined).encode()
        together = bool(plain)
        if plain:
            a, b = (np.array(x, np.int32) for x in (self.a.ranked[0](" " + joined), self.b.encode(joined)))
            ends = np.cumsum([len(s.encode()) + 1 for s in plain])
            at = []
            for ids, lengths, bytes_ in ((a, self.lengths_a, self.bytes_a), (b, self.lengths_b, self.bytes_b)):
                until = np.cumsum(lengths[ids])
                place = np.searchsorted(until, ends)
                together = together and place[-1] < len(until) and bool((until[place] == ends).all()) and b"".join([bytes_[k] for k in ids.tolist()]) == data
                at.append(place + 1)
        if together:
            self.of_a.add(a, at[0])
            self.of_b.add(b, at[1])
            self.known.update(zip(plain, range(len(self.known), len(self.known) + len(plain)), strict=True))
            self.kept += [True] * len(plain)
        for s in new if not together else [s for s in new if s not in self.known]:
            a, b = self.a.ids([" " + s])[0], self.b.encode(s) if s else [self.space]
            self.kept.append(b"".join([self.bytes_b[k] for k in b]) == (" " + s).encode() == b"".join([self.bytes_a[k] for k in a]))
            self.of_a.add(np.array(a, np.int32), np.array([len(a)]))
            self.of_b.add(np.array(b, np.int32), np.array([len(b)]))
            self.known[s] = len(self.known)
        self.size += sum(len(s) + 150 for s in new) + len(data)

    def batch(self, texts: list[str | None]) -> dict:
        """Ids, ends and groups of the texts that have tokens, one after the other; rows: which texts these are."""
        if self.size > CACHE_BYTES:
            self.reset()
        split = [self.segments(t) if t else [] for t in texts]
        every = list(chain.from_iterable(split))
        self.learn(every)
        place = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        sizes = np.array([len(x) for x in split], np.int64)
        of = np.repeat(np.arange(len(texts)), sizes)
        lost = np.bincount(of[~np.array(self.kept, bool)[place]], minlength=len(texts)) > 0
        rows = np.flatnonzero((sizes > 0) & ~lost)
        place, sizes = place[~lost[of]], sizes[rows]
        (a, until_a), (b, until_b) = self.of_a.take(place), self.of_b.take(place)
        first = np.cumsum(sizes) - sizes  # of each text's segments
        lanes = np.flatnonzero((np.arange(len(place)) - np.repeat(first, sizes)) % LANE == 0)
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        cut_a, cut_b = align(ends_a, ends_b, until_a[lanes], until_b[lanes])
        return {"rows": rows, "a": a, "b": b, "ends_a": ends_a, "ends_b": ends_b, "cut_a": cut_a, "cut_b": cut_b, "first_a": until_a[first], "first_b": until_b[first]}

    def links(self, x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of each text: (text among those with tokens, code of the pair, number of its links)."""
        inner = np.flatnonzero(~x["cut_b"])  # where both end, the link is counted on A's side
        i = np.concatenate((np.arange(len(x["a"])), np.searchsorted(x["ends_a"], x["ends_b"][inner])))
        j = np.concatenate((np.searchsorted(x["ends_b"], x["ends_a"]), inner))
        of = np.repeat(np.arange(len(x["rows"])), np.diff(np.append(x["first_a"], len(x["a"]))))[i]
        codes = len(self.bytes_a) * len(self.bytes_b)
        keys, n = np.unique(of * codes + x["a"][i].astype(np.int64) * len(self.bytes_b) + x["b"][j], return_counts=True)
        return keys // codes, keys % codes, n

    def digests(self, x: dict) -> list[str]:
        """SHA-256 of each text's groups as a1,a2|b1;a3|b2,b3."""
        cut_a, cut_b = x["cut_a"], x["cut_b"]
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        until_a, until_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1  # tokens until the end of each group
        place = np.empty(len(cut_a) + len(cut_b), np.int64)
        place[np.arange(len(cut_a)) + np.append(0, until_b)[group_a]] = x["a"] + len(self.bytes_a) * cut_a
        place[np.arange(len(cut_b)) + until_a[group_b]] = x["b"] + len(self.bytes_b) * cut_b + 2 * len(self.bytes_a)
        out = []
        starts = x["first_a"] + x["first_b"]
        for s, e in zip(starts, np.append(starts[1:], len(place)), strict=True):
            out.append(hashlib.sha256(b"".join(map(self.shown.__getitem__, place[s:e].tolist()))[:-1]).hexdigest())
        return out


def linked_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, pairs, links) of each row of docs: its distinct linked pairs of ids, and
    how many links each has. A pair's code is A's id * B's vocabulary size + B's id. No shuffle."""
    kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "links": pa.list_(pa.int32())}
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, links array<int>"

    def run(batches):
        pair = Pair(path_a, path_b)
        for batch in batches:
            for part in by_bytes(batch, 1, BATCH_BYTES):
                x = pair.batch(part.column(1).to_pylist())
                rows, n = x["rows"], np.zeros((3, part.num_rows), np.int64)
                digest, ends, codes, links = np.full(part.num_rows, "", object), np.zeros(part.num_rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(rows):
                    of, codes, links = pair.links(x)
                    n[0, rows], n[1, rows] = (np.diff(np.append(x[f], len(x[t]))) for f, t in (("first_a", "a"), ("first_b", "b")))
                    n[2, rows] = np.add.reduceat(x["cut_a"].astype(np.int64), x["first_a"])
                    digest[rows] = pair.digests(x)
                    ends[1 + rows] = np.bincount(of, minlength=len(rows))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(y)) for y in (codes, links)]
                columns = [*(pa.array(c) for c in n), pa.array(digest, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays([part.column(0), *(c.cast(t) for c, t in zip(columns, kinds.values(), strict=True))], names=["id", *kinds])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): in how many rows each pair is linked, counted within each task before the shuffle."""

    def run(batches):
        codes, counts, size = [], [], 0

        def emitted():
            keys, place = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(place, np.concatenate(counts)).astype(np.int64)
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], names=["pair", "n"])

        for batch in batches:
            keys, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            codes.append(keys)
            counts.append(n)
            size += len(keys)
            if size > FLUSH:
                yield from emitted()
                codes, counts, size = [], [], 0
        if codes:
            yield from emitted()

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The tokens of two tokenizers over each whole text, cut into groups where both end a token, and their links.

    A encodes space + text by the byte-level BPE file path_a, B the text by the sentencepiece model path_b, both
    without special tokens, whose strings are plain text. A link is a pair of an A and a B token whose bytes overlap;
    the count of a pair of ids is the number of rows in which it is linked. Returns id, n_a, n_b, n_groups, n_links,
    n_best (links whose count is the highest of their A id, ties included), count_sum (of all links' counts),
    groups_sha256 (of a1,a2|b1;a3|b2,b3).

    Null and empty texts, and texts whose tokens don't give back space + text, have no tokens: zeros and ''. Repeated
    rows are documents each, null ids too. Empty table: no rows. Other columns are ignored.

    Texts are encoded once; a row's distinct pairs are written with it. Pairs are counted within each task before
    the shuffle. Then rows look up their pairs: counts of the most frequent ones, hot_pairs at most, are broadcast;
    a row's other pairs, which few rows have, are joined to the count table.
    """
    spark = docs.sparkSession
    # row numbers are drawn once, as the rows are written
    rows = materialize(linked_documents(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counted = materialize(pair_counts(rows).withColumn("a", F.expr(f"pair div {vocabulary_size(path_b)}")))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # one row for each id of A at most
    flagged = materialize(counted.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    drop(counted)
    powers = {r.p: r.n for r in flagged.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    least = 1 << next(p for p in range(63) if sum(n for q, n in powers.items() if q >= p) <= hot_pairs)
    hot = flagged.filter(F.col("n") >= least).toArrow().sort_by("pair")
    lookup = spark.sparkContext.broadcast((hot["pair"].to_numpy(), hot["n"].to_numpy(), hot["best"].to_numpy()))

    def run(batches):
        keys, counts, best = lookup.value
        for batch in batches:
            codes, n, until = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy().astype(np.int64), batch.column(0).offsets.to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(until))
            at = np.searchsorted(keys, codes)
            found = at < len(keys)
            found[found] = keys[at[found]] == codes[found]
            at, sums = at[found], []
            for value in (n[found] * best[at], n[found] * counts[at]):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, of[found], value)
                sums.append(pa.array(total))
            ends = np.concatenate(([0], np.cumsum(np.bincount(of[~found], minlength=batch.num_rows))))
            rest = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(y[~found])) for y in (codes, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *sums, *rest], names=[*kept, "n_best", "count_sum", "rare", "rare_n"])

    kept = ["id", "row", "n_a", "n_b", "n_groups", "groups_sha256"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", n_best long, count_sum long, rare array<long>, rare_n array<long>"
    found = rows.select("pairs", "links", *kept).mapInArrow(run, schema)
    if sum(powers.values()) > len(hot):
        rare = found.filter(F.size("rare") > 0).select(F.col("row").alias("of"), F.inline(F.arrays_zip("rare", "rare_n")))
        seldom = rare.join(flagged.filter(F.col("n") < least), F.col("rare") == F.col("pair"))
        sums = seldom.groupBy("of").agg(F.sum(F.when(F.col("best"), F.col("rare_n")).otherwise(0)).alias("more_best"), F.sum(F.col("rare_n") * F.col("n")).alias("more"))
        found = found.join(sums, F.col("row") == F.col("of"), "left")
        found = found.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", links, "n_best", "count_sum", "groups_sha256")


def vocabulary_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of all documents' tokens under the 50k byte-level vocabulary and the 32k pieces."""
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
