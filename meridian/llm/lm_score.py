"""LM scoring: stupid backoff on hashed n-gram count tables of the corpus, each text's own counts left out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridian.llm.common import by_bytes, drop, materialize, table
from meridian.llm.words import mix, word_hashes

#: A word is frequent if it makes up at least this share of all words. So there are at most 1 / HOT_SHARE of them,
#: and the square of that in pairs of two frequent words (16 bytes each): the bounds of what is broadcast.
HOT_SHARE = 2.0**-11
#: Words whose counts are broadcast at most: the most frequent ones.
TOP_WORDS = 1 << 20
BACKOFF = 0.4
#: Words that a task counts, or turns into bigram rows, at a time.
FLUSH = 1 << 18
#: Buckets by which bigrams are dealt out, for each shuffle partition.
BUCKETS = 16
#: Bound of numbers that tell bigrams of a task's texts apart.
ONE_NUMBER = 1 << 63
#: Stand for the next word where a context ends a text, and where it begins one. Words of the broadcast table are numbered
#: from WORD on, which takes fewer bytes in a shuffle than their hashes; those of others have their first bit set.
LAST, FIRST, WORD, OUTSIDE = 0, 1, 2, np.uint64(1 << 63)
#: Sides of the rows that bigrams are shuffled as: by context, by word, and sums by document.
BY_CONTEXT, BY_WORD, SUMS = 0, 1, 2


def _groups(batches) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(ids, word hashes) of documents with words, some FLUSH words at a time; only A-Z are lower-cased."""
    ids: list[int] = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for part in by_bytes(batch):
            bodies = [(t or b"").lower() for t in part.column(1).cast(pa.binary()).to_pylist()]
            for i, w in zip(part.column(0).to_pylist(), word_hashes(bodies), strict=True):
                if len(w):
                    ids.append(i)
                    texts.append(w)
                    size += len(w)
                if size > FLUSH:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the unigram count table, by 64-bit word hash; counted within each task before the shuffle."""

    def count(batches):
        for _, texts in _groups(batches):
            words, n = np.unique(np.concatenate(texts), return_counts=True)
            for i in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["word", "n"])

    return docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _next(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text) of every bigram."""
    words = np.concatenate(texts)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    inside = of[1:] == of[:-1]
    return words[:-1][inside], words[1:][inside], of[1:][inside]


def _place(frequent: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word among the frequent ones (sorted), -1 for others."""
    if not len(frequent):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    return np.where(frequent[at] == words, at, -1)


def frequent_pairs(docs: DataFrame, model: Broadcast) -> DataFrame:
    """(pair, n): the count table of bigrams of two frequent words; pair numbers them."""

    def count(batches):
        known = model.value[3]
        for _, texts in _groups(batches):
            context, word, _ = _next(texts)
            v, w = _place(known, context), _place(known, word)
            pairs, n = np.unique((v * len(known) + w)[(v >= 0) & (w >= 0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return docs.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_counts(unigrams: DataFrame, top_words: int) -> int:
    """The least count from which there are at most top_words words, among the numbers up to 64 and 64 * 2^k: their
    table is known everywhere, and a word outside it has a smaller count."""
    n = F.col("n")
    level = F.when(n <= 64, n).otherwise(F.lit(64) * F.pow(F.lit(2.0), F.floor(F.log2(n / 64)))).cast("long")
    levels = {r.level: r.words for r in unigrams.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}
    fits = [x for x in levels if sum(k for y, k in levels.items() if y >= x) <= top_words]
    return 1 if len(fits) == len(levels) else min(fits, default=max(levels) * 2)


def bigram_rows(docs: DataFrame, model: Broadcast, pairs: Broadcast, buckets: int, backoff: float) -> DataFrame:
    """The exploded bigrams of every text, counted by document within a task: rows of a bucket and arrays of side, context,
    word, document (its upper and lower half), n, and how much oftener than n the document has the context and the word.

    What the broadcast counts alone tell is scored here and comes as SUMS by document (n, seen as own_c, words that backed
    off as own_w, score): bigrams of two frequent words, and those of a word that no other document has. All others meet
    in a bucket. Words outside the table of counts get theirs there, too: a bigram is dealt out BY_WORD if that is such a
    word (first words of texts come with the context FIRST), and BY_CONTEXT otherwise (last words of texts come as
    contexts of LAST); if both are, it goes to both. So a bucket has all occurrences of such a word. Bigrams of a
    frequent context are dealt out by their word too."""
    floor, limit = 2 * np.log(backoff), ONE_NUMBER

    def run(batches):
        table, counts, least, known, total = model.value
        pair_of, pair_n = pairs.value
        for ids, texts in _groups(batches):
            ids = np.array(ids, np.int64)
            words = np.concatenate(texts)
            of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
            distinct, at = np.unique(words, return_inverse=True)
            _, place, n = np.unique(of.astype(np.int64) * len(distinct) + at, return_inverse=True, return_counts=True)
            own = n[place]
            numbers = _place(table, distinct)
            in_table, hot = numbers[at], _place(known, distinct)[at]
            # the count of a word; a word outside the table that has all that it can have here, has it here alone
            count = np.where(in_table >= 0, counts[in_table] if len(counts) else 0, np.where(own >= least - 1, own, -1))
            others = np.where(count >= 0, count - own, -1)
            outside = count < 0
            codes = np.where(numbers >= 0, (numbers + WORD).astype(np.uint64), distinct | OUTSIDE)
            ranks = np.empty(len(codes), np.int64)
            ranks[np.argsort(codes)] = np.arange(len(codes)) + WORD
            code, rank = codes[at], ranks[at]
            n, seen, score, backs = (np.zeros(len(texts), k) for k in (np.int32, np.int32, np.float64, np.int32))

            def alone(where):
                """Scores words without a context that counts."""
                d, rest = of[where], others[where]
                n[:] += np.bincount(d, minlength=len(texts)).astype(np.int32)
                backs[:] += np.bincount(d, rest > 0, len(texts)).astype(np.int32)
                score[:] += np.bincount(d, np.where(rest > 0, np.log(backoff * np.maximum(rest, 1)), floor - np.log(total)), len(texts))

            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            last = np.append(first[1:], len(of)) - 1
            w = np.setdiff1d(np.arange(len(of)), first, assume_unique=True)  # the word of each bigram; its context is the one before
            v = w - 1
            alone(first[~outside[first]])
            both = (hot[v] >= 0) & (hot[w] >= 0)
            if both.any():
                x, y = v[both], w[both]
                k = np.searchsorted(pair_of, hot[x] * len(known) + hot[y])
                _, place, times = np.unique(of[x].astype(np.int64) * len(pair_of) + k, return_inverse=True, return_counts=True)
                rest = pair_n[k] - times[place]
                some = rest > 0
                x, y, rest = x[some], y, rest[some]
                alone(y[~some])
                d = of[x]
                more = np.bincount(d, minlength=len(texts)).astype(np.int32)
                n += more
                seen += more
                score += np.bincount(d, np.log(rest) - np.log(others[x]), len(texts))
            single = ~both & ((others[v] == 0) | ((others[w] == 0) & ~outside[v])) & ~outside[w]
            alone(w[single])
            # such a word after one outside the table is scored here too, its place counts for that one as if it were a last word
            lone = ~both & ~single & (others[w] == 0) & ~outside[w]
            alone(w[lone])
            some = np.flatnonzero(n)
            if len(some):
                nothing = np.zeros(len(some))
                yield _row(int(mix(ids[:1].view(np.uint64))[0] % np.uint64(buckets)), side=nothing + SUMS, context=nothing, word=nothing + WORD, high=ids[some] >> 32, low=ids[some], n=n[some], own_c=seen[some], own_w=backs[some], score=score[some])

            e = np.concatenate((last[outside[last]], v[lone]))
            w = w[~both & ~single & ~lone]
            v = w - 1
            by_word, by_context = outside[w], ~outside[w] | outside[v]
            f = first[outside[first]]
            sides = [(BY_WORD, v[by_word], w[by_word]), (BY_WORD, None, f), (BY_CONTEXT, v[by_context], w[by_context]), (BY_CONTEXT, e, None)]
            side = np.concatenate([np.full(len(x if y is None else y), s) for s, x, y in sides])
            if not len(side):
                continue
            pick = lambda k, of, none: np.concatenate([np.full(len(s[3 - k]), none, of.dtype) if s[k] is None else of[s[k]] for s in sides])
            c_rank, w_rank = pick(1, rank, FIRST), pick(2, rank, LAST)
            d = of[np.concatenate([x if y is None else y for _, x, y in sides])]
            size = len(codes) + WORD
            if 2 * size * size * len(texts) < limit:  # all in one number, unless a text is huge
                same = ((side * size + c_rank) * size + w_rank) * len(texts) + d
                order = np.argsort(same)
                same = same[order]
                start = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
            else:
                order = np.lexsort((d, w_rank, c_rank, side))
                new = [x[order][1:] != x[order][:-1] for x in (side, c_rank, w_rank, d)]
                start = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce(new))))
            n = np.diff(np.append(start, len(order)))
            one = order[start]
            side, d = side[one], d[one]
            c, w = pick(1, code, FIRST)[one], pick(2, code, LAST)[one]
            own_c, own_w = pick(1, own, 0)[one] - n, pick(2, own, 0)[one] - n
            of_hot = pick(1, hot, -1)[one] >= 0
            mixed = mix(np.where(side == BY_WORD, w, c))
            by_both = np.flatnonzero(of_hot & (side == BY_CONTEXT) & (w != LAST))
            mixed[by_both] = mix(c[by_both] + mix(w[by_both]))
            bucket = (mixed % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            side, c, w, d, own_c, own_w, n, bucket = (x[order] for x in (side, c.view(np.int64), w.view(np.int64), ids[d], own_c, own_w, n, bucket))
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                yield _row(int(bucket[i]), side=side[i:j], context=c[i:j], word=w[i:j], high=d[i:j] >> 32, low=d[i:j], n=n[i:j], own_c=own_c[i:j], own_w=own_w[i:j], score=np.zeros(j - i))

    return docs.mapInArrow(run, "bucket int, " + ", ".join(f"{k} array<{t}>" for k, t in ARRAYS.items()))


ARRAYS = {"side": "tinyint", "context": "long", "word": "long", "high": "int", "low": "int", "n": "int", "own_c": "int", "own_w": "int", "score": "double"}
_KINDS = {"tinyint": np.int8, "long": np.int64, "int": np.int32, "double": np.float64}


def _row(bucket: int, **arrays: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(arrays[k].astype(_KINDS[t])) for k, t in ARRAYS.items()]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *lists], names=["bucket", *ARRAYS])


def stupid_backoff(
    docs: DataFrame, backoff: float = BACKOFF, hot_share: float = HOT_SHARE, top_words: int = TOP_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, n_seen, log_score) of each whole text under the bigram model of all other texts: no context and no
    bigram is left out, whatever its count.

    Words are lower-cased in A-Z. With counts over the corpus less those of the text itself, a word w after v scores
    c(v w) / c(v) if other texts have v w; if not, and for the first word, it backs off to backoff * c(w) / N; if no other text
    has w either, to backoff^2 / (all words). log_score sums the natural logarithms. n_seen counts the words whose
    bigram other texts have.

    Null and empty texts: no words, score 0. Rows repeating an id are summed: each is held against all others, N leaves
    out the words of all; rows of null id are left out. Empty table: no rows. Other columns are ignored.

    1. The unigram table is counted. The counts of the top_words most frequent words are broadcast, then those of pairs of
       two frequent ones, of which one alone can stand in every document.
    2. All bigrams that these don't score are shuffled once, by context, or by word where the word is outside the
       table; those of a frequent context by their word too.
    3. Their count tables are windows over them, so that counts meet the exploded bigrams without another shuffle.
    4. Logarithms are summed by document, pre-aggregated before that shuffle.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    unigrams = materialize(word_counts(docs))
    total = max(int(unigrams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), 1)
    least = frequent_counts(unigrams, top_words)
    counted = unigrams.filter(F.col("n") >= least)
    top = counted.toArrow()
    words = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, counts = words[order], top["n"].to_numpy()[order]
    known = words[counts >= max(least, hot_share * total)]
    model = spark.sparkContext.broadcast((words, counts, least, known, total))
    paired = frequent_pairs(docs, model).toArrow().sort_by([("pair", "ascending")])
    pairs = spark.sparkContext.broadcast((paired["pair"].to_numpy(), paired["n"].to_numpy()))

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = bigram_rows(docs, model, pairs, BUCKETS * partitions, backoff).repartition(partitions, "bucket")
    doc = F.shiftleft(F.col("high").cast("long"), 32).bitwiseOR(F.col("low").cast("long").bitwiseAND(0xFFFFFFFF))
    sums_, by_word, first = F.col("side") == SUMS, F.col("side") == BY_WORD, F.col("context") == FIRST
    # arrays are read in place, without a row made of them all first
    entries = dealt.select("*", F.posexplode("side").alias("i", "of_side")).select("bucket", F.col("of_side").alias("side"), *(F.get(k, "i").alias(k) for k in ARRAYS if k != "side"))
    key, other = F.when(by_word, F.col("word")).otherwise(F.col("context")), F.when(by_word, F.col("context")).otherwise(F.col("word"))
    entries = entries.select("bucket", "side", key.alias("key"), other.alias("other"), doc.alias("doc"), "n", "own_c", "own_w", "score")
    # one sort for both: the wider window comes first and has the order of the other. The key leads, so that it seldom looks further
    uses = F.sum("n").over(W.partitionBy("key", "bucket", "side").orderBy("other").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    pair_n = F.sum("n").over(W.partitionBy("key", "bucket", "side", "other"))
    entries = entries.withColumn("uses", uses).withColumn("pair_n", pair_n)
    entries = entries.withColumn("context", F.when(by_word, F.col("other")).otherwise(F.col("key"))).withColumn("word", F.when(by_word, F.col("key")).otherwise(F.col("other"))).filter(F.col("word") != LAST)
    numbered = materialize(spark.createDataFrame(pa.table({"is": np.arange(len(words), dtype=np.int64) + WORD, "n": counts.astype(np.int64)}), "is long, n long"))
    for c in ("context", "word"):  # top_words rows at most
        entries = entries.join(F.broadcast(numbered.select(F.col("is").alias(f"{c}_is"), F.col("n").alias(f"{c}_n"))), F.col(c) == F.col(f"{c}_is"), "left")
    of_context = F.when(by_word, F.col("context_n")).otherwise(F.coalesce("context_n", "uses")) - F.col("own_c") - F.col("n")
    of_word = F.when(by_word, F.col("uses")).otherwise(F.col("word_n")) - F.col("own_w") - F.col("n")
    seen = ~first & (F.col("pair_n") > F.col("n"))
    # of a bigram that went to two buckets, one knows its context's count and the other its word's
    scored = F.when(seen, of_context.isNotNull()).otherwise(of_word.isNotNull())
    log = F.when(seen, F.log(F.col("pair_n") - F.col("n")) - F.log(of_context)).when(of_word > 0, F.log(F.lit(backoff)) + F.log(of_word)).otherwise(F.lit(2 * math.log(backoff) - math.log(total)))
    here = lambda name, given, value: F.sum(F.when(sums_, given).when(scored, value).otherwise(0)).alias(name)
    sums = entries.groupBy(F.col("doc").alias("of")).agg(
        here("n", F.col("n"), F.col("n")),
        here("seen", F.col("own_c"), F.when(seen, F.col("n")).otherwise(0)),
        here("score", F.col("score"), F.col("n") * log),
        here("backs", F.col("own_w"), F.when(~seen & (of_word > 0), F.col("n")).otherwise(0)),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    others = F.log(F.greatest(F.lit(float(total)) - F.col("n"), F.lit(1.0)))
    return docs.select("id").distinct().join(sums, F.col("id") == F.col("of"), "left").select(
        F.col("id").alias(id_col), zero("n").alias("n_words"), zero("seen").alias("n_seen"), F.coalesce(F.col("score") - F.col("backs") * others, F.lit(0.0)).alias("log_score")
    )


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of all documents."""
    return stupid_backoff(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


OP5_SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
t as (select doc_id, w[i] as w, case when i > 1 then w[i - 1] end as v from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
uo as (select doc_id, w, count(*) as own from t group by doc_id, w), u as (select w, sum(own) as n from uo group by w),
bo as (select doc_id, v, w, count(*) as own from t where v is not null group by doc_id, v, w), b as (select v, w, sum(own) as n from bo group by v, w),
s as (select count(*) as total from t), l as (select doc_id, count(*) as len from t group by doc_id),
x as (select t.doc_id, b.n - bo.own as pair, cu.n - co.own as context, wu.n - wo.own as word, total, total - len as others
  from t cross join s join l using (doc_id) join u wu on wu.w = t.w join uo wo on wo.doc_id = t.doc_id and wo.w = t.w
  left join b on b.v = t.v and b.w = t.w left join bo on bo.doc_id = t.doc_id and bo.v = t.v and bo.w = t.w left join u cu on cu.w = t.v left join uo co on co.doc_id = t.doc_id and co.w = t.v),
y as (select doc_id, coalesce(pair > 0, false) as seen, case when pair > 0 then ln(pair) - ln(context) when word > 0 then ln(0.4) + ln(word) - ln(others) else 2 * ln(0.4) - ln(total) end as score from x)
select d.doc_id, count(y.doc_id)::bigint as n_words, coalesce(sum(y.seen::int), 0)::bigint as n_seen, round(coalesce(sum(y.score), 0e0), 4) as log_score
from d left join y using (doc_id) group by d.doc_id
"""
