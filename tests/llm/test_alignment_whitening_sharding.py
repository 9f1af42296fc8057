import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meridian.llm import alignment, sharding, whitening
from tests.llm.test_llm import ALPHABET, SF, VECTORS, awkward, common, docs_of, vectors_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# alignment


def brute_alignment(texts):
    """Rows of the alignment from its definition, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    docs, held = [], Counter()
    for text in texts:
        data = (" " + (text or "")).encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        of_a = [bytes(symbols[c] for c in t.id_to_token(k)) for k in a]
        of_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [sp.id_to_piece(k)]]
        if not text or b"".join(of_a) != data or b"".join(of_b) != data:
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        both, groups, last = sorted(set(ends_a) & set(ends_b)), [], 0
        for end in both:
            side = [",".join(str(k) for k, e in zip(ids, ends, strict=True) if last < e <= end) for ids, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(side))
            last = end
        links = [(x, y) for x, e, n in zip(a, ends_a, of_a, strict=True) for y, f, m in zip(b, ends_b, of_b, strict=True) if max(e - len(n), f - len(m)) < min(e, f)]
        docs.append((len(a), len(b), groups, links))
        held.update(set(links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(held[p] == most[p[0]] for p in d[3]), sum(held[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


@pytest.mark.parametrize("hot", [1 << 20, 40, 1])
def test_alignment_against_brute_force(spark, hot):
    r = random.Random(3)
    alphabet = [*ALPHABET, "<s>", "</s>", "<unk>", "<0x41>", "中文", "\x00", "ﬀ", "word ", "wording "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(60)]
    texts += [None, "", " ", "  ", "a ", " a", "▁", "x▁ y", "a▁b", "same text", "same text", "x" * 3000, "a b " * 700, " ".join("word" * (k % 5) for k in range(400))]
    got = {x[0]: tuple(x)[1:] for x in alignment.align_documents(docs_of(spark, texts), A, B, hot_pairs=hot).collect()}
    assert [got[k] for k in range(len(texts))] == brute_alignment(texts)


def test_alignment_of_documents_and_awkward_tables(spark):
    rows = common.table(spark, SF, "documents").filter("length(text) < 1500").limit(60).select("text").collect()
    texts = [r.text for r in rows] + [t and t[:2000] for t in awkward()]
    got = {x[0]: tuple(x)[1:] for x in alignment.align_documents(docs_of(spark, texts).repartition(3), A, B).collect()}
    assert [got[k] for k in range(len(texts))] == brute_alignment(texts)
    assert alignment.align_documents(docs_of(spark, texts).limit(0), A, B).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted({tuple(x)[1:] for x in alignment.align_documents(twice, A, B).collect()}) == sorted(set(brute_alignment(["a b"] * 3)))


def test_runs_are_jumped_and_irregular_groups_resolved():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 400))
        cuts = np.flatnonzero(r.random(n) < r.choice([0.02, 0.3, 0.9])) + 1
        a, b = (np.union1d(cuts[r.random(len(cuts)) < keep], [n]) for keep in r.choice([0.5, 0.95, 1.0], 2))
        starts = np.array([[0, 0]])
        cut_a, cut_b = alignment.align(a, b, starts[:, 0], starts[:, 1])
        assert a[cut_a].tolist() == b[cut_b].tolist() == np.intersect1d(a, b).tolist()


# whitening


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "rank", "graded", "zero"])
def test_eigenvectors_to_double_precision(kind):
    r = np.random.default_rng(2)
    d = 48
    values = {"random": r.random(d), "clusters": np.r_[[5.0] * 12, 5 + 1e-9 * np.arange(12), [1.0] * 12, 1 + 1e-5 * np.arange(12)], "equal": np.ones(d), "rank": np.r_[np.zeros(40), np.arange(1, 9)], "graded": 10.0 ** -np.arange(d), "zero": np.zeros(d)}[kind]
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.eigen(v)
    norm = np.abs(v).max() or 1
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14
    assert np.abs(v @ x - x * e).max() < 1e-14 * norm
    assert np.all(np.diff(e) <= 1e-15 * norm) and np.abs(e - np.maximum(np.linalg.eigvalsh(v)[::-1], 0)).max() < 1e-13 * norm
    if kind == "random":  # of separate eigenvalues the vectors are the library's, up to sign
        u = np.linalg.eigh(v)[1][:, ::-1]
        assert np.abs(np.abs((u * x).sum(axis=0)) - 1).max() < 1e-12
        assert np.abs(np.linalg.eigh(v.astype(np.float32))[1][:, ::-1] - x).max() > 1e-8  # the float32 start isn't


def test_whitening_query_against_brute_force(spark):
    t = common.table(spark, SF, "embeddings").collect()
    t = [r for r in t if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in t]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    v = off.T @ off / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    rows = whitening.op11_whitening(spark, SF).collect()
    assert len(rows) == 32 * n
    ids = {r.vec_id: k for k, r in enumerate(t)}
    got = np.zeros((n, 32))
    for r in rows:
        k = ids[r.vec_id]
        got[k, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[k], sums, strict=True)) if r.component == 1 else True
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9
    want = off @ u[:, :32] / np.sqrt(e[:32])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-8


def test_whitening_of_awkward_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (1, [2.0, 1.0, 3.0]), (None, [0.5, 0.5, 3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0]), (6, []), (7, [1.0]), (8, [1e300, -1e300, 3.0]), (1, [1.0, 2.0, 3.0])]
    got = whitening.whiten_vectors(vectors_of(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got if r.vec_id) == [(False, 1)] * 3 + [(False, 8)] and len(got) == 5
    assert all(len(r.whitened) == 3 and r.whitened[2] is None and r.n == 5 for r in got)  # the third entry never varies
    one = whitening.whiten_vectors(vectors_of(spark, rows[:1])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, [None] * 3, 0.0)]
    assert whitening.whiten_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten_vectors(vectors_of(spark, rows[3:9])).count() == 1  # [1.0] is left, by itself


def test_sums_beyond_a_long_stay_exact():
    big = whitening.Whitening(1 << 40, [5 << 60], np.ones(1), np.eye(1), 1.0)
    assert big.deviations(np.array([[1 << 30]])).tolist() == [[(1 << 70) - (5 << 60)]]


# sharding


def checked(rows, texts, shards=24):
    """Holds shards against the contract; returns the part of equal pairs that stand together."""
    assert len(rows) == len(texts)
    by, groups = {}, {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        by.setdefault(r.shard, []).append(r)
        groups.setdefault(data, Counter())[r.shard] += 1
    assert set(by) <= set(range(shards))
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    pairs = sum(n * (n - 1) for g in groups.values() for n in [sum(g.values())])
    return (sum(k * (k - 1) for g in groups.values() for k in g.values()) / pairs if pairs else 1.0), {s: sum(r.size for r in held) for s, held in by.items()}


def test_copies_stand_together_in_even_shards(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdef ") for _ in range(r.randint(1, 400))) for _ in range(3000)]
    texts = base + [r.choice(base[:600]) for _ in range(3000)]  # half of all are copies
    together, sizes = checked(sharding.shard_documents(docs_of(spark, texts).repartition(5)).collect(), texts)
    mean = sum(sizes.values()) / 24
    assert together > 0.9 and len(sizes) == 24
    assert all(abs(n - mean) < 0.03 * mean for n in sizes.values())
    hashed = sum(1 for k in range(24)) / 24**2
    assert together > 10 * hashed


def test_every_text_has_copies(spark):
    """No room is left for movers but what others leave."""
    r = random.Random(6)
    texts = ["".join(r.choice("abcdef ") for _ in range(100)) for _ in range(2400)] * 2
    together, sizes = checked(sharding.shard_documents(docs_of(spark, texts)).collect(), texts)
    mean = sum(sizes.values()) / 24
    assert together > 0.7 and all(abs(n - mean) < 0.03 * mean for n in sizes.values())


def test_a_third_of_all_rows_is_one_text(spark):
    r = random.Random(7)
    texts = ["hot text " * 10] * 3000 + ["".join(r.choice("abcdef ") for _ in range(r.randint(50, 130))) for _ in range(6000)]
    together, sizes = checked(sharding.shard_documents(docs_of(spark, texts)).collect(), texts)
    mean = sum(sizes.values()) / 24
    assert all(abs(n - mean) < 0.03 * mean for n in sizes.values())
    assert together > 0.08  # it fills some eight shards of 24; spread at random, one pair in 24 is together


def test_heavy_documents_and_their_copies(spark):
    texts = ["x" * 50_000] * 2 + ["y" * 30_000, "z" * 120_000] + [f"small {k}" * 20 for k in range(6000)]
    rows = sharding.shard_documents(docs_of(spark, texts)).collect()
    _, sizes = checked(rows, texts)
    mean = sum(sizes.values()) / 24
    assert sizes[next(r.shard for r in rows if r.doc_id == 3)] < 120_000 + 0.02 * mean  # over a share: alone
    assert all(n < 1.02 * mean or n < 120_100 for n in sizes.values())


def test_sharding_of_awkward_tables(spark):
    texts = awkward()
    checked(sharding.shard_documents(docs_of(spark, texts)).collect(), texts)
    assert sharding.shard_documents(docs_of(spark, texts).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (1, None), (None, None)], "doc_id long, text string").withColumn("row", F.lit(0)).withColumn("size", F.lit("s"))
    rows = sharding.shard_documents(df).collect()
    assert len(rows) == 5 and sorted(r.size for r in rows) == [8, 8, 9, 9, 9] and {r.text_crc32 for r in rows if r.size == 8} == {0}
    assert sharding.shard_documents(df, shards=1).filter("shard = 0").count() == 5


def test_movers_fit_into_their_shards():
    flow = {(0, 1): 30.0, (1, 0): 10.0, (2, 1): 50.0}
    part = sharding.fractions([100.0, 90.0, 60.0], 100.0, flow)
    loads = [100 - 30 * part[1] + 10 * part[0], 90 + 80 * part[1] - 10 * part[0], 60 - 50 * part[1]]
    assert all(n <= 100 + 1e-9 for n in loads) and part == pytest.approx([0.6, 0.2, 1.0])
