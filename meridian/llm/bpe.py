"""Byte-level BPE with content-defined chunks: shared chunks are encoded once, their joins are repaired."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_bytes, table

#: Chunks end where a rolling hash of the last WINDOW bytes has its top bits clear: one in 2 ** CUT_BITS places.
WINDOW, CUT_BITS = 16, 9
#: Bytes of chunk and join texts that a task keeps encoded; the least recently used go first.
CACHE_BYTES = 24 << 20
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)
#: Places where every byte-level pre-token ends, whatever surrounds them: between a visible character and a space.
_EDGE = re.compile(r"(?<=\S) ")
_LAST_EDGE = re.compile(r"(?s).*(?<=\S)(?= )")


#: Characters of white space in a run from which ranks are not asked.
BLANK = 1 << 15
_BLANK = re.compile(r"\s+")

#: Fixed value. The published pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, back to the byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranked(path: str, special: bool = True):
    """The tokenizer file as (encode, decode) on merge ranks, several times faster; None unless surely the same.

    That takes plain byte-level BPE whose ids rise with its merges, and at most one special token without flags.
    special=False: special tokens' strings are plain text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added, pre = file["model"], file["added_tokens"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not file["normalizer"] and not file["post_processor"]
    plain = plain and (file["decoder"] or {}).get("type") == "ByteLevel" and len(added) <= 1 and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in merges]
    tokens = {t["content"]: t["id"] for t in added}
    symbols = byte_symbols()
    ranks = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if t not in tokens}
    if made != sorted(set(made)) or sum(len(t) == 1 for t in ranks) != 256 or len(ranks) != 256 + len(made):
        return None
    core = tiktoken.Encoding("ranked", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=tokens)._core_bpe
    return (lambda x: core.encode(x, set(tokens))) if special else core.encode_ordinary, core.decode_bytes


def long_blank(text: str) -> bool:
    """Whether there is a run of over BLANK characters of white space; linear in the text."""
    return len(text) > BLANK and any(m.end() - m.start() > BLANK for m in _BLANK.finditer(text))


class Chunker:
    """Cuts texts where their content says so, so that equal passages are cut alike wherever they stand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 18)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                f = np.full(n, base, np.uint64)
                f[0] = 1
                setattr(self, name, np.cumprod(f, dtype=np.uint64))
        return self.up, self.down

    def cut(self, text: str) -> list[str]:
        data = text.encode("utf-8", "surrogatepass")
        if len(data) < 2 * WINDOW:
            return [text]
        out: list[bytes] = []
        carry = b""
        for at in range(0, len(data), 1 << 20):  # long texts by the megabyte; the window looks back over the seam
            back = min(at, WINDOW)
            out_here = self._cut(np.frombuffer(data, np.uint8)[at - back : at + (1 << 20)], back)
            part = data[at : at + (1 << 20)]
            last = 0
            for c in out_here:
                out.append(carry + part[last:c])
                carry, last = b"", c
            carry += part[last:]
        if carry:
            out.append(carry)
        return [x.decode("utf-8", "surrogatepass") for x in out if x]

    def _cut(self, data: np.ndarray, back: int) -> list[int]:
        up, down = self.powers(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
        ends = np.arange(max(WINDOW, back), len(data))
        hashes = (sums[ends] - sums[ends - WINDOW]) * down[ends - WINDOW]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _BASE
        hit = ((hashes >> np.uint64(64 - CUT_BITS)) == 0) & ((data[ends] & 0xC0) != 0x80)
        return (ends[hit] - back).tolist()


def held(text: str, value: tuple[int, bytes, bytes]) -> int:
    """Bytes that a cached string takes, with what Python adds."""
    return sys.getsizeof(text) + len(value[1]) + len(value[2]) + 330


class Encoder:
    """Encodes texts exactly as the tokenizer does on the whole text, from chunks encoded once per task.

    The tokens of a chunk are right between its first and its last edge; what lies around a join, from the left
    chunk's last edge to the right chunk's first one, is encoded anew as one string. If a side has no edge, the
    string widens over the next chunk, until both of its ends are edges or ends of the text. Pre-tokens and
    special tokens never span an edge, so from there on the ids agree exactly with those of the whole text.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        self.path, self.special = path, special
        self.ranked = ranked(path, special)
        self.tokenizer = None
        self.chunker = Chunker()
        self.cache: OrderedDict[str, tuple[int, bytes, bytes]] = OrderedDict()
        self.size = 0
        self.encoded = self.reused = 0

    def library(self):
        """The tokenizers library's form of the file, loaded only where ranks don't do."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.tokenizer.encode_special_tokens = not self.special
        return self.tokenizer

    def ids(self, strings: list[str]) -> list[list[int]]:
        """Ids of each string. The ranks' pattern looks back over a run of white space by recursion, so strings with
        very long runs go to the library."""
        if not self.ranked:
            return [e.ids for e in self.library().encode_batch(strings, add_special_tokens=False)]
        return [self.library().encode(x, add_special_tokens=False).ids if long_blank(x) else self.ranked[0](x) for x in strings]

    def ids_of(self, strings: list[str]) -> tuple[list[list[int]], list[bytes]]:
        """Ids of each string, and what they decode to."""
        ids = self.ids(strings)
        if self.ranked:
            return ids, [self.ranked[1](i) for i in ids]
        return ids, [d.encode() for d in self.library().decode_batch(ids, skip_special_tokens=False)]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each entry of a byte-level vocabulary, by id; those of special tokens are their strings'."""
        symbols = byte_symbols()
        entries = self.library().get_vocab(with_added_tokens=True)
        out = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            plain = all(c in symbols for c in entry)
            out[k] = bytes(symbols[c] for c in entry) if plain else entry.encode()
        return out

    def pieces(self, text: str) -> list[str]:
        """The strings to encode: chunk cores and joins, in order; concatenated they are the text."""
        out: list[str] = []
        open_ = ""
        for chunk in self.chunker.cut(text):
            first = _EDGE.search(chunk)
            if first is None:
                open_ += chunk
                continue
            a = first.start()
            b = _LAST_EDGE.match(chunk).end()
            # the chunk may start with a space that ends the join's text; then the edge lies before the chunk
            if open_ + chunk[:a]:
                out.append(open_ + chunk[:a])
            if b > a:
                out.append(chunk[a:b])
            open_ = chunk[b:]
        if open_:
            out.append(open_)
        return out

    def encode(self, texts: list[str], keep_ids: bool = False) -> list[tuple]:
        """(number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text[, ids, decoded text]) of each text."""
        parts = [self.pieces(t) for t in texts]
        known: dict[str, tuple[int, bytes, bytes]] = {}
        new: dict[str, None] = {}
        for p in parts:
            for x in p:
                if x in known or x in new:
                    self.reused += 1
                elif x in self.cache:
                    self.cache.move_to_end(x)
                    known[x] = self.cache[x]
                    self.reused += 1
                else:
                    new[x] = None
        strings = list(new)
        self.encoded += len(strings)
        for x, i, d in zip(strings, *self.ids_of(strings), strict=True):
            value = (len(i), str(i)[1:-1].replace(" ", "").encode(), d)
            known[x] = value
            if len(x) <= CACHE_BYTES // 64:
                self.cache[x] = value
                self.size += held(x, value)
        while self.size > CACHE_BYTES:
            self.size -= held(*self.cache.popitem(last=False))
        out = []
        for p in parts:
            values = [known[x] for x in p]
            ids, decoded = b",".join(v[1] for v in values), b"".join(v[2] for v in values)
            row = (sum(v[0] for v in values), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
            out.append((*row, [int(i) for i in ids.split(b",") if i], decoded.decode("utf-8", "replace")) if keep_ids else row)
        return out


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each whole text.

    Ids are those of the tokenizer file on the whole text without special tokens added, unused truncation and
    padding; digests are of the decimal ids joined by commas and of the decoded text in UTF-8. Null text counts as
    empty: no ids, digests of the empty string. Repeated rows are encoded each (from the same chunks). Empty
    table: no rows. Other columns are ignored. A narrow job: no shuffle; chunks are shared within a task, whose
    cache is bounded by CACHE_BYTES. keep_ids adds the ids themselves and the decoded text.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches):
        encoder = Encoder(tokenizer_path)
        kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())][: 5 if keep_ids else 3]
        for batch in batches:
            for part in by_bytes(batch, limit=1 << 20):
                rows = encoder.encode([t or "" for t in part.column(1).to_pylist()], keep_ids)
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))], names=[id_col, *(name for name, _ in kinds)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents under the 50k byte-level vocabulary."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
