"""Secret scans: fixed patterns, and zstandard novelty of strings in sensitive contexts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_bytes, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits begins where its first match does, so this drops the short runs only
KINDS = ("assign", "access", "hex", "novel")
#: Fixed values. Parts of identifiers that make a context sensitive.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "private_key", "auth", "bearer", "credential", "signature", "client_id")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.I | re.A)
_SENSITIVE_BYTES = tuple(s.encode() for s in SENSITIVE)
#: Characters of the shortest candidate.
LEAST = 8
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST, re.A)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]*", re.A)
#: Fixed values. Words that identifiers in code are made of: the dictionary's constant part.
IDENTIFIERS = (
    "access account action address algorithm allow api array async auth await base64 bearer bool boolean bucket buffer build byte bytes cache callback client "
    "class cluster column commit config configuration connection const content context count credential data database date debug default delete "
    "description dict document domain double element email enable encoding endpoint environment error event example exception export false field file filter "
    "float format function header host http https identifier image import index input instance int integer internal interface json key language length "
    "library limit list local localhost log login manager message method model module name namespace network null number object option output "
    "package parameter params password path pattern permission policy port prefix private process profile project property protocol provider proxy public "
    "query random read region registry release remote request resource response result return role route schema scope secret select self server service "
    "session setting signature size source start state static status storage stream string struct suffix system table tag target template test text "
    "timeout timestamp title token type undefined update upload url user username utf-8 uuid value variable version view void width window write "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 xxxxxxxx example test1234"
)
#: Characters on either side of a candidate that prime the dictionary.
AROUND = 512
#: Shorter candidates are measured only if letters and digits alternate: other words of that length are as novel as keys.
PLAIN_LENGTH = 16
#: Marginal bytes per character from which a candidate is novel: alternating ones, and others.
MIN_NOVELTY, MIN_PLAIN = 0.45, 0.93


def novelty(text: str, start: int, end: int, around: int = AROUND, level: int = 9) -> float:
    """Marginal compressed bytes per character of text[start:end], zstandard primed with what surrounds it.

    The dictionary is the identifier list, then the surrounding text, around characters on either side, with the
    candidate and its copies taken out, so that a string isn't its own dictionary. Marginal bytes: the compressed
    size of the text just before with the candidate, less that without it.
    """
    own, reach = text[start:end], around + end - start  # a copy that stands across the edge is taken out whole
    before = text[max(0, start - reach) : start].replace(own, "")[-around:]
    after = text[end : end + reach].replace(own, "")[:around]
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + after + before).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    context = before[-32:].encode("utf-8", "replace")
    return (len(compressor.compress(context + own.encode())) - len(compressor.compress(context))) / (end - start)


def mixed(s: str) -> bool:
    """Letters and digits alternate: not a word, a number or an identifier with a number at its end."""
    kinds = ["d" if c.isdigit() else "a" for c in s if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) >= 3


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what may be a secret after each sensitive word: to the end of its line and of the next one.

    Of a run of candidate characters with sensitive words in it, what follows the first and the last of them. Every
    place is looked at once, so the cost is linear in the text.
    """
    until, line, end = 0, -1, 0
    run, last = 0, -1
    for word in _SENSITIVE.finditer(text):
        if word.start() >= run:
            if last >= 0 and (m := _CANDIDATE.match(text, last)):
                yield m.span()
            run = _RUN.match(text, word.end()).end()
        last = word.end()
        if word.end() > line:
            line = text.find("\n", word.end())
            end = text.find("\n", line + 1) if line >= 0 else -1
            line, end = (len(text) if x < 0 else x for x in (line, end))
        for m in _CANDIDATE.finditer(text, max(word.end(), until), end):
            yield m.span()
        until = max(until, end)
    if last >= 0 and (m := _CANDIDATE.match(text, last)):
        yield m.span()


def occurrences(text: str, strings: set[str]) -> list[tuple[int, int]]:
    """All places of the strings in text, those of longer strings first; one pass whatever their number."""
    automaton = ahocorasick.Automaton()
    for x in strings:
        automaton.add_word(x, len(x))
    automaton.make_automaton()
    return sorted(((end + 1 - n, end + 1) for end, n in automaton.iter(text)), key=lambda x: (x[0] - x[1], x))


def scan(text: str | None, min_novelty: float = MIN_NOVELTY, min_plain: float = MIN_PLAIN, around: int = AROUND) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, by start and then kind; code points, end exclusive.

    A candidate is novel from min_novelty on if letters and digits alternate in it, otherwise from min_plain on. All
    places of a novel string are reported, but those that base spans cover whole; one that reaches beyond a base span is
    reported whole, so that no end of a secret is lost.
    """
    if not text:
        return []
    low = text.encode("utf-8", "replace").lower()
    found: list[tuple[int, int, int]] = []
    if b"pass" in low or b"secret" in low or b"token" in low or b"api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(s in low for s in _SENSITIVE_BYTES):
        measured: dict[str, bool] = {}  # each distinct string once, at its first place
        base, covered = bytearray(len(text)), bytearray(len(text))

        for a, _, b in found:
            base[a:b] = b"\x01" * (b - a)
        for a, b in candidates(text):
            begins = base.find(1, a, b)
            if 0 < begins - a < LEAST:  # a short prefix is an identifier's, the secret begins with the base span
                a = begins
            own = text[a:b]
            if own in measured or base.find(0, a, b) < 0:
                continue
            alternating = mixed(own)
            if b - a >= PLAIN_LENGTH or alternating:
                measured[own] = novelty(text, a, b, around) >= (min_novelty if alternating else min_plain)
        novel = {x for x, is_novel in measured.items() if is_novel}
        for a, b in occurrences(text, novel) if novel else ():
            if covered.find(1, a, b) < 0 and base.find(0, a, b) >= 0:
                found.append((a, 3, b))
                covered[a:b] = b"\x01" * (b - a)
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with each maximal run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


def scan_documents(
    docs: DataFrame,
    min_novelty: float = MIN_NOVELTY,
    min_plain: float = MIN_PLAIN,
    around: int = AROUND,
    mask: str = "[SECRET]",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans of each whole text, and the text with them masked.

    Returns id, n_assign, n_access, n_hex, n_novel, base_sha256 (of the base kinds' kind:start:end, by start and
    then kind, comma-joined), spans (all kinds, joined likewise), masked_text. Spans of different kinds may
    overlap. Null text counts as empty (masked_text is null then); empty texts have no spans; repeated rows are
    scanned each; other columns are ignored; an empty table gives no rows. A narrow job, without shuffle.
    """
    columns = ["n_assign", "n_access", "n_hex", "n_novel"]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'{c} long' for c in columns)}, base_sha256 string, spans string, masked_text string"

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                counts, base, spans, texts = [], [], [], []
                for t in part.column(1).to_pylist():
                    s = scan(t, min_novelty, min_plain, around)
                    counts.append([sum(k == x for _, k, _ in s) for x in range(4)])
                    base.append(hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest())
                    spans.append(joined(s))
                    texts.append(masked(t, s, mask) if s else t)
                arrays = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays, pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(texts, pa.string())], names=[id_col, *columns, "base_sha256", "spans", "masked_text"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def mask_documents(
    docs: DataFrame,
    min_novelty: float = MIN_NOVELTY,
    min_plain: float = MIN_PLAIN,
    around: int = AROUND,
    mask: str = "[SECRET]",
    text_col: str = "text",
    length_col: str | None = None,
) -> DataFrame:
    """The rows of docs with all spans masked in text_col; length_col is set to the text's new length. No shuffle.

    Null texts stay null, with a null length; repeated rows are masked each; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)
    at_length = docs.columns.index(length_col) if length_col else None

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, at):
                texts = [masked(t, scan(t, min_novelty, min_plain, around), mask) if t else t for t in part.column(at).to_pylist()]
                part = part.set_column(at, text_col, pa.array(texts, pa.string()))
                if at_length is not None:
                    kind = part.schema.field(at_length).type
                    part = part.set_column(at_length, length_col, pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind))
                yield part

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    return scan_documents(table(spark, sf_dir, "documents")).drop("masked_text")
