"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for other candidates.

A candidate is a run of 16 or more token characters within CONTEXT characters after any sensitive
word or NEAR characters before one, or what follows such a word and its separators in a run. Its novelty is the
number of bytes by which it lengthens the zstandard frame of the text around it, the compressor being
primed with a dictionary of code identifiers and plain words. The secrets that a pattern took are measured
alike; their spans stay. Any other candidate that costs at least NOVEL_SHARE of its own bytes is incompressible
there and is reported as kind novel. Long words are as costly in short
texts: a candidate without digits that consists of pronounceable words passes for a name.

Defined results: null and empty texts have no spans; very long texts are scanned whole, in linear time but for what is
compressed; repeated rows get equal spans; an empty table gives no rows; columns other than those named are ignored,
whatever their names and types. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType

from ioloom.llm.base import mapped_in_place

# What a pattern must match, and how long it must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "novel")

#: Words, in lower case, after which a long odd string is suspect.
SENSITIVE = (b"auth", b"bearer", b"credential", b"key", b"passphrase", b"passwd", b"password", b"private", b"pwd", b"secret", b"session", b"signature", b"token")
SENSITIVE_WORD = re.compile("|".join(w.decode() for w in SENSITIVE), re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SEPARATORS = re.compile(r"[+/_=-]*")
MIN_CANDIDATE, CONTEXT, NEAR, NOVEL_SHARE = 16, 48, 24, 0.65
#: The words of a name in camel or snake case, their mean length at least, and what they hardly contain.
WORD, WORD_LENGTH, HARD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), 3.5, re.compile(r"[b-df-hj-np-tv-xz]{5}", re.IGNORECASE)

#: Primes the compressor: identifiers and words that are common beside secrets but aren't secret.
DICTIONARY = (
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 aaaaaaaa xxxxxxxx XXXXXXXX your_api_key_here YOUR_SECRET_KEY changeme example placeholder "
    "https://www.example.com/index.html http://localhost:8080/api/v1/users application/json Content-Type charset=utf-8 "
    "import from return class function public static void const string number boolean undefined null true false self this "
    "authorization authentication authenticate authenticator credentials private_key public_key access_key secret_key session_id session_token "
    "client_id client_secret refresh_token access_token bearer_token password_hash username user_name configuration environment parameter "
    "getElementById addEventListener toString hashCode equals valueOf created_at updated_at description version identifier timestamp "
    "signature certificate keyboard keyword monkey primary_key foreign_key partition_key sort_key key_value public_key_fingerprint 2020-01-01T00:00:00Z"
)


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(DICTIONARY.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)


def novelty(before: str, candidate: str, after: str = "") -> int:
    """Bytes by which candidate lengthens the frame of the text around it."""
    compress = _compressor().compress
    around = (before + after).encode()
    return len(compress(around + candidate.encode())) - len(compress(around))


def wordlike(candidate: str) -> bool:
    """Whether a candidate without digits consists of pronounceable words."""
    words = WORD.findall(candidate)
    return bool(words) and sum(map(len, words)) >= WORD_LENGTH * len(words) and not any(HARD.search(w) for w in words)


def _marginal(text: str, start: int, end: int) -> int:
    """The novelty of text[start:end] where it stands."""
    return novelty(text[max(0, start - 2 * CONTEXT) : start], text[start:end], text[end : end + CONTEXT])


def _pattern_spans(text: str, raw: bytes, low: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, where the secret itself begins) of the fixed patterns, by start, then kind."""
    found = []
    if b"=" in raw or b":" in raw:
        if any(w in low for w in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
            found += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def scanned(text: str, raw: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
    """Spans (start, end, kind), by start, then kind in the order of KINDS; and each candidate that was measured,
    as (start, end, marginal bytes). raw is the text's UTF-8."""
    low = raw.lower()
    base = _pattern_spans(text, raw, low)
    measured = [(s, b, _marginal(text, s, b)) for _, b, _, s in base if b - s >= MIN_CANDIDATE]
    novel = []
    if any(w in low for w in SENSITIVE):
        # Whether a span overlaps a pattern's: the last pattern to begin before its end, and how far any so far reaches.
        begins, reach = [x[0] for x in base], list(accumulate((x[1] for x in base), max))
        words = [m.span() for m in SENSITIVE_WORD.finditer(text)]
        firsts, ends = [a for a, _ in words], [b for _, b in words]
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            # The sensitive word stands before the run, after it, or in it (as in key_3f...): of those in it the first is
            # tried, which leaves nothing out, and the last, which leaves most names out.
            before, after = bisect_right(ends, a) - 1, bisect_left(firsts, b)
            around = before >= 0 and a - ends[before] <= CONTEXT or after < len(firsts) and firsts[after] - b <= NEAR
            inside = ends[before + 1 : bisect_right(ends, b)]
            roomy = [x for e in inside if b - (x := SEPARATORS.match(text, e, b).end()) >= MIN_CANDIDATE]
            for start in [*([a] if around else []), *roomy[:1], *roomy[-1:]]:
                k = bisect_left(begins, b) - 1
                if k >= 0 and reach[k] > start:
                    continue
                word, cost = text[start:b], _marginal(text, start, b)
                measured.append((start, b, cost))
                if (any(c.isdigit() for c in word) or not wordlike(word)) and cost >= NOVEL_SHARE * len(word):
                    novel.append((start, b, 3))
                    break
    spans = sorted([*((a, b, k) for a, b, k, _ in base), *novel], key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in spans], sorted(set(measured))


def spans_of(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    return scanned(text, raw)[0]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with every union of overlapping spans replaced by one mark."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += text[done:a], f"[{kind} removed]"
        done = max(done, b)
    return "".join(out) + text[done:]


def _scan(batches):
    for batch in batches:
        column = batch.column(1).fill_null("")
        both = [scanned(t, r) for t, r in zip(column.to_pylist(), column.cast(pa.binary()).to_pylist(), strict=True)]
        found = [f for f, _ in both]
        counts = [pa.array([sum(k == kind for _, _, k in f) for f in found], pa.int64()) for kind in KINDS]
        sha = [hashlib.sha256(listed([s for s in f if s[2] != "novel"]).encode()).hexdigest() for f in found]
        measured = [",".join(f"{a}:{b}:{n}" for a, b, n in m) for _, m in both]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), *[pa.array(c, pa.string()) for c in ([listed(f) for f in found], measured)]], names=[batch.schema.names[0], *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "measured"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, measured (start:end:marginal bytes of each candidate) for every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_scan, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string, measured string")


def _redact(batches, text_at: int, count_at: int | None):
    for batch in batches:
        columns, column = list(batch.columns), batch.column(text_at)
        old = column.to_pylist()
        new = [t if t is None else redacted(t, spans_of(t, r)) for t, r in zip(old, column.cast(pa.binary()).to_pylist(), strict=True)]
        columns[text_at] = pa.array(new, column.type)
        if count_at is not None:
            counts = columns[count_at]
            columns[count_at] = pa.array([n if t == o else len(t) for t, o, n in zip(new, old, counts.to_pylist(), strict=True)], counts.type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redact_secrets(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with secrets replaced in text, and count_col, if it is a column of whole numbers, recounted where the text changed."""
    counted = count_col in docs.columns and isinstance(docs.schema[count_col].dataType, IntegerType | LongType)
    at = docs.columns.index(text_col), docs.columns.index(count_col) if counted else None
    return mapped_in_place(docs, lambda batches: _redact(batches, *at))
