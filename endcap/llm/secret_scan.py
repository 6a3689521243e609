"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

The base patterns are kept as they are found. Beyond them, candidates are strings of
secret-like letters near a sensitive word on either side; of ``name=value`` both parts are
candidates by themselves. A candidate's novelty is the number of bytes
that it adds to the compressed size of the text around it, with a zstandard dictionary
of code and identifiers as history: names and words are almost free,
random strings cost about their entropy. Incompressible candidates are reported. A value
that is reported in a document is reported wherever else it stands in that document.

Defined cases: null text is empty; rows are scanned each by itself whatever their other
columns hold, so null and repeated ``doc_id`` are kept. Offsets count code points.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" for c in w)
                   for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"(?:{_EITHER}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Letters that a candidate has at least.
LEAST = 8
#: Letters below which capitalised or joined words without digits are names, not values.
WORDS_BELOW = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
CONTEXT = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|auth|bearer|"
                     r"credential|private|signature|\bkey\b", re.I | re.A)
#: Letters of text on either side of a candidate in which a sensitive word counts.
NEAR = 48
#: Letters of text on either side of a candidate that are its history.
AROUND = 256
#: Added compressed bytes per letter from which a string counts as incompressible; random
#: letters and digits take about 0.75.
NOVELTY = 0.6
#: Code and identifiers that surround values, as history for the compressor.
IDENTIFIERS = """
import os import sys from typing import Optional def get_config(self, name): return self.config[name]
const client = new Client({ apiKey: process.env.API_KEY, secret: process.env.CLIENT_SECRET });
public static final String ACCESS_TOKEN = System.getenv("ACCESS_TOKEN"); private String password;
export DATABASE_URL=postgres://user:password@localhost:5432/database AWS_ACCESS_KEY_ID
AWS_SECRET_ACCESS_KEY authorization: Bearer Content-Type: application/json client_id client_secret
refresh_token access_token id_token session_token private_key public_key api_key api_token secret_key
username password passphrase credentials signature certificate BEGIN RSA PRIVATE KEY END
placeholder example changeme your_api_key_here XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX 0123456789abcdef
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 function return configuration
application production development environment settings initialize connection repository
"""


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    text: str
    novelty: float | None


class Meter:
    """Marginal compressed size behind a dictionary of raw history."""

    def __init__(self, words: str = IDENTIFIERS) -> None:
        history = zstandard.ZstdCompressionDict(words.encode(),
                                                dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=19, dict_data=history, write_checksum=False,
                                              write_content_size=False, write_dict_id=False)

    def novelty(self, before: str, value: str) -> float:
        """Compressed bytes that ``value`` adds behind ``before``, per byte of it."""
        a, b = before.encode("utf-8", "replace"), value.encode("utf-8", "replace")
        return (len(self.press.compress(a + b)) - len(self.press.compress(a))) / max(1, len(b))


_HINTS = (b"passw", b"secret", b"token", b"api")


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, kind by kind, by start and then kind."""
    out: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()          # ASCII letters only
    if any(h in low for h in _HINTS):
        out += [Span("assign", m.start(), m.end(), m[0], None) for m in ASSIGN.finditer(text)
                if len(m[1]) >= 8]
    if b"akia" in low:
        out += [Span("access", m.start(), m.end(), m[0], None) for m in ACCESS.finditer(text)
                if len(m[0]) >= 16]
    out += [Span("hex", m.start(), m.end(), m[0], None) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


PIECE = re.compile(r"[^=]+=*")
_JOINT = re.compile(r"[_/+-]+|(?<=[a-z0-9])(?=[A-Z][a-z])")
_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|")
_NAME = re.compile(r"(?:[A-Za-z]?[a-z]*|[A-Z]+)[0-9]{0,4}(?:[a-z]{2,}|[A-Z]{2,})?")


def _mixed_letters(s: str) -> bool:
    low, up = s != s.upper(), s != s.lower()
    return (low and up) or ((low or up) and any(c.isdigit() for c in s))


def _joined(s: str, part: re.Pattern) -> bool:
    return all(part.fullmatch(x) for x in _JOINT.split(s))


def _is_name(s: str) -> bool:
    """Whether the string is words joined to a name, of three letters a word on average."""
    runs = [r for x in _JOINT.split(s) for r in re.findall("[A-Za-z]+", x)]
    return _joined(s, _NAME) and sum(map(len, runs)) >= 3 * len(runs)


def _pieces(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is the name of a following value) of candidates, parted at '='."""
    out = []
    for m in CANDIDATE.finditer(text):
        if "=" not in m[0]:
            if _mixed_letters(m[0]):
                out.append((*m.span(), False))
            continue
        for p in PIECE.finditer(m[0]):
            name = p.end() < len(m[0])
            value = p[0].rstrip("=") if name else p[0]
            if len(value) >= LEAST and _mixed_letters(value):
                out.append((m.start() + p.start(), m.start() + p.start() + len(value), name))
    return out


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spaces in place of the spans, so that offsets stay."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out += [text[at:max(at, start)], " " * (end - max(at, start))]
            at = end
    return "".join([*out, text[at:]])


class _Words(NamedTuple):
    """Places of the sensitive words of a text."""

    starts: list[int]
    ends: list[int]

    @classmethod
    def of(cls, text: str) -> _Words:
        found = [m.span() for m in CONTEXT.finditer(text)]
        return cls([a for a, _ in found], [b for _, b in found])

    def near(self, start: int, end: int) -> bool:
        """Whether a word overlaps the span or stands close on either side."""
        k = bisect.bisect_left(self.ends, start - NEAR)
        return k < len(self.ends) and self.starts[k] <= end + NEAR

    def last_inside(self, start: int, end: int) -> tuple[int, int] | None:
        k = bisect.bisect_right(self.ends, end) - 1
        return (self.starts[k], self.ends[k]) if k >= 0 and self.starts[k] >= start else None


def _value_starts(text: str, start: int, end: int, words: _Words) -> list[int]:
    """Where a value may start: behind a name with a sensitive word, if that is one surely."""
    word = words.last_inside(start, end)
    if word is None:
        return [start]
    at, behind = word
    edge = (at == start or not text[at - 1].isalpha()
            or (text[at - 1].islower() and text[at].isupper()))
    return [behind] if edge and _is_name(text[start:behind]) else [start, behind]


def novel_spans(text: str, base: list[Span], meter: Meter, threshold: float = NOVELTY
                ) -> list[Span]:
    """Incompressible strings in a sensitive context that no base span touches.

    Base spans and candidates, near a sensitive word or not, are no history: a value that
    stands twice does not become compressible by its other occurrence.
    """
    words = _Words.of(text)
    found = _pieces(text) if words.ends else []
    if not found:
        return []
    spans = [(b.start, b.end) for b in base]
    history = _blank(text, [*((a, b) for a, b, _ in found), *spans])
    taken = bytearray(len(text))
    for a, b in spans:
        taken[a:b] = b"\1" * (b - a)
    out = []
    for first, end, name in found:
        if not words.near(first, end) or 1 in taken[first:end] or (
                name and _is_name(text[first:end])):
            continue
        for start in _value_starts(text, first, end, words):
            value = text[start:end]
            if len(value) < LEAST or not _mixed_letters(value) or (
                    len(value) < WORDS_BELOW and _joined(value, _WORD)):
                continue
            n = meter.novelty(history[end:end + AROUND] + history[max(0, start - AROUND):start],
                              value)
            if n >= threshold:
                out.append(Span("novel", start, end, value, n))
                break
    return out


def repeated_spans(text: str, spans: list[Span]) -> list[Span]:
    """Other occurrences of the values of ``spans``, as novel spans.

    Values of a fixed name=value pattern may be plain words: those without mixed letters
    count as whole strings near a sensitive word only, all other values everywhere.
    """
    values: dict[str, float | None] = {}
    for s in spans:
        m = ASSIGN.fullmatch(s.text) if s.kind == "assign" else None
        values.setdefault(m[1] if m else s.text, s.novelty)
    if not values:
        return []
    covered = bytearray(len(text))
    for s in spans:
        covered[s.start:s.end] = b"\1" * (s.end - s.start)
    words = _Words.of(text)
    sure = {s.text for s in spans if s.kind != "assign"}
    out = []
    for value in sorted(values, key=lambda v: (-len(v), v)):
        plain, n = value not in sure and not _mixed_letters(value), len(value)
        at = text.find(value)
        while at >= 0:
            whole = not (_is_letter(text[at - 1:at]) or _is_letter(text[at + n:at + n + 1]))
            if 0 in covered[at:at + n] and (not plain or (whole and words.near(at, at + n))):
                out.append(Span("novel", at, at + n, value, values[value]))
                covered[at:at + n] = b"\1" * n
                at = text.find(value, at + n)
            else:
                at = text.find(value, at + 1)
    return out


def _is_letter(c: str) -> bool:
    return c.isalnum() or (c != "" and c in "+/_=-")


def scan_text(text: str | None, meter: Meter, threshold: float = NOVELTY) -> list[Span]:
    text = text or ""
    spans = base_spans(text)
    spans = spans + novel_spans(text, spans, meter, threshold)
    spans += repeated_spans(text, spans)
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, threshold: float = NOVELTY, identifiers: str = IDENTIFIERS,
         with_text: bool = True) -> DataFrame:
    """doc_id, counts by kind, and the spans with their text and novelty, one row per row."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("text", pa.string()), ("novelty", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(identifiers)
        for b in batches:
            found = [scan_text(x.as_py(), meter, threshold) for x in b.column(1)]
            counts = [pa.array([sum(s.kind == k for s in f) for f in found], pa.int64())
                      for k in KINDS[:3]]
            base = [listed([s for s in f if s.kind != "novel"]) for f in found]
            sha = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base])
            rows = [[s._replace(text=s.text if with_text else None)._asdict() for s in f]
                    for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, sha, pa.array([listed(f) for f in found]),
                 pa.array(rows, pa.list_(kind))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    span = "struct<kind:string,start:long,end:long,text:string,novelty:double>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
             f"spans string, found array<{span}>")


def masked(text: str | None, meter: Meter, threshold: float = NOVELTY) -> str | None:
    """The text with every span replaced by the name of its kind."""
    if text is None:
        return None
    out, at = [], 0
    for s in scan_text(text, meter, threshold):
        if s.end <= at:
            continue
        out += [text[at:max(at, s.start)], f"<{s.kind}>"]
        at = s.end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """The documents with masked texts and renewed ``n_chars``; all rows stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter()
        for b in batches:
            at = b.schema.get_field_index("text")
            text = pa.array([masked(x.as_py(), meter, threshold) for x in b.column(at)], pa.string())
            yield b.set_column(at, b.schema.field(at).with_type(pa.string()), text)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*names)
    return out
