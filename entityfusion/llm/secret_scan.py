"""Secret scans with multipart credential linking.

*Strong* spans stand alone: an assignment to a secret-like name (``assign``), an access identifier (``access``), a
long run of hexadecimal digits (``hex``). *Weak* candidates mean little by themselves: identifiers (``id``), random
looking secrets (``key``), service endpoints (``endpoint``). The parts of one credential stand close together, so
weak candidates are joined with complementary parts by intervals within a scope: the same paragraph, at most ``reach``
code points apart. An identifier is reported if a secret is in scope, a secret if an identifier is in scope, an
endpoint if both are and are reported. Parts must stand beside each other: a token that looks like both is no pair. Strong
parts serve as partners: ``access`` as identifier, ``assign`` and ``hex`` as secrets. The interval join is a search in sorted
starts and ends, so it never pairs all parts of a text.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; a weak candidate that
overlaps a strong span gives way to it; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, small_batches

#: The strong kinds' patterns, over bytes (the first over lower-cased ones), and least lengths.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
STRONG = KINDS[:3]
#: Weak kinds: upper-case identifiers with digits, mixed-case secrets with digits, endpoints.
WEAK_ID = re.compile(rb"(?<![A-Za-z0-9])[A-Z0-9]{12,}+(?![A-Za-z0-9])")
WEAK_KEY = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(rb"(?:https?|s3|redis|amqp|mongodb|postgres(?:ql)?|mysql)://[^\s\"'<>]{4,}")
PARAGRAPH = re.compile(rb"\n[ \t\r]*\n")
#: A text without any of these can't hold a weak candidate's partner.
DIGIT, UPPER, LOWER = (re.compile(p) for p in (rb"[0-9]", rb"[A-Z]", rb"[a-z]"))


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def _mixed(token: bytes, least_digits: int) -> bool:
    return len(DIGIT.findall(token)) >= least_digits


def strong_spans(data: bytes) -> list[Span]:
    """Strong spans in byte positions; leftmost and non-overlapping per kind, those that fail their length dropped."""
    out = [Span(*m.span(), "assign") for m in ASSIGN.finditer(data.lower()) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        out += [Span(*m.span(), "access") for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_LEAST]
    out += [Span(*m.span(), "hex") for m in HEX.finditer(data)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def weak_spans(data: bytes, strong: list[Span]) -> list[Span]:
    """Weak candidates that overlap no strong span and no endpoint."""
    found = [Span(*m.span(), "endpoint") for m in ENDPOINT.finditer(data)] if b"://" in data else []
    taken = Cover(strong + found)
    for m in WEAK_ID.finditer(data):
        if _mixed(m[0], 2) and len(UPPER.findall(m[0])) >= 4:
            found.append(Span(*m.span(), "id"))
    for m in WEAK_KEY.finditer(data):
        if _mixed(m[0], 3) and UPPER.search(m[0]) and LOWER.search(m[0]):
            found.append(Span(*m.span(), "key"))
    held = Cover(strong)
    return [s for s in found if not (held if s.kind == "endpoint" else taken).meets(s.start, s.end)]


class Cover:
    """Sorted intervals for interval joins."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts, self.ends = [s.start for s in spans], sorted(s.end for s in spans)
        self.reach = list(accumulate((s.end for s in spans), max))

    def meets(self, low: int, high: int) -> bool:
        """Does any share a place with [low, high)?"""
        i = bisect_left(self.starts, high)
        return i > 0 and self.reach[i - 1] > low

    def beside(self, low: int, span: Span, high: int) -> bool:
        """Does any share a place with [low, high) and none with the span?"""
        return bisect_right(self.ends, span.start) > bisect_right(self.ends, low) or bisect_left(self.starts, high) > bisect_left(self.starts, span.end)


def linked(end: int, breaks: list[int], strong: list[Span], weak: list[Span], reach: int) -> list[Span]:
    """The weak candidates whose complementary parts stand in their scope, beside them; all positions in code points, the text's
    ``end`` too. Endpoints need an identifier and a secret that are reported themselves."""
    if not weak:
        return []

    def scope(s: Span) -> tuple[int, int]:
        i = bisect_right(breaks, s.start)
        low, high = breaks[i - 1] if i else 0, breaks[i] if i < len(breaks) else end
        return max(low, s.start - reach), min(high, s.end + reach)

    def having(found: list[Span], needs: dict[str, str]) -> list[Span]:
        """The weak spans of the kinds of ``needs`` that stand beside parts of all kinds that they need."""
        parts = {"id": Cover([s for s in strong if s.kind == "access"] + [s for s in found if s.kind == "id"]), "key": Cover([s for s in strong if s.kind in ("assign", "hex")] + [s for s in found if s.kind == "key"])}
        at = lambda s: (scope(s)[0], s, scope(s)[1])
        return [s for s in weak if s.kind in needs and all(parts[n].beside(*at(s)) for n in needs[s.kind].split())]

    pairs = having(weak, {"id": "key", "key": "id"})
    return pairs + having(pairs, {"endpoint": "id key"})


def scan(text: str, reach: int) -> tuple[list[Span], list[Span]]:
    """Strong spans, and all spans, of a text, in code points."""
    data = text.encode("utf-8")
    strong = strong_spans(data)
    weak = weak_spans(data, strong)
    breaks = [m.start() for m in PARAGRAPH.finditer(data)] if weak else []
    if (strong or weak) and len(data) != len(text):
        at = in_code_points(data, [p for s in strong + weak for p in (s.start, s.end)] + breaks)
        strong, weak = ([Span(at[s.start], at[s.end], s.kind) for s in spans] for spans in (strong, weak))
        breaks = [at[p] for p in breaks]
    every = sorted(strong + linked(len(text), breaks, strong, weak, reach), key=lambda s: (s.start, KINDS.index(s.kind)))
    return [s for s in every if s.kind in STRONG], every


def in_code_points(data: bytes, places: list[int]) -> dict[int, int]:
    """Byte position -> code points before it."""
    out, last, n = {}, 0, 0
    for p in sorted(set(places)):
        n += len(data[last:p].decode("utf-8"))
        last = p
        out[p] = n
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each covered stretch replaced by the name of its first kind."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out.append(f"{text[at : s.start]}[{s.kind.upper()}]")
        at = max(at, s.end)
    return "".join(out) + text[at:]


def find_secrets(df: DataFrame, text: str = "text", reach: int = 256, redact: bool = False) -> DataFrame:
    """df with ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans`` (``kind:start:end`` joined by commas); with
    ``redact``, the text column has its spans replaced. Input columns of these names give way."""
    small_batches(df.sparkSession)
    df = df.drop("n_assign", "n_access", "n_hex", "base", "spans")
    names = df.columns
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)

    def make():
        def step(batch):
            counts, base, spans, texts = {k: [] for k in STRONG}, [], [], []
            for value in batch.column(text):
                whole = value.as_py()
                strong, every = scan(whole or "", reach)
                for k in STRONG:
                    counts[k].append(sum(s.kind == k for s in strong))
                base.append(joined(strong))
                spans.append(joined(every))
                if redact:
                    texts.append(redacted(whole, every) if every else whole)
            columns = [pa.array(texts, pa.string()) if redact and c == text else batch.column(c) for c in names]
            more = [*(pa.array(counts[k], pa.int64()) for k in STRONG), pa.array(base, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*names, *(f"n_{k}" for k in STRONG), "base", "spans"])

        return step

    return by_batch(df, make, f"{head}n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its texts' spans replaced; all other columns, whatever their names, stay as they are."""
    inner = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return find_secrets(inner, text=f"c{df.columns.index(text)}", redact=True).select(*inner.columns).toDF(*df.columns)


def op10_secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = find_secrets(documents.select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
