"""Secret scans with multipart credential linking.

Strong forms (assignments, access identifiers, hex keys) are reported wherever they stand. Weak parts — something
like an access identifier, something like a secret, an endpoint — are each too common to report. They are joined as
intervals inside scopes (a paragraph, and at most ``reach`` characters between them), and reported only where an identifier
and a secret complement each other; endpoints within reach of such a pair are reported with it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed forms of the strong kinds, in the order that breaks ties.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
HINTS = ("passw", "secret", "token", "apikey", "api_key")

# Weak parts: an identifier named as one or a short upper-case key; a value named as a key, or a mixed random run.
WEAK_ACCESS = re.compile(r"\b(?:(?:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}|A[KS]IA[A-Z0-9]{8,})", re.I | re.A)
WEAK_SECRET = re.compile(r"\b(?:(?:pass|pwd|pin|private_?key|key|credential)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{4,}|(?P<run>[A-Za-z0-9+/]{32,})={0,2})", re.A)
MIXED = tuple(re.compile(c) for c in ("[0-9]", "[A-Z]", "[a-z]"))
NAMES = re.compile(r"\b(?:pass|pwd|pin|private|key|credential)", re.A)  # where a named value may begin in a run
ENDPOINT = re.compile(r"\b(?:(?:https?|ftp|s3|jdbc:\w+|redis|mongodb|postgres(?:ql)?|mysql|amqp|ssh)://[^\x20\x09-\x0D\"'<>]+|(?:endpoint|host|server|url|region)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.:/-]{4,})", re.I | re.A)
BREAK = re.compile(r"\n[\x20\t\r]*\n")
SPANS = "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the strong forms: leftmost and non-overlapping within each kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def weak_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the weak secrets, leftmost and non-overlapping. A run counts if it has a digit, a
    capital and a small letter anywhere; in one that does not, a named value may begin."""
    out, at = [], 0
    while m := WEAK_SECRET.search(text, at):
        at = m.end()
        if m["run"] and not all(c.search(m["run"]) for c in MIXED):
            at = m.end("run")
            inner = (WEAK_SECRET.match(text, k.start()) for k in NAMES.finditer(text, m.start(), at))
            m = next((x for x in inner if x and not x["run"]), None)
            if not m:
                continue
            at = m.end()
        out.append((*m.span(), 4))
    return out


def weak_spans(text: str, strong: list[tuple[int, int, int]], reach: int = 400) -> list[tuple[int, int, int]]:
    """Weak parts that complement each other. A strong assignment or hex key is a secret for a weak identifier, a
    strong access identifier is one for a weak secret; a weak part inside a strong span of its role adds nothing."""
    ids = [(*m.span(), 3) for m in WEAK_ACCESS.finditer(text)]
    keys = weak_secrets(text)
    ids = [x for x in ids if not _inside(x, [s for s in strong if s[2] == 1])]
    keys = [x for x in keys if not _inside(x, [s for s in strong if s[2] != 1])]
    every_id, every_key = sorted(ids + [s for s in strong if s[2] == 1]), sorted(keys + [s for s in strong if s[2] != 1])
    if not (ids and every_key or keys and every_id):
        return []
    breaks = [m.start() for m in BREAK.finditer(text)]
    id_hits, key_hits = _linked(ids, every_key, breaks, reach), _linked(keys, every_id, breaks, reach)
    ends = [(*m.span(), 5) for m in ENDPOINT.finditer(text)]
    pairs = sorted(id_hits + key_hits)
    return id_hits + key_hits + _linked(ends, pairs, breaks, reach)


def _inside(x: tuple, spans: list[tuple]) -> bool:
    return any(a <= x[0] and x[1] <= b for a, b, _ in spans)


def _linked(left: list[tuple], right: list[tuple], breaks: list[int], reach: int) -> list[tuple]:
    """Of ``left``, the intervals with one of ``right`` (sorted) in the same scope, not overlapping it. The gap goes
    from the end of the earlier to the start of the later one."""
    starts, out = [s for s, _, _ in right], []
    longest = max((b - a for a, b, _ in right), default=0)
    for span in left:
        k = bisect_left(breaks, span[0])
        low, high = breaks[k - 1] if k else 0, breaks[k] if k < len(breaks) else span[1] + reach
        near = right[bisect_left(starts, max(low, span[0] - reach - longest)) : bisect_right(starts, min(high, span[1] + reach))]
        if any(span[0] - reach <= b <= span[0] or a >= span[1] for a, b, _ in near):
            out.append(span)
    return out


def scan_text(text: str, reach: int = 400) -> list[tuple[int, int, int]]:
    strong = base_spans(text)
    return sorted(strong + weak_spans(text, strong, reach), key=lambda s: (s[0], s[2], s[1]))


def scan(docs: DataFrame, reach: int = 400) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its spans (kind, start, end in code points, end exclusive), by start, then
    kind. Null or empty text has none; rows that repeat are scanned each; further columns are not read; an empty
    table gives no rows. Every row stays on its own, so common texts and keys cost no more than their rows."""

    def make():
        def step(batch):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan_text(t, reach)] for t in common.texts_of(batch)]
            return {"doc_id": batch.column("doc_id"), "spans": found}

        return step

    return common.map_batches(common.pick(docs, "doc_id", "text"), make, SPANS)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: DataFrame) -> DataFrame:
    """Counts and digests of ``scan``'s rows, one each: rows that repeat stay, an empty table gives none, and a row
    without spans (null or empty text) has counts 0, the digest of the empty string and an empty ``spans``."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_text(text: str, mark: str = "[SECRET]", reach: int = 400) -> str:
    """The text with every run of overlapping spans replaced by ``mark``; endpoints stay."""
    out, at = [], 0
    for a, b, kind in scan_text(text, reach):
        if kind == 5 or b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, reach: int = 400) -> DataFrame:
    """``docs`` with secrets cut out of ``text`` and ``n_chars`` counted anew where the text changed; every other
    column and row stays. Null text stays null."""
    schema = docs.schema
    has_chars = "n_chars" in docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in common.pieces(batch):
                old = part.column("text").to_pylist()
                new = [None if t is None else redact_text(t, reach=reach) for t in old]
                cols = {name: part.column(name) for name in part.schema.names}
                cols["text"] = pa.array(new, part.schema.field("text").type)
                if has_chars:
                    kept = part.column("n_chars").to_pylist()
                    cols["n_chars"] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, old, new)], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), schema=part.schema)

    return docs.mapInArrow(run, schema)
