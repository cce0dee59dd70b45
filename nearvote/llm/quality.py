"""Quality rules from tokeniser fertility.

Two public vocabularies read each whole text: one of word pieces with byte fallback, one of bytes. For each, three
measures: characters per token, the share of tokens that are a lone byte (white space left out), and the entropy of
the tokens in bits. They are held against rejection bands per script. A band is a mean with a width, and both follow
the number of tokens n, as short texts scatter more and have less entropy: mean = a + b log2 n + c (log2 n)**2 (only
entropy has b and c), variance = v + w / n. A text is rejected if a measure lies more than ``limit`` widths off its
mean; a share of bytes below its mean is no fault.

Bands are calibrated on all documents labelled good, per script; a script with fewer than ``least_rows`` such
documents keeps the wide bands of BANDS.
"""

from __future__ import annotations

import base64
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import _single

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
ROWS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, script string, " + ", ".join(f"{v}_tokens bigint, " + ", ".join(f"{v}_{m} double" for m in MEASURES) for v in ("piece", "byte"))
MEASURED = ROWS.replace("kept boolean, ", "")


@dataclass(frozen=True)
class Wide:
    """Bands of a script without calibration, for both vocabularies: characters per token, most bytes, and entropy as
    a share of what as many different tokens have."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


BANDS = {
    "latin": Wide(1.4, 8.0, 0.45, 0.35),
    "cyrillic": Wide(0.8, 6.0, 0.50, 0.35),
    "greek": Wide(0.5, 5.0, 0.80, 0.35),
    "cjk": Wide(0.25, 3.0, 1.0, 0.30),
    "other": Wide(0.2, 8.0, 1.0, 0.30),
}


@dataclass(frozen=True)
class Fit:
    """Mean and variance of a measure over n tokens."""

    mean: tuple[float, ...]
    v: float
    w: float

    def off(self, value: float, n: int) -> float:
        """Widths above the mean."""
        x = np.log2(max(n, 2))
        return float((value - sum(c * x**k for k, c in enumerate(self.mean))) / np.sqrt(self.v + self.w / max(n, 2)))


MIDDLE = 9  # of log2 n: powers of the distance from it make well-conditioned sums


def _solve(table: list[list[float]], right: list[float]) -> np.ndarray:
    return np.linalg.lstsq(np.array(table, np.float64), np.array(right, np.float64), rcond=None)[0]


def _sum(x: Column) -> Column:
    """Exact in any order: each term has twelve decimals."""
    return F.sum(x.cast("decimal(28,12)"))


# First code point, end and script of letters; anything else that is a letter is "other".
SCRIPTS = (
    (0x41, 0x250, "latin"),
    (0x1E00, 0x1F00, "latin"),
    (0x370, 0x400, "greek"),
    (0x400, 0x530, "cyrillic"),
    (0x3040, 0x3100, "cjk"),
    (0x3400, 0xA000, "cjk"),
    (0xAC00, 0xD7B0, "cjk"),
)


def script_of(text: str) -> str:
    """The script of most letters; ties go to the one listed first, no letter at all to "latin"."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    counts: dict[str, int] = {"latin": 0}
    wide = codes[codes >= 0x41]
    for low, high, name in SCRIPTS:
        counts[name] = counts.get(name, 0) + int(np.count_nonzero((wide >= low) & (wide < high)))
    counts["latin"] -= int(np.count_nonzero(((wide > 0x5A) & (wide < 0x61)) | ((wide > 0x7A) & (wide < 0xC0))))
    rest = sum(1 for c in map(chr, np.unique(wide[wide >= 0x250]).tolist()) if c.isalpha()) and len(wide) - sum(counts.values())
    counts["other"] = max(0, rest)
    return max(counts, key=counts.get)


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found twice or more, the first one included.
    Windows are named by doubling: equal names of halves make equal names of wholes, so no hash can mislead."""
    n = len(words)
    if n <= window:
        return 0
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(ids) == n:
        return 0
    codes = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    width = 1
    while width < window:
        top = int(codes.max()) + 1
        codes = codes[:-width] * top + codes[width:]
        values, codes = np.unique(codes, return_inverse=True)
        if len(values) == len(codes):
            return 0
        width *= 2
    twice = np.bincount(codes)[codes] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, repeated words."""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


class Fertility:
    """Token ids of whole texts by both vocabularies, each distinct chunk encoded once.

    The piece vocabulary's white-space mark only begins pieces (or stands in runs of itself) and a line feed is a byte
    of its own, so where white space is lone spaces and line feeds between other characters, the ids of a text are
    those of its chunks: the word after each space with its mark, and the word after each line feed without one. The
    byte vocabulary cuts there too (see ``tokens``). Any other text is encoded whole."""

    def __init__(self, piece_path: str, byte_path: str, pattern: str, cache_entries: int = 300_000):
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = self.piece.get_piece_size()
        self.first = size  # ids of the byte vocabulary come behind the other's
        self.lone = np.zeros(size + max(ranks.values()) + 1, bool)
        self.lone[:size] = [self.piece.is_byte(k) for k in range(size)]
        blank = [ord(c) for c in SPACE]
        self.lone[[self.piece.piece_to_id(f"<0x{b:02X}>") for b in blank]] = False
        self.lone[[size + r for b, r in ranks.items() if len(b) == 1 and b[0] not in blank]] = True
        names = list(map(self.piece.id_to_piece, range(size)))
        feed = self.piece.encode("\na")
        self.by_chunk = not any("▁" in p.lstrip("▁") or "\n" in p for p in names) and names[feed[0]] == "▁" and names[feed[1]] == "<0x0A>"
        self.limit, self.known, self.old = cache_entries, {}, {}

    def _joint(self, pieces: list[int], byte_ids: list[int]) -> bytes:
        return array("I", pieces).tobytes() + array("I", map(self.first.__add__, byte_ids)).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Ids of chunks: words behind a space; behind a line feed if they begin with one, at a text's start if with a
        tab."""
        low = self.bytes._core_bpe.encode_ordinary
        for w, pieces in zip(new, self.piece.encode([w.removeprefix("\t") for w in new], num_threads=1)):
            if w[:1] == "\n":
                self.known[w] = self._joint(pieces[1:], low(w))
            else:
                self.known[w] = self._joint(pieces, low(w[1:] if w[:1] == "\t" else " " + w))

    def ids(self, texts: list[str], group: int = 256) -> list[np.ndarray]:
        """Per text the ids of both vocabularies, in no particular order."""
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        known, old, out = self.known, self.old, []
        for at in range(0, len(texts), group):
            cut = [("\t" + t.replace("\n", " \n")).split(" ") if self.by_chunk and _single(t) else None for t in texts[at : at + group]]
            fresh = set().union(*filter(None, cut)).difference(known)
            if old:
                known.update((w, old[w]) for w in fresh.intersection(old))
                fresh.difference_update(old)
            self._learn(list(fresh))
            for text, chunks in zip(texts[at : at + group], cut):
                raw = self._joint(self.piece.encode(text), self.bytes.encode_ordinary(text)) if chunks is None else b"".join(map(known.__getitem__, chunks))
                out.append(np.frombuffer(raw, "<u4"))
            for w in fresh:
                if len(w) > 80:  # long words are not kept
                    del known[w]
        return out

    def measure(self, text: str, ids: np.ndarray) -> list[float]:
        """Tokens, characters per token, byte share and entropy, of each vocabulary."""
        ranked = np.sort(ids)
        edge = np.flatnonzero(np.diff(ranked, prepend=np.uint32(0xFFFFFFFF)))
        kinds, counts = ranked[edge], np.diff(edge, append=len(ranked))
        out: list[float] = []
        split = int(np.searchsorted(kinds, self.first))
        for part in (slice(0, split), slice(split, None)):
            c = counts[part]
            n = int(c.sum())
            if not n:
                out += [0, 0.0, 0.0, 0.0]
                continue
            share = float(c[self.lone[kinds[part]]].sum() / n)
            out += [n, len(text) / n, share, float(np.log2(n) - (c * np.log2(c)).sum() / n)]
        return out


def fertility(paths: tuple[str, str, str]) -> Fertility:
    return common.worker_state(("fertility", *paths), lambda: Fertility(*paths))


def verdict(script: str, measures: list[float], bands: dict[str, list[Fit]], limit: float) -> bool:
    """``measures``: as ``Fertility.measure`` gives them."""
    for v in (0, 1):
        n, chars, share, entropy = measures[4 * v : 4 * v + 4]
        if script in bands:
            c, b, h = bands[script][3 * v : 3 * v + 3]
            if abs(c.off(chars, n)) > limit or b.off(share, n) > limit or abs(h.off(entropy, n)) > limit:
                return False
        else:
            wide = BANDS.get(script, BANDS["other"])
            if not (wide.least_chars <= chars <= wide.most_chars and share <= wide.most_bytes and entropy >= wide.least_entropy * np.log2(max(n, 2))):
                return False
    return True


def calibrate(docs: DataFrame, good: DataFrame, paths: tuple[str, str, str], least_rows: int = 100) -> dict[str, list[Fit]]:
    """``bands`` of ``docs`` (doc_id, text), each of which is encoded once; the measures are staged."""
    return bands(common.stage_table(measure(docs, paths), "quality")[0], good, least_rows)


def bands(measured: DataFrame, good: DataFrame, least_rows: int = 100) -> dict[str, list[Fit]]:
    """Bands per script from all rows of ``measured`` whose doc_id is in ``good``; texts that fail the base are left
    out. Weighted least squares from sums: rows count by their tokens for the mean, and evenly over lengths for the
    variance, neither part of which falls below a small floor. A row of sums a script, of which there are five, goes to
    the driver. Repeated ids in ``good`` count once, a null id never."""
    ids = good.select("doc_id").filter("doc_id is not null").distinct()
    rows = measured.filter("not base_failed").join(ids, "doc_id", "left_semi")
    kinds = [(v, m, 2 if m == "token_entropy" else 0) for v in ("piece", "byte") for m in MEASURES]
    tokens = {v: F.greatest(F.col(f"{v}_tokens"), F.lit(2)).cast("double") for v in ("piece", "byte")}
    place = {v: F.log2(n) - MIDDLE for v, n in tokens.items()}
    power = lambda x, k: F.lit(1.0) if k == 0 else x * power(x, k - 1)
    sums = [_sum(tokens[v] * power(place[v], k)).alias(f"{v}_{k}") for v in tokens for k in range(5)]
    sums += [_sum(tokens[v] * power(place[v], k) * F.col(f"{v}_{m}")).alias(f"{v}_{m}_{k}") for v, m, degree in kinds for k in range(degree + 1)]
    means: dict[str, list] = {}
    for r in rows.groupBy("script").agg(F.count("*").alias("rows"), *sums).collect():
        if r["rows"] >= least_rows:
            table = lambda v, d: [[float(r[f"{v}_{i + j}"]) for j in range(d + 1)] for i in range(d + 1)]
            means[r["script"]] = [_solve(table(v, d), [float(r[f"{v}_{m}_{k}"]) for k in range(d + 1)]).tolist() for v, m, d in kinds]
    if not means:
        return {}
    sums = [f(x).alias(f"{v}_{name}") for v, n in tokens.items() for name, f, x in (("n", _sum, n), ("inverse", _sum, 1 / n))]
    for k, (v, m, degree) in enumerate(kinds):
        mean = F.lit(None).cast("double")
        for script, found in means.items():
            line = sum((F.lit(c) * power(place[v], j) for j, c in enumerate(found[k])), F.lit(0.0))
            mean = F.when(F.col("script") == script, line).otherwise(mean)
        square = (F.col(f"{v}_{m}") - mean) * (F.col(f"{v}_{m}") - mean)
        sums += [_sum(tokens[v] * square).alias(f"{v}_{m}_n"), _sum(square).alias(f"{v}_{m}_1")]
    out = {}
    for r in rows.filter(F.col("script").isin(list(means))).groupBy("script").agg(F.count("*").alias("rows"), *sums).collect():
        fits = []
        for (v, m, degree), c in zip(kinds, means[r["script"]]):
            low, high = _solve([[float(r[f"{v}_n"]), r["rows"]], [r["rows"], float(r[f"{v}_inverse"])]], [float(r[f"{v}_{m}_n"]), float(r[f"{v}_{m}_1"])])
            if degree == 2:  # powers of log2 n itself
                c = [c[0] - MIDDLE * c[1] + MIDDLE**2 * c[2], c[1] - 2 * MIDDLE * c[2], c[2]]
            fits.append(Fit(tuple(c), max(float(low), 1e-6), max(float(high), 1e-6)))
        out[r["script"]] = fits
    return out


def _base_failed(counts: tuple) -> bool:
    return counts[0] < 20 or 100 * counts[4] > 30 * counts[0]


def measure(docs: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) what ``score`` gives, but for the verdict."""

    def make():
        made = fertility(paths)
        names = [f.split()[0] for f in MEASURED.split(", ")][1:]

        def step(batch):
            texts = common.texts_of(batch)
            rows = []
            for text, ids in zip(texts, made.ids(texts)):
                counts = base_counts(text)
                rows.append((*counts, _base_failed(counts), script_of(text), *made.measure(text, ids)))
            return {"doc_id": batch.column("doc_id"), **dict(zip(names, zip(*rows) if rows else [[]] * len(names)))}

        return step

    return common.map_batches(common.pick(docs, "doc_id", "text"), make, MEASURED, stateless=False)


def judge(measured: DataFrame, bands: dict[str, list[Fit]] | None = None, limit: float = 4.5) -> DataFrame:
    """Rows of ``measure`` with the verdict, ``kept``."""
    bands, names = bands or {}, [f.split()[0] for f in MEASURED.split(", ")]

    def make():
        def step(batch):
            cols = {n: batch.column(n) for n in names}
            values = zip(*(cols[n].to_pylist() for n in names[names.index("script") + 1 :]))
            rows = zip(cols["base_failed"].to_pylist(), cols["script"].to_pylist(), values)
            return {**cols, "kept": [not failed and verdict(script, x, bands, limit) for failed, script, x in rows]}

        return step

    return common.map_batches(measured, make, ROWS)


def score(docs: DataFrame, paths: tuple[str, str, str], bands: dict[str, list[Fit]] | None = None, limit: float = 4.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base counts, base_failed, kept, and the measures behind them. ``paths``: the
    piece vocabulary's file, the byte vocabulary's, and the latter's pattern. ``bands``: from ``calibrate``.

    Words are runs without ASCII white space. Null and empty texts have no words, fail the base and are not kept.
    Rows that repeat are scored each; further columns are not read; an empty table gives no rows. A row needs no
    other row, so nothing is shuffled.
    """
    return judge(measure(docs, paths), bands, limit)
