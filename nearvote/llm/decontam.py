"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are read in blocks of bounded size, a block's table of n-grams is broadcast, and each worker joins its
passages with it by sorted search. Every n-gram that a document shares with an item is a seed, however
common it is. The text around the seeds is aligned with the item, word by word, so edited copies score as well;
stretches whose words cannot reach the least score, in whatever order, are left out before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from . import common

WORD = re.compile(r"[^\W_]+")
ROWS = "doc_id bigint, item_id bigint, score double, n_seeds bigint, first_word bigint, end_word bigint"
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return WORD.findall(text.lower()) if text else []


def codes_of(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit names of the n-grams of word numbers (0: not a word of the block)."""
    size = len(ids) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + size].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out


class Items:
    """A block of test items: word numbers, and where each n-gram stands in which item."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.vocabulary = n, {}
        self.ids, self.words, names, codes, at = [], [], [], [], []
        for item, text in items:
            w = words_of(text)
            if not w:
                continue
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64)
            got = codes_of(ids, n)
            codes.append(got)
            names.append(np.full(len(got), len(self.ids)))
            at.append(np.arange(len(got)))
            self.ids.append(item)
            self.words.append(ids)
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        code, name, place = flat(codes, np.uint64), flat(names, np.int64), flat(at, np.int64)
        order = np.lexsort((place, name, code))
        self.name, self.place = name[order], place[order]
        self.grams, self.first = np.unique(code[order], return_index=True)
        self.last = np.append(self.first[1:], len(code))
        self.bytes = [w.tobytes() for w in self.words]
        self.short = [k for k, w in enumerate(self.words) if len(w) < n]  # too few words for a seed

    def numbers(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, w := words_of(text), [0] * len(w)), np.int64, len(w))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the document has n-grams of the block, and which."""
        if len(ids) < self.n or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        full = known[: len(ids) - self.n + 1].copy()
        for k in range(1, self.n):
            full &= known[k : len(ids) - self.n + 1 + k]
        at = np.flatnonzero(full)
        codes = codes_of(ids, self.n)[at]
        k = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        same = self.grams[k] == codes
        return at[same], k[same]

    def seeds(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Per item that shares an n-gram with the document: its number, and where in the document the item would
        start by each shared n-gram, in order."""
        at, gram = self.hits(ids)
        many = self.last[gram] - self.first[gram]
        x = np.arange(many.sum()) + np.repeat(self.first[gram] - np.cumsum(many) + many, many)
        start, name = np.repeat(at, many) - self.place[x], self.name[x]
        order = np.lexsort((start, name))
        start, name = start[order], name[order]
        cuts = np.flatnonzero(name[1:] != name[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(name)]):
            if a < b:
                yield int(name[a]), start[a:b]


def align(item: np.ndarray, text: np.ndarray, match: int = 2, miss: int = 1, gap: int = 1) -> tuple[int, int]:
    """Smith-Waterman over word numbers: the best local score, and the end of its stretch in ``text``. A row at a
    time; gaps along the row by a running maximum."""
    n = len(text)
    slope = gap * np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        step = row[:-1] + np.where(text == w, match, -miss)
        new = np.maximum(0, row - gap)
        new[1:] = np.maximum(new[1:], step)
        new = np.maximum.accumulate(new + slope) - slope
        new[0] = 0
        np.maximum(new, 0, out=new)
        k = int(new.argmax())
        if new[k] > best:
            best, end = int(new[k]), k
        row = new
    return best, end


def most(item: np.ndarray, text: np.ndarray, mark: np.ndarray, match: int = 2, miss: int = 1) -> int:
    """No alignment scores more: of every stretch of ``text``, words of the item count as matches and others as
    misses. ``mark`` has a False for each word number."""
    mark[item] = True
    run = np.cumsum(np.where(mark[text], match, -miss))
    mark[item] = False
    return int(min(match * len(item), (run - np.minimum.accumulate(np.append(0, run))[:-1]).max(initial=0)))


def find(items: Items, ids: np.ndarray, least: float, slack: float = 0.25) -> Iterator[tuple[int, float, int, int, int]]:
    """(item id, score, seeds, first word, end word) of the items that the document holds: best stretch of each."""
    raw = mark = None
    for k in items.short:
        raw = raw or ids.tobytes()
        p = _whole(raw, items.bytes[k], 0)
        if p >= 0:
            yield items.ids[k], 1.0, 0, p, p + len(items.words[k])
    for k, starts in items.seeds(ids):
        item = items.words[k]
        size = len(item)
        mark = np.zeros(len(items.vocabulary) + 1, bool) if mark is None else mark
        extra = 4 + int(slack * size)
        low, high = np.maximum(0, starts - extra), np.minimum(len(ids), starts + size + extra)
        cuts = np.flatnonzero(low[1:] > high[:-1]) + 1
        spans = zip(low[np.append(0, cuts)].tolist(), high[np.append(cuts, len(high)) - 1].tolist())
        spans = [(a, b) for a, b in spans if most(item, ids[a:b], mark) / (2 * size) >= least]
        if not spans:
            continue
        raw = raw or ids.tobytes()
        p = _whole(raw, items.bytes[k], 0)
        if p >= 0:
            yield items.ids[k], 1.0, len(starts), p, p + size
            continue
        top = (0, 0, 0)
        for a, b in spans:
            got, end = align(item, ids[a:b])
            top = max(top, (got, -a, end))
        score = top[0] / (2 * size)
        if score >= least:
            a, end = -top[1], top[2]
            _, back = align(item[::-1], ids[a : a + end][::-1])
            yield items.ids[k], score, len(starts), a + end - back, a + end


def _whole(raw: bytes, part: bytes, at: int) -> int:
    """Word position of the item as a whole, or -1."""
    while (at := raw.find(part, at)) >= 0:
        if at % 8 == 0:
            return at // 8
        at += 1
    return -1


def blocks(benchmark: DataFrame, most_words: int = 1_000_000) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded words, streamed to the driver."""
    held, size = [], 0
    for r in common.pick(benchmark, "item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        if held and size + len(r.text) // 2 > most_words:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text) // 2
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.4, most_words: int = 1_000_000) -> DataFrame:
    """A row per document and test item it holds: doc_id, item_id, score (of the alignment, as a share of that of a
    verbatim copy), n_seeds (the n-grams of the item that the document holds, by place in both), and the stretch's
    words [first_word, end_word).

    Null and empty texts and items hold nothing; an item with fewer than ``n`` words is found verbatim only.
    Documents that repeat get rows each; items with equal texts too. Empty tables give no rows; further columns are
    not read. Each block of items is one stated set against all documents: one pass, no shuffle. What is broadcast
    is bounded by ``most_words``: some 40 bytes an n-gram and 100 a distinct word.
    """
    rows = common.pick(docs, "doc_id", "text")
    out = []
    for some in blocks(benchmark, most_words):
        out.append(_held(rows, docs.sparkSession.sparkContext.broadcast(Items(some, n)), least))
    return common.union_all(out) if out else docs.sparkSession.createDataFrame([], ROWS)


def _held(rows: DataFrame, block: Broadcast[Items], least: float) -> DataFrame:
    names = [f.split()[0] for f in ROWS.split(", ")]

    def make():
        items = block.value

        def step(batch):
            found = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch)):
                found += [(doc, *x) for x in find(items, items.numbers(text), least)]
            return dict(zip(names, zip(*found))) if found else {x: [] for x in names}

        return step

    return common.map_batches(rows, make, ROWS)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.4, most_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns kept. One pass decides and filters for each block.
    Null and empty texts hold nothing and stay; rows that repeat are judged each; an empty table gives none."""
    out = docs
    for some in blocks(benchmark, most_words):
        out = _without(out, docs.sparkSession.sparkContext.broadcast(Items(some, n)), least)
    return out


def _without(docs: DataFrame, block: Broadcast[Items], least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        common.worker_state(None, bool)
        for batch in batches:
            for part in common.pieces(batch):
                keep = [next(find(items, items.numbers(t), least), None) is None for t in common.texts_of(part)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
