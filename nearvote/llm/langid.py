"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place; a text's vector bundles (adds) the vectors of its n-grams; a language's prototype
bundles its labelled texts, each scaled to the same length. A text gets the language of the prototype with the largest cosine.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

NONE = "und"
ROWS = "doc_id bigint, held_out boolean, lang_pred string, score double, margin double"


class Letters:
    """Code points to letter numbers. Letters are folded to lower case; those past the first ``alphabet`` share
    numbers by remainder, so any script is read with a bounded number of vectors. Number 0 is the word edge."""

    def __init__(self, alphabet: int, n: int, dims: int, seed: int):
        self.alphabet, self.n, self.dims = alphabet, n, dims
        table = np.zeros(sys.maxunicode + 1, np.uint16)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                low = ord(chr(c).lower()[0])
                table[c] = 1 + low % (alphabet - 1)
        self.table = table
        base = np.random.default_rng(seed).integers(0, 2, (alphabet, dims), np.int8) * 2 - 1
        base[0] = 1 - 2 * np.random.default_rng(seed + 1).integers(0, 2, dims, np.int8)
        self.shifted = [np.roll(base, n - 1 - k, axis=1).astype(np.int8) for k in range(n)]

    def grams(self, text: str) -> np.ndarray:
        """n-gram codes of a text: runs of anything but letters count as one edge, and each text begins and ends
        with one; n-grams with an edge inside them are left out."""
        codes = self.table[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        keep = codes != 0
        keep[1:] |= keep[:-1]
        codes = np.concatenate(([0], codes[keep], [0])).astype(np.int64)
        n = self.n
        if len(codes) < n:
            return codes[:0]
        out = codes[: len(codes) - n + 1].copy()
        for k in range(1, n):
            out = out * self.alphabet + codes[k : len(codes) - n + 1 + k]
        inner = np.ones(len(out), bool)
        for k in range(1, n - 1):
            inner &= codes[k : len(codes) - n + 1 + k] != 0
        return out[inner]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of n-gram codes."""
        out = None
        for k in reversed(range(self.n)):
            part = self.shifted[k][grams % self.alphabet]
            out = part if out is None else out * part
            grams = grams // self.alphabet
        return out.astype(np.float32)

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts × dims) bundled vectors, exact sums below 2**24; and the number of n-grams of each text."""
        grams = [self.grams(t) for t in texts]
        sizes = np.array([len(g) for g in grams])
        every = np.concatenate(grams) if len(grams) else np.zeros(0, np.int64)
        unique, inverse = np.unique(every, return_inverse=True)
        rows = np.repeat(np.arange(len(texts)), sizes)
        out = np.zeros((len(texts), self.dims), np.float32)
        step = 2048  # n-grams at a time, so that neither factor grows with the batch
        order = np.argsort(inverse, kind="stable")
        sorted_inverse, sorted_rows = inverse[order], rows[order]
        for at in range(0, len(unique), step):
            a, b = np.searchsorted(sorted_inverse, [at, at + step])
            width = min(step, len(unique) - at)
            counts = np.bincount(sorted_rows[a:b] * width + sorted_inverse[a:b] - at, minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(np.float32) @ self.vectors(unique[at : at + width])
        return out, sizes


def letters(alphabet: int, n: int, dims: int, seed: int) -> Letters:
    """One table a Python worker."""
    return common.worker_state(("letters", alphabet, n, dims, seed), lambda: Letters(alphabet, n, dims, seed))


def scaled(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1. A null id counts as the empty text, and is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(labelled: DataFrame, alphabet: int = 512, n: int = 3, dims: int = 1024, seed: int = 7, group: int = 64) -> tuple[list[str], np.ndarray]:
    """Prototypes from (lang, text). Tasks bundle what they read; only sums of vectors, a row a language and task,
    are shuffled, and a row a language and dimension reaches the driver. Sums are of integers, so their order does
    not matter. Null and letterless texts teach nothing; rows without a language are left out."""

    def run(batches):
        import pyarrow as pa

        hd, sums = letters(alphabet, n, dims, seed), {}
        for batch in batches:
            for part in common.pieces(batch, 1 << 20):
                langs, texts = part.column("lang").to_pylist(), common.texts_of(part)
                for at in range(0, len(texts), group):
                    vectors, _ = hd.bundle(texts[at : at + group])
                    unit = np.rint(scaled(vectors) * (1 << 20)).astype(np.int64)
                    for k, lang in enumerate(langs[at : at + group]):
                        sums[lang] = sums.get(lang, 0) + unit[k]
        names = sorted(sums)
        for name in names:
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * dims), "dim": pa.array(range(dims), pa.int32()), "v": pa.array(sums[name])})

    rows = common.pick(labelled, "lang", "text").filter("lang is not null and text is not null").mapInArrow(run, "lang string, dim int, v bigint")
    found = rows.groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect()
    names = sorted({r.lang for r in found})
    out = np.zeros((len(names), dims))
    for r in found:
        out[names.index(r.lang), r.dim] = r.v
    return names, scaled(out).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, alphabet: int = 512, n: int = 3, seed: int = 7, group: int = 64) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, lang_pred, score (the cosine, 0 to 1) and its lead over the
    next language. ``und`` with score 0 for null, empty and letterless texts, and where nothing was learned. Ties go
    to the name that sorts first. Rows that repeat are predicted each; further columns are not read."""
    dims = prototypes.shape[1] if len(names) else 0

    def make():
        hd = letters(alphabet, n, dims, seed) if names else None

        def step(batch):
            texts = common.texts_of(batch)
            pred, score, margin = [], [], []
            for at in range(0, len(texts), group):
                some = texts[at : at + group]
                if not names:
                    pred, score, margin = pred + [NONE] * len(some), score + [0.0] * len(some), margin + [0.0] * len(some)
                    continue
                vectors, has = hd.bundle(some)
                like = scaled(vectors) @ prototypes.T
                best = like.argmax(axis=1)
                for k in range(len(some)):
                    row = np.sort(like[k])
                    lettered = has[k] > 0 or any(map(str.isalpha, some[k]))
                    pred.append(names[best[k]] if lettered else NONE)
                    score.append(float(min(1.0, max(0.0, row[-1]))) if lettered else 0.0)
                    margin.append(float(row[-1] - row[-2]) if lettered and len(row) > 1 else 0.0)
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pred, "score": score, "margin": margin}

        return step

    return common.map_batches(docs.select(docs["doc_id"], docs["text"], held_out(docs["doc_id"]).alias("held_out")), make, ROWS, stateless=False)


def identify(docs: DataFrame, **model) -> DataFrame:
    """Learns from the labelled rows of ``docs`` that are not held out, then predicts every row."""
    names, prototypes = learn(docs.filter(~held_out(docs["doc_id"])), **model)
    model.pop("dims", None)
    return predict(docs, names, prototypes, **model)


def keep(docs: DataFrame, names: list[str], prototypes: np.ndarray, least: float, lead: float = 0.0, alphabet: int = 512, n: int = 3, seed: int = 7, group: int = 64, few: int = 200) -> DataFrame:
    """The rows of ``docs`` whose language is identified; all columns stay. Rejected are texts without a letter, and
    those of ``few`` n-grams or more that have a cosine below ``least`` with every prototype (no learned language), or
    whose best prototype leads the next by less than ``lead`` (a mixture). In a shorter text some words' n-grams
    decide the cosine, so a letter is enough; and where nothing was learned it is enough for any text.

    Null and empty texts have no letter. Rows that repeat are judged each; an empty table gives none; columns other
    than ``text`` are passed on unread, whatever their names."""

    def run(batches):
        import pyarrow as pa

        hd = letters(alphabet, n, prototypes.shape[1], seed) if names else None
        for batch in batches:
            for part in common.pieces(batch):
                texts, good = common.texts_of(part), []
                for at in range(0, len(texts), group):
                    some = texts[at : at + group]
                    fine = [any(map(str.isalpha, t)) for t in some]
                    if hd:
                        vectors, sizes = hd.bundle(some)
                        like = np.sort(scaled(vectors) @ prototypes.T, axis=1)
                        clear = like[:, -1] >= least
                        if len(names) > 1:
                            clear &= like[:, -1] - like[:, -2] >= lead
                        fine = [a and bool(b) for a, b in zip(fine, clear | (sizes < few))]
                    good += fine
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
