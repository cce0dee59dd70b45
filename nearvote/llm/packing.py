"""Packing token ids into fixed windows by minimum bin slack.

A document is cut into full windows and one remainder. Remainders are planned on their histogram, which has fewer
entries than a window has ids, whatever the corpus: for the longest remainder left, a bitset subset-sum over the
other lengths finds the multiset that fills the window closest to capacity; where it fills it whole, backtracked
counts give the pattern, which is applied as often as the counts allow. A longest remainder that no multiset
completes is cut instead: all of these lie one after the other in a stream of windows, and the last, partial window
of that stream is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


@dataclass
class Plan:
    """Where the k-th remainder of a length goes. ``slots[length]``: (first rank after the slot run, first rank,
    first sequence, remainders of this length in a window, first offset in the window). Ranks from ``left[length][0]``
    on belong to the stream, from position ``left[length][1]``."""

    capacity: int
    slots: dict[int, list[tuple[int, int, int, int, int]]]
    left: dict[int, tuple[int, int]]
    windows: int
    stream: int
    steps: int

    def tail_cuts(self) -> tuple[int, list[int]]:
        """Start of the stream's partial window, and the lengths of its power-of-two sequences."""
        rest = self.stream % self.capacity
        return self.stream - rest, [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]

    def sequences(self) -> int:
        return self.windows + self.stream // self.capacity + len(self.tail_cuts()[1])

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset there, ids) of the rank-th remainder of this length, in the order of its ids."""
        for end, first, seq, per, offset in self.slots.get(length, ()):
            if rank < end:
                k = rank - first
                return [(seq + k // per, offset + k % per * length, length)]
        first, at = self.left[length]
        at += (rank - first) * length
        end, out = at + length, []
        tail, cuts = self.tail_cuts()
        while at < min(end, tail):
            n = min(end, at - at % self.capacity + self.capacity) - at
            out.append((self.windows + at // self.capacity, at % self.capacity, n))
            at += n
        begin = tail
        for k, size in enumerate(cuts):
            if at < end and begin <= at < begin + size:
                n = min(end, begin + size) - at
                out.append((self.windows + tail // self.capacity + k, at - begin, n))
                at += n
            begin += size
        return out


def fill(lengths: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """The multiset of (length, count) pairs, each count within its bound, whose sum comes closest to ``capacity``
    without passing it: a bitset subset-sum, then counts by backtracking. Lengths are taken in the given order."""
    reach, mask, layers = 1, (1 << capacity + 1) - 1, []
    for length, count in lengths:
        left, part = min(count, capacity // length), 1
        while left:
            n = min(part, left)
            layers.append((length, n, reach))
            reach |= reach << length * n & mask
            left, part = left - n, part * 2
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, n, before in reversed(layers):
        if not before >> at & 1:
            at -= length * n
            out[length] = out.get(length, 0) + n
    return list(out.items())


def plan_bins(histogram: dict[int, int], capacity: int) -> Plan:
    """``histogram``: remainder length (1 to capacity - 1) to count. Takes at most one step a length and one a
    pattern that used a length up, so a number bounded by the capacity alone."""
    have = dict(sorted(((k, v) for k, v in histogram.items() if v), reverse=True))
    used, slots, left = dict.fromkeys(have, 0), {}, {}
    windows = stream = steps = 0
    while have:
        steps += 1
        top = next(iter(have))
        rest = [(k, v - (k == top)) for k, v in have.items() if k <= capacity - top and v > (k == top)]
        pattern = dict(fill(rest, capacity - top))
        if top + sum(k * n for k, n in pattern.items()) < capacity:
            left[top] = (used[top], stream)
            stream += have.pop(top) * top
            continue
        pattern[top] = pattern.get(top, 0) + 1
        times, offset = min(have[k] // n for k, n in pattern.items()), 0
        for k, n in pattern.items():
            slots.setdefault(k, []).append((used[k] + n * times, used[k], windows, n, offset))
            offset += k * n
            used[k] += n * times
            have[k] -= n * times
            if not have[k]:
                del have[k]
        windows += times
    return Plan(capacity, slots, left, windows, stream, steps)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, cache_entries: int = 500_000) -> DataFrame:
    """Packs every document (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns a row a piece: doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id (from 0, gapless), offset, ids (those bytes). Null text is empty and still has its end id. A null
    doc_id stays null. Rows that repeat a doc_id are packed each for itself. An empty table gives no rows. Further
    columns are not read. Ids are made once and written to the shared folder; ranks inside a length come from blocks
    of rows by hash, so no task holds a length, however common. ``cache_entries`` bounds what a Python worker keeps of
    encoded chunks, some 400 bytes for each; fewer cost time only.
    """
    spark = docs.sparkSession
    tokens, _ = common.stage_table(common.map_batches(common.pick(docs, "doc_id", "text"), lambda: _tokenise(tokenizer_path, end_id, cache_entries), "doc_id bigint, n bigint, ids binary", stateless=False).withColumn("rid", F.monotonically_increasing_id()), "pack-tokens")
    light = tokens.select("rid", "n", (F.col("n") % capacity).cast("int").alias("rem"), F.expr(f"n div {capacity}").alias("full"))
    light = light.withColumn("block", common.spread(F.col("rid"), common.shuffle_parts(spark)))
    per = light.groupBy("block", "rem").agg(F.count("*").alias("c"), F.sum("full").alias("f"))
    per, _ = common.stage_table(per, "pack-counts")
    histogram = {r.rem: r.c for r in per.filter("rem > 0").groupBy("rem").agg(F.sum("c").alias("c")).collect()}
    plan = plan_bins(histogram, capacity)
    base, bases = plan.sequences(), {}
    for r in sorted(per.groupBy("block").agg(F.sum("f").alias("f")).collect()):  # a row a shuffle partition
        bases[r.block], base = base, base + r.f
    earlier = Window.partitionBy("rem").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("block", "rem", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("earlier"))
    in_block = Window.partitionBy("block").orderBy("rid")
    ranked = light.withColumn("full_before", F.sum("full").over(in_block) - F.col("full")).withColumn("k", F.row_number().over(Window.partitionBy("block", "rem").orderBy("rid")) - 1)
    ranked = ranked.join(before, ["block", "rem"]).select("rid", "block", "full_before", (F.col("k") + F.col("earlier")).alias("rank"))
    joined = tokens.join(ranked, "rid").select("doc_id", "n", "ids", "block", "full_before", "rank")

    return common.map_batches(joined, lambda: _cut(plan, bases, capacity), PIECES)


def _tokenise(path: str, end_id: int, cache_entries: int):
    enc = encoder(path, cache_entries)
    tail = np.uint32(end_id).tobytes()

    def step(batch):
        ids = [np.frombuffer(x + tail, "<u4") for x in enc.encode(common.texts_of(batch))]
        return {"doc_id": batch.column("doc_id"), "n": [len(x) for x in ids], "ids": [_narrow(x) for x in ids]}

    return step


def _narrow(ids: np.ndarray) -> bytes:
    """Width in the first byte: two bytes an id where all fit."""
    return b"\x02" + ids.astype("<u2").tobytes() if int(ids.max(initial=0)) < 1 << 16 else b"\x04" + ids.tobytes()


def _cut(plan: Plan, bases: dict[int, int], capacity: int):
    def step(batch):
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        for row in batch.to_pylist():
            raw = row["ids"]
            ids = memoryview(np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4").tobytes())
            n, seq = row["n"], bases[row["block"]] + row["full_before"]
            places = [(seq + k, 0, capacity) for k in range(n // capacity)]
            if n % capacity:
                places += plan.place(n % capacity, row["rank"])
            start = 0
            for s, offset, length in places:
                part = ids[4 * start : 4 * (start + length)]
                for name, v in zip(out, (row["doc_id"], start, length, zlib.crc32(part), n, s, offset, bytes(part))):
                    out[name].append(v)
                start += length
        return out

    return step
