"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered as

    <|conv|>            once, at its start
    <|turn|>ROLE<|text|>TEXT<|end|>    per turn

The four control strings are tokens of their own, so no token reaches over the edge of a turn. Inside roles and
texts a backslash is doubled and a backslash follows the ``<`` of a control string, which undoes it; reading drops
the backslash before any character. The rendered text is encoded with character offsets, and each assistant text's
span is intersected with the token spans by binary search.

Long conversations are rendered and encoded in blocks of whole turns. As control tokens part the blocks, the ids are
those of the conversation encoded at once; a block, not a conversation, bounds memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CONV, TURN, TEXT, END = "<|conv|>", "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (CONV, TURN, TEXT, END)
_ESCAPE = re.compile(r"\\|<(?=\|(?:conv|turn|text|end)\|>)")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
BLOCKS = "conv_id bigint, block int, formatted string, input_ids array<int>, loss array<boolean>, loss_start array<int>, loss_end array<int>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Formatter:
    """Renders and encodes blocks of turns with a byte-level vocabulary; control strings get ids past its end."""

    def __init__(self, tokenizer_path: str, learn_roles: tuple[str, ...] = ("assistant",)):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL])
        self.learn_roles = learn_roles

    def block(self, turns: list[tuple[str, str]], first: bool) -> dict:
        """formatted text, ids, token mask, and per token the masked characters [loss_start, loss_end)."""
        parts, spans, at = ([CONV] if first else []), [], len(CONV) if first else 0
        for role, text in turns:
            head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
            parts += [head, body, END]
            at += len(head)
            if role in self.learn_roles:
                spans.append((at, at + len(body)))
            at += len(body) + len(END)
        formatted = "".join(parts)
        enc = self.tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
        starts, ends = offsets[:, 0], offsets[:, 1]
        lo, hi = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for a, b in spans:
            i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            lo[i:j], hi[i:j] = np.maximum(starts[i:j], a), np.minimum(ends[i:j], b)
        # Bytes of one character in several tokens share an offset: each character counts at its first token.
        if len(lo):
            done = np.maximum.accumulate(np.concatenate(([0], hi[:-1])))
            masked = hi > lo
            lo = np.where(masked, np.maximum(lo, done), lo)
            hi = np.where(masked, np.maximum(lo, hi), hi)
        else:
            masked = np.zeros(0, bool)
        return {"formatted": formatted, "input_ids": enc.ids, "loss": masked, "loss_start": lo, "loss_end": hi}


def render(conversations: DataFrame, tokenizer_path: str, block_chars: int = 1 << 18) -> DataFrame:
    """Formats (conv_id, turn, role, text) into rows (conv_id, block, formatted, input_ids, loss, loss_start,
    loss_end); most conversations are one block.

    Turns go by number, then role and text, where numbers repeat; a null turn comes first. Null role and text are
    empty. Rows with a null conv_id make one conversation. Repeated rows are turns of their own. An empty table gives
    no rows; further columns are not read. Rows are dealt by conversation and sorted there; a task streams them, and
    holds one block, however long the conversation.
    """
    rows = common.pick(conversations, "conv_id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    ordered = rows.repartition(common.shuffle_parts(rows.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    fields = common.arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        held: list[tuple[str, str]] = []
        now, block, size = object(), 0, 0
        out: dict[str, list] = {f.name: [] for f in fields}

        def flush() -> None:
            nonlocal block, held, size
            got = made.block(held, block == 0)
            for name, v in {"conv_id": now, "block": block, **got}.items():
                out[name].append(v)
            block, held, size = block + 1, [], 0

        def give() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)
            for v in out.values():
                v.clear()
            return got

        for batch in batches:
            made = made or Formatter(tokenizer_path)
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if conv != now or size >= block_chars:
                    if held:
                        flush()
                    if conv != now:
                        now, block = conv, 0
                held.append((role, text))
                size += len(role) + len(text) + 32
                if len(out["block"]) >= 256:
                    yield give()
        if held:
            flush()
        if out["block"]:
            yield give()

    return ordered.mapInArrow(run, BLOCKS)


def read_back(blocks: DataFrame, tokenizer_path: str) -> DataFrame:
    """What the formatted output says: turns parsed from the text that the ids decode to, and the text under the
    loss mask. Blocks of a conversation are read in order by one task, with running hashes and one block at a time.
    A null conv_id is a conversation of its own; empty texts count as turns; an empty table gives no rows."""
    ordered = blocks.repartition(common.shuffle_parts(blocks.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block")
    fields = common.arrow_schema(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, state, rows = None, None, []
        for batch in batches:
            made = made or Formatter(tokenizer_path)
            for part in common.pieces(batch):
                for row in part.to_pylist():
                    if state is None or row["conv_id"] != state["conv_id"]:
                        if state:
                            rows.append(_close(state))
                        state = {"conv_id": row["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0, "loss_tokens": 0}
                    _read(made, row, state)
                if len(rows) >= 1024:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)
                    rows = []
        if state:
            rows.append(_close(state))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return ordered.mapInArrow(run, DIGEST)


def _read(made: Formatter, row: dict, state: dict) -> None:
    text = made.tokenizer.decode(row["input_ids"], skip_special_tokens=False)
    if text != row["formatted"]:
        raise ValueError("ids and text of a block differ")
    for role, body in _TURNS.findall(text):
        state["turns"] += 1
        state["all"].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
    under = unescape("".join([text[a:b] for a, b, on in zip(row["loss_start"], row["loss_end"], row["loss"]) if on]))
    state["loss"].update(under.encode())
    state["loss_chars"] += len(under)
    state["chars"] += len(text)
    state["tokens"] += len(row["input_ids"])
    state["loss_tokens"] += sum(row["loss"])


def _close(s: dict) -> dict:
    return {"conv_id": s["conv_id"], "n_turns": s["turns"], "turns_sha256": s["all"].hexdigest(), "loss_chars": s["loss_chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["chars"], "n_tokens": s["tokens"], "loss_tokens": s["loss_tokens"]}
