"""Exact token ids of whole texts, with each distinct word-like chunk encoded once.

Both vocabularies cut a text into pre-tokens before any merge, and no pre-token of theirs reaches across the
points at which a text is cut here, so the ids of a text are the ids of its chunks one after the other:

* byte level (``ByteLevel`` with its pattern, no normaliser): a cut before a space that follows a character
  which is no white space, as a pre-token holds a space only as its first character or inside a run of white
  space; and around a line feed that stands alone, which is a pre-token of its own.
* word level (white space removed): a cut at any space or line feed.

Any other pipeline is encoded text by text, and so is a text that holds the string of an added token, which the
library turns into that token's id. A word of Latin letters alone is one pre-token and goes straight to the merges,
and so is the run of punctuation that ends such a word's chunk; other new chunks are encoded by the whole tokenizer.
"""

from __future__ import annotations

import json
import re
import string
from array import array

from . import common

_CUT = re.compile(r"(?<=\S)(?= )")
_WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_LONG_CHUNK = 80

# Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)).difference(_PLAIN)))}


def _single(text: str) -> bool:
    """White space is nothing but lone spaces and line feeds between other characters."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any([r in text for r in _RUNS]) and (text.isascii() or not _WIDE_SPACE.search(text))


def encoder(path: str, cache_entries: int = 500_000) -> "ChunkEncoder":
    """One encoder a Python worker and file; it goes when the worker's next task needs another."""
    return common.worker_state(("encoder", path, cache_entries), lambda: ChunkEncoder(path, cache_entries))


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes: those of the library with
    ``add_special_tokens=False``. Two generations of at most ``cache_entries`` chunks (of at most 80 characters) are
    kept, besides those of 256 texts: some 200 bytes each."""

    def __init__(self, path: str, cache_entries: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.mode = _mode(spec)
        self.added = sorted({t["content"] for t in spec.get("added_tokens") or []})
        self.folded = [t.lower() for t in self.added] if any(t.get("normalized") for t in spec.get("added_tokens") or []) else []
        self.words = _Words(self, cache_entries)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def holds_added(self, text: str) -> bool:
        return any([t in text for t in self.added]) or bool(self.folded) and any(t in text.lower() for t in self.folded)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole":
            return self.whole(texts)
        apart = [k for k, x in enumerate(texts) if self.holds_added(x)]
        if apart:
            texts = list(texts)
            parts = [texts[k] for k in apart]
            for k in apart:
                texts[k] = ""
        out = [ids for at in range(0, len(texts), 256) for ids in self._chunked(texts[at : at + 256])]
        if apart:
            for k, ids in zip(apart, self.whole(parts)):
                out[k] = ids
        return out

    def _chunked(self, texts: list[str]) -> list[bytes]:
        self.words.age()
        get = self.words.__getitem__
        if self.mode == "word":
            return [b"".join(map(get, x.replace("\n", " ").split(" "))) for x in texts]
        heads, out = [], []
        for x in texts:
            if _single(x):
                head, *tail = x.replace("\n", " \n").split(" ")
            else:
                head, *tail = _CUT.split(x)
                tail = [w[1:] for w in tail]
                if any(w[:1] == "\n" for w in tail):  # here a space comes before that line feed
                    head, tail = x, []
            heads.append(head)
            out.append(b"".join(map(get, tail)))
        return [a + b for a, b in zip(self.whole(heads), out)]


class _Words(dict):
    """Chunks to ids, encoded at their first use. At byte level a chunk stands behind a space, or begins with the line
    feed that stands in the space's stead. Punctuation between a letter and the chunk's end is a pre-token of its own."""

    MOST_RUNS = 4096  # runs of punctuation kept

    def __init__(self, owner: ChunkEncoder, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}
        self.whole, self.merge = owner.whole, owner.tokenizer.model.tokenize
        self.low, self.lead = owner.mode == "word", " " if owner.mode == "byte" else ""
        self.space = chr(BYTE_LETTERS[0x20]) if self.lead else ""
        self.runs, self.feed = {}, owner.whole(["\n"])[0]

    def age(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def __missing__(self, w: str) -> bytes:
        if (ids := self.old.get(w)) is not None:
            self[w] = ids
            return ids
        if w[:1] == "\n" and not self.low:
            ids = self.feed + self._ids("", w[1:])
        else:
            ids = self._ids(self.lead, w)
        if len(w) <= _LONG_CHUNK:
            self[w] = ids
        return ids

    def _ids(self, lead: str, w: str) -> bytes:
        core = w if w.isalpha() else w.rstrip(string.punctuation)
        if not core.isalpha() or not core.isascii() and max(core) >= "\u0130":
            return self.whole([lead + w])[0]
        if core is w:
            return self._merged(lead, core)
        known = self.get(core) or self.old.get(core) if lead == self.lead else None
        return (known or self._merged(lead, core)) + self._run(w[len(core) :])

    def _merged(self, lead: str, core: str) -> bytes:
        core = core.lower() if self.low else core
        if core.isascii():  # letters that stand for themselves
            word = self.space + core if lead else core
        else:
            word = (lead + core).encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.merge(word)]).tobytes()

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            ids = self.whole([run])[0]
            if len(self.runs) < self.MOST_RUNS and len(run) <= _LONG_CHUNK:
                self.runs[run] = ids
        return ids


def _mode(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("post_processor") is None and pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    steps = pre.get("pretokenizers", [])
    if kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and not steps[1].get("add_prefix_space") and "[^\\s" in json.dumps(steps[0]["pattern"]).replace("\\\\", "\\"):
        return "word"
    return "whole"
