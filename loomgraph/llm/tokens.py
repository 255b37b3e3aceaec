"""Whole texts to token ids with the tokenizers library.

The library cuts a text into pieces by a pattern and runs its BPE model on each
piece alone, so a piece always has the same ids.  Here the pattern is run by
Python's ``re`` and the ids of pieces seen before are remembered, up to a
bound; a new piece goes to the library's own model.  That is done for texts,
and for parts of texts between single spaces, whose characters are in ``SAFE``:
there the classes of letters and digits, lower case and NFC are the same in
every version of Unicode.  All other texts and parts, every text that holds one
of the file's added tokens, and all texts of other kinds of tokenizer are
encoded by the library in one go.  Two kinds are known by their files' settings:

* *dropped*: white space separates and vanishes; texts are in lower case.
* *leads*: a single space belongs to what follows it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

#: Pieces of a generation; a task remembers two generations at most (about 80
#: MB): the older one goes when the newer one is full, both at the task's end,
#: as Spark's Python workers live on and do other work.
GENERATION = 200_000

#: Fixed value: the pattern of the tokenizer whose tokens hold no white space.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
# Latin, Cyrillic, the digits among them, and dashes, quotes and the like
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿĀ-įı-ňŊ-žЀ-џ"
_DIGITS = "0-9²³¹¼½¾"
#: The two kinds' patterns over those characters.
_CUT = {
    "dropped": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+"),
    "leads": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\\s{_LETTERS}{_DIGITS}]+|\\s+(?!\\S)|\\s+"),
}
_SAFE = re.compile(f"[\\t\\n -~¡-¬®-¶¸-ÿ{_LETTERS}‐-‧‰-⁞€]*")
_TIGHT = re.compile(r"\s | \s|\A\s|\s\Z")
#: Fixed rule: the character that stands for each byte in byte-level models.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def kind_of(file: dict) -> str | None:
    """How texts may be cut for a tokenizer file, None if they may not be."""
    pre, norm, model = file["pre_tokenizer"] or {}, file["normalizer"] or {}, file["model"]
    if model.get("type") != "BPE" or model.get("dropout") or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
        return None
    if pre.get("type") == "ByteLevel":
        return "leads" if not norm and pre.get("use_regex") and not pre.get("add_prefix_space") else None
    split, *rest = pre.get("pretokenizers") or [{}]
    removed = split.get("pattern", {}).get("Regex") == WORD_PATTERN and split.get("invert") and split.get("behavior") == "Removed"
    mapped = [p.get("type") for p in rest] == ["ByteLevel"] and not rest[0].get("use_regex") and not rest[0].get("add_prefix_space")
    return "dropped" if removed and mapped and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] else None


class _Known(dict):
    """Pieces to their ids; a missing one comes from the older generation or
    from ``learn``."""

    def __init__(self, learn):
        self.learn, self.older = learn, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.learn(piece)
        self[piece] = ids
        return ids

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.kind, self.added = kind_of(file), [t["content"] for t in file["added_tokens"]]
        self.cut = _CUT.get(self.kind)
        self.known = _Known(self._piece)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [self._text(t) for t in texts]

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # a shorter way to the same
            shown = piece.replace(" ", "\u0120")
        else:
            shown = piece.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _text(self, text: str) -> bytes:
        if self.kind is None or any(t in text for t in self.added):
            return self.whole([text])[0]
        if _SAFE.fullmatch(text):
            out = self._safe(text)
        elif self.kind == "leads" and _TIGHT.search(text):
            return self.whole([text])[0]
        else:
            space = " " if self.kind == "leads" else ""
            first, *rest = text.split(" ")
            out = b"".join(self._safe(c) if _SAFE.fullmatch(c) else self.whole([c])[0] for c in (first, *(space + c for c in rest)))
        if len(self.known) > GENERATION:
            self.known.age()
        return out

    def _safe(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.cut.findall(text.lower() if self.kind == "dropped" else text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's encoder of this file; it is read once."""
    if path not in _encoders:
        _encoders.clear()  # one tokenizer at a time
        _encoders[path] = Encoder(path)
    return _encoders[path]


@contextmanager
def encoding(path: str) -> Iterator[Encoder]:
    """The worker's encoder, for a task."""
    enc = encoder(path)
    try:
        yield enc
    finally:
        enc.known.forget()


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
