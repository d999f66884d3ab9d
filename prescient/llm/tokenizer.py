"""Token ids of whole texts by the tokenizers library.

A byte-level vocabulary is applied to each pretoken on its own, so a piece of
text between two pretoken boundaries always has the same ids. Texts are cut
at a space before a non-space character, where such a vocabulary always has a
boundary, and each worker remembers the ids of pieces it has met. A tokenizer
of any other kind gets whole texts, and so does a text that holds an added token
of the file, which the library matches before it looks for boundaries.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Pieces that one Python worker remembers (some 200 bytes each); more are encoded again.
CACHE_PIECES = 600_000

_CUT = re.compile(r" (?=\S)")
# A run of Latin letters is one pretoken with the space before it; a run of marks
# after it (no apostrophe, which can open a contraction) is the next.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_alphabet() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the
    rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()
# White space that, after a space, moves the boundary.
_UNSAFE = tuple(" " + c for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
_UNSAFE_WIDE = tuple(" " + chr(c) for c in (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


class _AfterSpace(dict):
    """Ids (little-endian uint32 bytes) of a piece with one space before it."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.marks: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        m = _WORD.fullmatch(piece)
        if m is None:
            out = self._encode(" " + piece)
        elif m[2]:
            marks = self.marks.get(m[2])
            if marks is None:
                marks = self.marks[m[2]] = self._encode(m[2])
            out = self[m[1]] + marks
        else:
            word = piece if piece.isascii() else \
                piece.encode().decode("latin-1").translate(_ALPHABET)
            out = array("I", [t.id for t in self.model.tokenize(_ALPHABET[32] + word)]).tobytes()
        if len(self) < CACHE_PIECES:
            self[piece] = out
        return out

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Encodes texts to little-endian uint32 ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = _cuts_at_spaces(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.after_space = _AfterSpace(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """Ids of one whole text, as bytes."""
        if not self.by_piece or any(x in text for x in self.added):
            return self._whole(text)
        if text.endswith(" ") or any(x in text for x in _UNSAFE) or (
                not text.isascii() and any(x in text for x in _UNSAFE_WIDE)):
            parts = _CUT.split(text)
        else:
            parts = text.split(" ")
        first = self._whole(parts[0]) if parts[0] else b""
        return first + b"".join(map(self.after_space.__getitem__, parts[1:]))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _cuts_at_spaces(path: str) -> bool:
    """Whether the file is a byte-level BPE that splits words by its standard pattern."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and spec.get("model", {}).get("type") == "BPE"
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
