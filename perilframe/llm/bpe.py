"""Byte-level BPE ids of whole texts, with the merges of the tokenizers library.

The vocabulary file is a parameter. A text of common Latin script is cut where the file's own
pre-tokenizer cuts it, and each distinct piece goes through the library's BPE model once while it
stays in a bounded per-worker cache. Any other text, and any text that may hold a special token,
goes through the library's whole pipeline.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from perilframe.llm.common import one_thread

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = "¡-©«¬®-±´¶-¸»¿×÷‐-―‘-‟•…"
#: A character for which the piece patterns below aren't known to be the library's.
_ODD = re.compile(f"[^\\x00-\\x1b\\x20-\\x7e{_LETTER}{_OTHER}]|İ|<\\|")
_PUBLIC = "'s|'t|'re|'ve|'m|'ll|'d|"
_PIECES = {
    "byte": re.compile(f"{_PUBLIC} ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"{_PUBLIC}[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+"),
}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces, as bytes. Two generations of at most ``limit`` pieces each."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Bpe:
    """Ids of one vocabulary file; ``limit`` bounds the pieces kept."""

    def __init__(self, path: str, limit: int = 200_000):
        one_thread()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.kind = self._kind(spec)
        self._table = {b: c for b, c in byte_alphabet().items()}
        model = self.tokenizer.model
        table = self._table
        self.pieces = _Pieces(lambda p: array("I", [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(table))]).tobytes(), limit)

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        if norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            return "word"
        return "library"

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if self.kind == "library" or _ODD.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.kind == "word":
            text = text.lower()
        return b"".join(map(self.pieces.__getitem__, _PIECES[self.kind].findall(text)))

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id (byte-level vocabularies)."""
        if not hasattr(self, "_bytes"):
            back = {c: b for b, c in self._table.items()}
            out = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            self._bytes = out
        return self._bytes

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes().__getitem__, ids.tolist()))


_KEPT: dict[tuple[str, int], Bpe] = {}


def bpe(path: str, limit: int = 200_000) -> Bpe:
    """This worker process's encoder of a file."""
    if (path, limit) not in _KEPT:
        _KEPT[path, limit] = Bpe(path, limit)
    return _KEPT[path, limit]


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")
