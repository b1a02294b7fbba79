"""BPE encoding and decoding by tree concatenation.

A text of more than ``TREE_CHARS`` characters is cut into leaves of as many, which are encoded one by
one; of a text longer than ``leaf_chars``, parts of that length are rows of their own, encoded and joined
in parallel, and only then joined with each other. Neighbours are then joined up the tree: the ids around a join are decoded,
encoded again as one window, and the window grows until its first id is the left side's own and its
last id the right side's own. A window may begin or end only

* where white space follows a character that isn't white space: there the pre-tokenizer always cuts,
  so ids on either side don't depend on each other; or
* deep inside a run of letters: within one pre-token, ids are those of the whole if and only if each
  two neighbours are, so agreement of the ids at the window's ends is enough.

With neither, the window grows to the whole text. Null texts are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.bpe import Bpe, bpe, ids_of
from perilframe.llm.common import slices

#: Characters to a leaf, and to a part of a text that is a row of its own.
TREE_CHARS, LEAF_CHARS = 1024, 32_768
_DEEP = 16
_WS = b" \n\t\r\x0b\x0c"
_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Joiner:
    """Joins the ids of two neighbouring texts into the ids of both together."""

    def __init__(self, encoder: Bpe):
        self.encoder = encoder
        table = encoder.token_bytes()
        self.starts_space = np.array([t[:1] != b"" and t[:1] in _WS for t in table])
        self.ends_word = np.array([bool(t) and t[-1] < 0x80 and not chr(t[-1]).isspace() for t in table])
        self.letters = np.array([self._letters(t) for t in table])

    @staticmethod
    def _letters(token: bytes) -> bool:
        try:
            return token.decode().isalpha()
        except UnicodeDecodeError:
            return False

    def _edges(self, ids: np.ndarray) -> np.ndarray:
        """The positions before which a window may begin or end."""
        ok = np.zeros(len(ids) + 1, bool)
        ok[1:-1] = self.ends_word[ids[:-1]] & self.starts_space[ids[1:]]
        run = self.letters[ids].astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(run)))
        if len(ids) >= 2 * _DEEP:
            ok[_DEEP : len(ids) - _DEEP + 1] |= sums[2 * _DEEP :] - sums[: -2 * _DEEP] == 2 * _DEEP
        return ok

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(left) or not len(right):
            return np.concatenate((left, right))
        reach = 64
        while True:
            a0, b0 = max(0, len(left) - reach - 4096), min(len(right), reach + 4096)
            near_l = np.flatnonzero(self._edges(left[a0:])[: max(1, len(left) - a0 - reach + 1)]) + a0
            near_l = near_l[near_l > a0]
            i = int(near_l[-1]) if len(near_l) else 0
            edges = np.flatnonzero(self._edges(right[:b0]))
            edges = edges[(edges >= min(reach, b0)) & (edges < b0)]
            j = int(edges[0]) if len(edges) else len(right)
            window = self.encoder.decode_bytes(np.concatenate((left[i:], right[:j])))
            new = ids_of(self.encoder.encode(window.decode("utf-8", "surrogatepass")))
            if (i == 0 or new[0] == left[i]) and (j == len(right) or new[-1] == right[j - 1]):
                return np.concatenate((left[:i], new, right[j:]))
            reach *= 4

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, "<u4")


_JOINERS: dict[str, Joiner] = {}


def joiner(path: str) -> Joiner:
    if path not in _JOINERS:
        _JOINERS[path] = Joiner(bpe(path))
    return _JOINERS[path]


def encode_text(text: str | None, path: str, leaf_chars: int = TREE_CHARS) -> np.ndarray:
    """One text's ids by the same tree, within one process."""
    text = text or ""
    leaves = [text[k : k + leaf_chars] for k in range(0, len(text), leaf_chars)]
    return joiner(path).tree([ids_of(bpe(path).encode(x)) for x in leaves])


def _tree_ids(text: str | None, path: str) -> bytes:
    return encode_text(text, path).astype("<u4").tobytes()


def _digest(encoder: Bpe, ids: bytes) -> tuple[int, str, str]:
    decoded = encoder.decode_bytes(ids_of(ids))
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest()


_LEAF = "doc_id long, row long, leaf int, ids binary"


def leaves(docs: DataFrame, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """A row for each part of each text longer than ``leaf_chars``: doc_id, row, leaf, text."""
    parts = F.ceil(F.length("text") / F.lit(leaf_chars)).cast("int")
    long = docs.where(F.length("text") > leaf_chars).withColumn("row", F.monotonically_increasing_id())
    return long.select("doc_id", "row", "text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("leaf")).select("doc_id", "row", "leaf", F.substring("text", F.col("leaf") * leaf_chars + 1, F.lit(leaf_chars)).alias("text"))


def _leaf_ids(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            yield frame[["doc_id", "row", "leaf"]].assign(ids=[_tree_ids(t, path) for t in frame["text"]])

    return run


def _whole(path: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = joiner(path).tree([ids_of(x) for x in frame.sort_values("leaf")["ids"]])
        return frame[["doc_id"]].head(1).assign(ids=[ids.astype("<u4").tobytes()])

    return run


def _joined(docs: DataFrame, path: str, leaf_chars: int) -> DataFrame:
    """Ids of the documents longer than a leaf."""
    parts = leaves(docs, leaf_chars).repartition("row", "leaf").mapInPandas(_leaf_ids(path), _LEAF)
    return parts.groupBy("doc_id", "row").applyInPandas(_whole(path), "doc_id long, ids binary")


def _short(docs: DataFrame, leaf_chars: int) -> DataFrame:
    return docs.where(F.coalesce(F.length("text") <= leaf_chars, F.lit(True)))


def encode_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Ids of each document: doc_id, ids (binary, little-endian unsigned 32-bit integers)."""

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            yield frame[["doc_id"]].assign(ids=[_tree_ids(t, path) for t in frame["text"]])

    docs = docs.select("doc_id", "text")
    return _short(docs, leaf_chars).mapInPandas(short, "doc_id long, ids binary").unionByName(_joined(docs, path, leaf_chars))


def digests(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode, decode, and return each document's number of ids, hash of ids and hash of decoded text.

    A row for each row of docs: repeated rows, null texts and null doc_ids are kept. Other columns are
    not looked at.
    """

    def table(frame: pd.DataFrame, ids) -> pd.DataFrame:
        out = [_digest(bpe(path), x) for x in ids]
        return frame[["doc_id"]].assign(n_tokens=[x[0] for x in out], ids_sha256=[x[1] for x in out], decoded_sha256=[x[2] for x in out])

    def long(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield table(frame, frame["ids"])

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            yield table(frame, (_tree_ids(t, path) for t in frame["text"]))

    docs = docs.select("doc_id", "text")
    return _short(docs, leaf_chars).mapInPandas(short, _RESULT).unionByName(_joined(docs, path, leaf_chars).mapInPandas(long, _RESULT))
