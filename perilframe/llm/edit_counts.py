"""Token counts that follow edits.

A document's text is cut where white space follows a character that isn't white space, into leaves of
about ``leaf_chars``. There the pre-tokenizer always cuts, so a text's ids are its leaves' ids one
after the other, and its count is the sum of a tree over the leaves' counts. An edit replaces
``length`` characters from ``start`` by ``insert``: the leaves that it touches, and the next ones until
a cut holds again on both sides, are encoded anew; sums change on their paths to the root only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.bpe import Bpe, bpe
from perilframe.llm.common import slices

LEAF_CHARS = 512
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n\t]")
EDITS = "array<struct<start: int, length: int, insert: string>>"


def cut_leaves(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """Leaves of at least ``leaf_chars`` characters; fewer only for the last or where the text ends."""
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + leaf_chars)
        to = m.start() if m else len(text)
        out.append(text[at:to])
        at = to
    return out


class CountTree:
    """Sums of characters and ids over a text's leaves; a Fenwick tree of each."""

    def __init__(self, leaves: list[str], counts: list[int]):
        self.leaves, self.counts = leaves, counts
        self._build()

    def _build(self) -> None:
        self.chars = self._fenwick([len(x) for x in self.leaves])
        self.ids = self._fenwick(self.counts)

    @staticmethod
    def _fenwick(values: list[int]) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(np.array(values, np.int64))))
        k = np.arange(1, len(sums))
        return np.concatenate(([0], sums[k] - sums[k - (k & -k)]))

    def _add(self, tree: np.ndarray, leaf: int, change: int) -> None:
        k = leaf + 1
        while k < len(tree):
            tree[k] += change
            k += k & -k

    def total(self) -> int:
        n, out = len(self.ids) - 1, 0
        while n:
            out += int(self.ids[n])
            n -= n & -n
        return out

    def find(self, position: int) -> tuple[int, int]:
        """The leaf of a character position and the characters before that leaf."""
        k, before, step = 0, 0, 1 << max(0, len(self.chars).bit_length() - 1)
        while step:
            if k + step < len(self.chars) and before + self.chars[k + step] <= position:
                k += step
                before += int(self.chars[k])
            step >>= 1
        return k, before

    def edit(self, encoder: Bpe, start: int, length: int, insert: str) -> int:
        """Apply an edit; the number of characters encoded anew. Positions beyond the text are its end."""
        if not self.leaves:
            self.leaves, self.counts = [""], [0]
            self._build()
        first, before = self.find(start)
        if first == len(self.leaves):
            first -= 1
            before -= len(self.leaves[first])
        last, text = first, self.leaves[first]
        while before + len(text) < start + length and last + 1 < len(self.leaves):
            last += 1
            text += self.leaves[last]
        at = min(start - before, len(text))
        text = text[:at] + insert + text[at + max(0, length) :]
        while first and not (text and _CUT.match(self.leaves[first - 1][-1:] + text, 1)):
            first -= 1
            text = self.leaves[first] + text
        while last + 1 < len(self.leaves) and not (text and _CUT.match(text[-1] + self.leaves[last + 1], 1)):
            last += 1
            text += self.leaves[last]
        count = len(encoder.encode(text)) // 4
        for leaf in range(first, last + 1):
            new, ids = (text, count) if leaf == first else ("", 0)
            self._add(self.chars, leaf, len(new) - len(self.leaves[leaf]))
            self._add(self.ids, leaf, ids - self.counts[leaf])
            self.leaves[leaf], self.counts[leaf] = new, ids
        if last > first:  # an empty leaf would hide the cut before it
            del self.leaves[first + 1 : last + 1], self.counts[first + 1 : last + 1]
            self._build()
        return len(text)


def count(encoder: Bpe, leaves: list[str]) -> list[int]:
    return [len(encoder.encode(x)) // 4 for x in leaves]


def count_edited(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Counts before and after ``edits``, a column of edits whose positions are in the original text.

    Edits must not overlap; they are applied from the last to the first, so that earlier positions
    hold. Null texts are empty; null edits are none. A row for each row of docs.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe(path)
        for frame in slices(frames):
            rows = []
            for doc, text, edits in zip(frame["doc_id"], frame["text"], frame["edits"]):
                leaves = cut_leaves(text or "", leaf_chars)
                tree = CountTree(leaves, count(encoder, leaves))
                n, anew = tree.total(), 0
                edits = [] if edits is None else sorted(edits, key=lambda e: -e["start"])
                for e in edits:
                    anew += tree.edit(encoder, e["start"], e["length"], e["insert"] or "")
                rows.append((doc, n, tree.total(), len(edits), len(text or ""), anew))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_chars_total", "n_chars_encoded_anew"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text", F.col("edits").cast(EDITS)).mapInPandas(run, "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_chars_total long, n_chars_encoded_anew long")


def redactions(docs: DataFrame, pattern: str = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+|\d[\d. ()-]{5,}\d", insert: str = "[removed]") -> DataFrame:
    """docs with ``edits`` that replace every match of a pattern, found by Spark's own functions; an ``edits`` of the caller's is replaced."""
    parts_, found_ = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("parts", "found"))  # no columns of the caller's
    parts = F.split(F.coalesce("text", F.lit("")), pattern, -1)
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))
    starts = F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, i: F.struct((s["at"] + F.length(F.get(F.col(parts_), i)) + F.length(F.get(F.col(found_), i))).alias("at"), F.concat(s["starts"], F.array(s["at"] + F.length(F.get(F.col(parts_), i)))).alias("starts")),
        lambda s: s["starts"],
    )
    edits = F.when(F.size(found_) > 0, F.zip_with(starts, found_, lambda a, b: F.struct(a.alias("start"), F.length(b).alias("length"), F.lit(insert).alias("insert")))).otherwise(F.array().cast(EDITS))
    return docs.withColumn(parts_, parts).withColumn(found_, found).withColumn("edits", edits).drop(parts_, found_)
