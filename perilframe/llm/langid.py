"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; each bit is predicted by a binary classifier over hashed
character n-grams of the whole text (mean log odds of the bit's two sides, languages weighing alike).
Decoding is loss-weighted: the codeword whose bits lose least, each bit weighed by how sure its
classifier is of that language, is the prediction; the runner-up's distance makes the score, and a
close one flags the document as ambiguous.

The classifiers learn from at most ``SAMPLE`` labelled documents of each language, those with the
least hashes of doc_id. Every language is learned; counts take 512 KB of memory for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilframe.llm import sketch
from perilframe.llm.common import slices

SAMPLE = 1500
BITS = 16
WINDOW = 500_000
AMBIGUOUS = 0.6
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def codes(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of n languages: every split of up to five of them, else the best of random codes."""
    if n < 2:
        return np.ones((max(n, 0), 1), np.int8)
    if n <= 5:
        columns = np.arange(1, 2 ** (n - 1))
        return np.where((np.arange(n)[:, None] == 0) | (columns[None, :] >> np.maximum(np.arange(n) - 1, 0)[:, None] & 1 == 0), 1, -1).astype(np.int8)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (n, length))
        c = c[:, np.abs(c.sum(axis=0)) < n]
        d = (c[:, None, :] != c[None, :, :]).sum(axis=2) + np.eye(n, dtype=int) * 10**6
        if d.min() > far:
            best, far = c, int(d.min())
    return best


def points(text: str) -> np.ndarray:
    """Lower-case code points, with a space for what isn't a letter."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_LETTER[p], p, 32)


def grams(p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For n of 1 to 3: n and the bucket of the n-gram at each place."""
    h = np.zeros(len(p), np.uint32)
    for n in (1, 2, 3):
        if len(p) < n:
            return
        h = (h[: len(p) - n + 1] * np.uint32(0x9E3779B1)) ^ (p[n - 1 :] * np.uint32(0x85EBCA6B))
        g = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        yield n, g >> np.uint32(32 - BITS)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log odds of each text's bits, and whether it has letters."""
        out = np.zeros((len(texts), self.code.shape[1]))
        some = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            if not text:
                continue
            p = points(text)
            some[i] = bool((p != 32).any())
            if not some[i]:
                continue
            total = 0
            for a in range(0, len(p), WINDOW):
                for _, g in grams(p[a : a + WINDOW]):
                    out[i] += self.weights[g].sum(axis=0, dtype=np.float64)
                    total += len(g)
            out[i] /= total
        return out / self.scale, some

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword of each row, and its share of all."""
        loss = np.log1p(np.exp(-np.clip(self.code[None] * margins[:, None, :] * 4, -50, 50)))
        distance = (loss * self.trust[None]).sum(axis=2)
        e = np.exp(-(distance - distance.min(axis=1, keepdims=True)) * 4)
        return distance.argmin(axis=1), e.max(axis=1) / e.sum(axis=1)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the labelled documents that aren't held out; None without any."""
    spark = docs.sparkSession
    usable = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not found:
        return None
    languages = [r["lang"] for r in found]
    # Twice the sample's share of a language's hashes holds it but for chance, so no task ranks a whole language.
    share = spark.createDataFrame([(r["lang"], min(1.0, 2 * sample / r["count"])) for r in found], "lang string, share double")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(share), "lang")
    chosen = chosen.where(F.pmod("h", F.lit(1 << 30)) <= F.col("share") * (1 << 30)).select("doc_id", "lang", F.pmod("h", F.lit(1 << 30)).alias("h")).distinct()
    chosen = chosen.withColumn("r", rank).where(F.col("r") <= sample)
    # At most SAMPLE ids of each language.
    rows = usable.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")
    size = 1 << BITS
    index = {x: i for i, x in enumerate(languages)}

    def add(own: np.ndarray, frame: pd.DataFrame) -> None:
        for lang, text in zip(frame["lang"], frame["text"]):
            p = points(text)
            for a in range(0, len(p), WINDOW):
                for _, g in grams(p[a : a + WINDOW]):
                    own[index[lang] * size : (index[lang] + 1) * size] += np.bincount(g, minlength=size)

    counts = sketch.gather(rows.select("lang", "text"), add, size * len(languages), "i8").reshape(len(languages), size)
    share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    code = codes(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((size, 1), np.float32), np.ones(1), np.ones((1, 1)))
    sides = [(share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
    weights = np.stack([np.log(x / y) for x, y in sides], axis=1)
    sure = (share @ weights) * code
    scale = np.maximum(sure.mean(axis=0), 1e-9)
    trust = np.maximum(sure / scale, 0.05)
    return Model(languages, code, weights.astype(np.float32), scale, trust / trust.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; only ``text`` is looked at.

    Null texts, texts without letters, and all texts without a model are ``und``, score 0. A row for
    each row; other columns are passed on, but for any of these three names, whose place the new ones take.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for frame in slices(frames):
            pred, score = np.full(len(frame), "und", object), np.zeros(len(frame))
            if m is not None:
                margins, some = m.margins(frame["text"].tolist())
                at, share = m.decode(margins)
                pred[some] = np.array(m.languages, object)[at[some]]
                score[some] = np.clip(share[some], 0, 1)
            yield frame.assign(lang_pred=pred, score=score, ambiguous=(pred != "und") & (score < AMBIGUOUS))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Train and predict: doc_id, held_out, lang_pred, score, ambiguous."""
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
