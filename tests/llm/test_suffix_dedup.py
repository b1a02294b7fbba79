"""Removal of repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from perilframe.llm import suffix_dedup
from perilframe.llm.queries import queries
from perilframe.llm.suffix_dedup import MATCH, Suffixes, Units


def brute(docs):
    """[(spans, kept)] of documents in order, by a table of all strings."""
    seen, out = set(), []
    for t in docs:
        on = np.zeros(len(t) + 1, np.int64)
        for a in range(len(t) - MATCH + 1):
            w = t[a : a + MATCH]
            if w in seen:
                on[a] += 1
                on[min(a + MATCH, len(t))] -= 1
            seen.add(w)
        gone = np.cumsum(on[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
        out.append((list(zip(edge[0::2].tolist(), edge[1::2].tolist())), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé \n\0") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda m: " ".join(rng.choice(words) for _ in range(m))
    shared, out = [text(rng.randint(15, 80)) for _ in range(6)], []
    for k in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.35 else text(rng.randint(0, 60)) for _ in range(rng.randint(0, 6))]
        t = rng.choice(["", " "]).join(parts)
        if k % 7 == 3 and out:  # a near copy
            t = list(rng.choice(out))
            for _ in range(3):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("xyz")
            t = "".join(t)
        if k % 11 == 5 and out:
            t = rng.choice(out)
        out.append(t)
    return [*out, "a" * 700, "b" * 99, "ab" * 300 + "a" * 400, "a" * 100, "", shared[0] * 9]


def compare(got, ids, docs):
    """Rows against brute force over documents in order."""
    want = brute(docs)
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs)
    for i, t, (spans, kept) in zip(ids, docs, want):
        assert by[i]["n_bytes"] == len(t)
        assert [(s["start"], s["end"]) for s in by[i]["spans"]] == spans, i
        assert bytes(by[i]["kept"]) == kept
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_equals_brute_force_over_many_blocks_and_ranges(spark, seed):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    ids.sort()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, found int, spans int").repartition(5)
    got = suffix_dedup.cut(df, block=900, size=700).collect()
    want = compare(got, ids, [t.encode() for t in texts])
    assert sum(len(s) for s, _ in want) > 40


def test_edges(spark):
    """Null ids and texts, shared ids, repeated rows, ties and an empty table."""
    long = "".join(random.Random(6).choices("abcdefgh", k=3_000))
    rows = [(5, long), (5, long), (None, long), (7, None), (8, ""), (2, "x" + long[40:180]), (None, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, start string")
    got = sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]]) for r in suffix_dedup.cut(df).collect()), key=str)
    first = brute([("x" + long[40:180]).encode(), long.encode()])[1][0]
    assert first == [(40, 180)]
    want = [(5, 3000, first), (5, 3000, first), (None, 3000, [(0, 3000)]), (7, 0, []), (8, 0, []), (2, 141, []), (None, 0, [])]
    assert got == sorted(want, key=str)
    assert suffix_dedup.cut(df.limit(0)).collect() == []


def test_long_text(spark):
    """A text of several pieces, with a passage that crosses their border and comes again."""
    rng = np.random.default_rng(3)
    t = "".join(map(chr, rng.integers(97, 123, 2_300_000)))
    at = suffix_dedup.PIECE
    t = t + t[at - 150 : at + 150]
    got = suffix_dedup.cut(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()
    assert [(s["start"], s["end"]) for s in got[0]["spans"]] == [(2_300_000, 2_300_300)]


def test_units_hold_every_window_once():
    texts = [t.encode() for t in corpus(7)]
    u = Units(texts)
    for k, t in enumerate(texts):
        mine = [(int(a), int(w)) for x, a, w in zip(u.text, u.start, u.windows) if x == k]
        assert sum(w for _, w in mine) == max(0, len(t) - MATCH + 1)
        assert [a for a, _ in mine] == np.cumsum([0, *(w for _, w in mine)])[:-1].tolist()


def test_suffixes_of_three_classes_are_in_order():
    rng = np.random.default_rng(11)
    text = rng.integers(0, 3, 400)
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    rank = np.zeros(len(text) + 3, np.int64)
    rank[order] = np.arange(1, len(text) + 1)
    ranks = np.where(np.arange(len(rank)) % 3 == 0, -1, rank)  # class 0 has none of its own
    at = np.arange(len(text))
    every = Suffixes.at(at, at, 1, np.r_[text, 0, 0, 0], ranks)
    for small in (False, True):
        assert (every.before(every, small) == rank[: len(text)] - 1).all()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries()["op13_suffix_dedup"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute([(d["text"] or "").encode() for d in docs])
    assert len(got) == len(docs) and sum(len(s) for s, _ in want) > 5
    for d, (spans, kept) in zip(docs, want):
        r = got[d["doc_id"]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        assert r["n_bytes"] == len((d["text"] or "").encode())


def suspects(texts):
    """The windows that ``_suspects`` gives to the sort."""
    import pandas as pd

    frame = pd.DataFrame({"doc": range(len(texts)), "tie": 0, "text": texts})
    places = pd.concat(suffix_dedup._places(iter([frame])))
    known = places.groupby("t")["x"].nunique()
    known = known[known > 1].index.to_numpy()

    class Live:
        def has(self, hashes):
            return np.isin(hashes, known)

    return sum(int(f["windows"][f["body"].notna()].sum()) for f in suffix_dedup._suspects(Live())(iter([frame])))


def test_phrases_shorter_than_a_match_are_not_sorted():
    """A shared phrase of 60 bytes holds anchors, but none of them with the bytes beside it that a match would have."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrase, passage = text(60), text(300)
    assert suspects([text(400) + phrase + text(400) for _ in range(50)]) == 0
    assert suspects([text(400) + passage + text(400) for _ in range(5)]) >= 5 * (300 - MATCH + 1)


def test_a_block_sends_its_parts_together(spark):
    """One frame for each range took a Python worker most of its time where blocks meet many ranges."""
    sent = []

    class Blocks:
        def mapInPandas(self, run, schema):
            import pandas as pd

            sent.extend(run(iter([pd.DataFrame({"b": [7]})])))
            raise StopIteration

    with pytest.raises(StopIteration):
        suffix_dedup._exchange(Blocks(), lambda row: ((r, bytes(1000)) for r in range(10_000)), None, None, "x")
    assert len(sent) <= 4 and sum(map(len, sent)) == 10_000


def test_of_equal_segments_one_is_sorted(spark, monkeypatch):
    """A passage in many documents goes to the sort once, but for the windows at its edges."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(600)
    texts = [text(200) + passage[k % 3 :] + text(200) for k in range(30)]
    sorted_, named = [], suffix_dedup._named

    def held(blocks, *rest):
        sorted_.extend(np.frombuffer(bytes(r["windows"]), np.int64).sum() for r in blocks.select("windows").collect())
        return named(blocks, *rest)

    monkeypatch.setattr(suffix_dedup, "_named", held)
    got = suffix_dedup.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    compare(got, range(30), [t.encode() for t in texts])
    assert sum(sorted_) < 30 * 500 / 4


def test_periodic_passages(spark):
    """Stretches with many equal least hashes, cut off at different places, equal brute force."""
    rng = random.Random(12)
    period = ["a", "ab", "abcab", "x" * 60 + "y", "".join(rng.choice("abcdef") for _ in range(130))]
    text = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [text(rng.randint(0, 90)) + (p * 700)[rng.randint(0, 9) :][: rng.randint(90, 700)] + text(rng.randint(0, 90)) for p in period * 8]
    rng.shuffle(texts)
    got = suffix_dedup.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), block=2_000, size=900).collect()
    want = compare(got, range(len(texts)), [t.encode() for t in texts])
    assert sum(len(s) for s, _ in want) > 30


def test_segments_hold_every_window_once_and_their_kinds_too():
    import pandas as pd

    bodies = [t.encode() for t in corpus(5) if len(t.encode()) >= MATCH]
    frame = pd.DataFrame({"windows": [len(b) - MATCH + 1 for b in bodies], "doc": range(len(bodies)), "tie": 0, "start": 0, "body": bodies})
    found = suffix_dedup.Segments(suffix_dedup.Block(suffix_dedup._blocked(frame, 0)))
    windows = np.flatnonzero(found.block.beyond < 0)
    places = lambda first, end: sorted(p for a, z in zip(first.tolist(), end.tolist()) for p in range(a, z))
    assert places(found.first, found.first + found.windows) == windows.tolist()
    marks = list(found.marks())
    assert places(np.concatenate([a for _, a, _ in marks]), np.concatenate([z for _, _, z in marks])) == windows.tolist()
    # Equal windows lie in stretches of equal marks.
    mark = {p: t for m, first, end in marks for t, a, z in zip(m.tolist(), first.tolist(), end.tolist()) for p in range(a, z)}
    seen = {}
    for p in windows.tolist():
        assert seen.setdefault(found.block.text[p : p + MATCH].tobytes(), mark[p]) == mark[p]
    assert len(seen) < len(windows)
