import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from perilframe.llm import jaccard_join as J
from perilframe.llm.common import hash_words
from perilframe.llm.graph import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType()), T.StructField("t", T.StringType())])


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=3, percent=90):
    sets = [shingles(t, k) if i is not None else set() for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(rows[i][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(shingles(t, k)), find(i) if i is not None else None, n) for (i, t), n in zip(rows, links)), key=str)


def corpus(seed, families=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    passage = [rng.choice(words) for _ in range(120)]
    out = [None, "", "  \n\t", "one", "ONE", "one two", "one two three", "One\x0btwo\x0cthree", "é É", "é é"]
    for f in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 40, 150, 400]))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(words)
            if f % 3 == 0:
                w = w + passage
            out.append((" " if rng.random() < 0.8 else "\n").join(w))
    out += [rng.choice(out[10:]) for _ in range(20)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "CELL_ROWS", 12)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in J.join(df).collect()), key=str) == brute(rows)


def test_join_edge_rows(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (3, None), (9, "A b C d"), (11, "x")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in J.join(df).collect()), key=str)
    assert got == sorted([(7, 2, 7, 2), (7, 2, 7, 2), (None, 2, None, 0), (3, 0, 3, 0), (9, 2, 7, 2), (11, 1, 11, 0)], key=str)
    assert J.join(df.limit(0)).count() == 0


def test_words_by_windows(monkeypatch):
    from perilframe.llm import common

    data = "".join(random.Random(5).choice("ab  \n\té") for _ in range(3000)).encode() + b"x" * 500 + b" end"
    whole = hash_words(data)
    monkeypatch.setattr(common, "_WINDOW", 64)
    common._POW.clear()
    parts = hash_words(data)
    common._POW.clear()
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert [data[a:b] for a, b in zip(whole[1], whole[2])] == data.split()
    words = data.split()
    assert len({w: h for w, h in zip(words, whole[0].tolist())}) == len(set(whole[0].tolist()))


def test_forest_and_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in parent if find(x) != x}
    m = np.zeros((400, 400), bool)
    for a, b in edges[:330]:
        m[a, b] = m[b, a] = True
    nodes = rng.permutation(400)
    root = J.forest(nodes, m[np.ix_(nodes, nodes)] & ~np.eye(400, dtype=bool))
    small = {}
    for a, b in edges[:330]:
        pass
    parent.clear()
    for a, b in edges[:330]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert root.tolist() == [find(int(x)) for x in nodes]


def test_meetings_by_blocks_and_by_pairs(monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    rows = []
    for _ in range(40):
        s = np.unique(np.where(rng.random(60) < 0.04, rng.integers(0, 2**63, 60, dtype=np.uint64), base))
        s = np.unique(s & ~J._LOW)
        ((_, p, v, chosen),) = J.prefixes(s, np.array([0, len(s)]), np.full(1 << 16, 8, np.uint8), 0.0, 90)
        rows.append({"s": s, "p": p, "v": v, "l": chosen, "n": len(s)})
    for left in (None, rng.random(40) < 0.5):
        want = J._pairwise(rows, left, 90)
        assert want.any() and (want == want.T).all()
        for block in (7, 512):
            monkeypatch.setattr(J, "BLOCK_ROWS", block)
            assert (J._meeting(rows, left, 90) == want).all()
    exact = np.array([[i != j and 100 * len(set(a["s"].tolist()) & set(b["s"].tolist())) >= 90 * len(set(a["s"].tolist()) | set(b["s"].tolist())) for j, b in enumerate(rows)] for i, a in enumerate(rows)])
    assert (J._pairwise(rows, None, 90) == exact).all()
