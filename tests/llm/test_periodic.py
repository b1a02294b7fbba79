"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from perilframe.llm import periodic
from perilframe.llm.queries import queries


def brute(s, least=12):
    """(start, length, period) of all maximal runs, by trying every period."""
    n, out = len(s), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                t = s[i : j + q]
                if not any(all(t[x] == t[x + r] for x in range(len(t) - r)) for r in range(1, q)):
                    out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(600):
        k, least, n = rng.choice([1, 2, 2, 3]), rng.choice([2, 3, 4, 12]), rng.randint(0, 45)
        s = [rng.randint(1, k) for _ in range(n)]
        if s and rng.random() < 0.5:
            s = (s[: rng.randint(1, 9)] * 12)[: rng.randint(1, n)] + s[: rng.randint(0, 9)]
        assert [tuple(x) for x in periodic.runs(s, least).tolist()] == brute(s, least), (s, least)


def test_texts_are_read_where_they_repeat():
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 120))]
        at, p = rng.randint(0, len(words)), rng.randint(1, 30)
        texts.append(" ".join(words[:at] + (words[at : at + p] * 9)[: rng.randint(0, 150)] + words[at:]).encode())
    words, found = periodic.text_runs(texts)
    for t, ws, f in zip(texts, words, found):
        assert ws == t.split()
        assert [tuple(x) for x in f.tolist()] == brute(ws)


def test_least_values_of_ranges():
    import numpy as np

    values = np.random.default_rng(3).integers(0, 1000, 700).astype(np.int32)
    least = periodic.RangeMin(values)
    a = np.random.default_rng(4).integers(0, 700, 3000)
    b = np.minimum(a + np.random.default_rng(5).integers(0, 700, 3000), 699)
    assert (least(a, b) == [values[x : y + 1].min() for x, y in zip(a, b)]).all()


EDGES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "x " * 40), (None, None), (7, "a b " * 6), (7, "a b " * 6), (8, "a b " * 5 + "a"), (9, "ä ö " * 30),
    (2**62 + 1, "x y z " * 5 + "q " + "x y z " * 5), (10, "w" * 100_000), (11, " ".join(str(i % 700) for i in range(30_000))),
]


def test_edges(spark):
    """Null and shared ids, null, empty and very long texts, and clashing names."""
    docs = spark.createDataFrame([(i, t, t, 0) for i, t in EDGES], "doc_id long, text string, runs string, collapsed int")
    got = sorted(periodic.collapse(docs).collect(), key=lambda r: (str(r["doc_id"]), r["collapsed"]))
    want = []
    for i, t in EDGES:
        ws = (t or "").encode().split()
        f = [(0, 30_000, 700)] if i == 11 else brute(ws)
        gone = {k for s, n, p in f for k in range(s + p, s + n)}
        want.append((i, f, b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    want.sort(key=lambda r: (str(r[0]), r[2]))
    assert [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got] == want
    assert periodic.collapse(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in queries()["op11_periodic_runs"](spark, f"/root/testdata/{sf}").collect()}
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    n_found = 0
    for d in docs:
        ws = (d["text"] or "").encode().split()
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(ws)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        elif n > 3000:
            continue  # too long for brute force
        if n > 1500:
            ws_found = [tuple(x) for x in periodic.runs([*map({w: k + 1 for k, w in enumerate(dict.fromkeys(ws))}.get, ws)]).tolist()]
        else:
            ws_found = brute(ws)
        n_found += len(ws_found)
        gone = {k for s, m, p in ws_found for k in range(s + p, s + m)}
        r = got[d["doc_id"]]
        best = min(ws_found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(ws_found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if ws_found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in ws_found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for k, w in enumerate(ws) if k not in gone)).hexdigest()
    assert n_found > 5
