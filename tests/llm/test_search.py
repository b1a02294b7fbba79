import numpy as np
import pytest
from pyspark.sql import types as T

from perilframe.llm import ann, topk, vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("range", T.StringType()), T.StructField("v", T.StringType())])


def data(seed, n=700, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    x = (centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, d))).astype(np.float32) / 4
    x[100:160] = x[40]
    x[200:203] = 0
    rows = [[i, x[i].tolist(), 1, "a", "b"] for i in range(n)]
    rows[20][1] = None
    rows[40 + 21][1][3] = None
    rows[80][1][2] = float("nan")
    rows[81][1][2] = float("inf")
    rows[82][1] = []
    rows[83][1] = [1.0, 2.0]
    rows.append([None, x[5].tolist(), 1, "a", "b"])
    rows.append([250, x[6].tolist(), 1, "a", "b"])
    return rows


def brute(rows, k, every, integer):
    d = 16
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and len(v) == d and all(y is not None and np.isfinite(y) for y in v)]
    if integer:
        good = [(i, np.floor(256 * v)) for i, v in good]
    else:
        good = [(i, v) for i, v in good if v.any()]
    ids, m = np.array([g[0] for g in good]), np.stack([g[1] for g in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            s = m @ v
            other = ids != i
            order = np.lexsort((ids[other], -s[other]))[:k]
            out.setdefault(i, []).append(list(zip(ids[other][order].tolist(), s[other][order].tolist())))
    return out


@pytest.mark.parametrize("ranges", [8192, 90])
def test_topk_is_exact(spark, ranges, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", ranges)
    monkeypatch.setattr(topk, "QUERIES", 6)
    monkeypatch.setattr(topk, "SAMPLE", 64)
    rows = data(1)
    want = brute(rows, 5, 50, True)
    got = {}
    for r in topk.search(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    for q, x in got.items():
        if len(want[q]) == 1:
            assert [(a, b) for _, a, b in sorted(x)] == [(a, int(b)) for a, b in want[q][0]] and [r for r, _, _ in sorted(x)] == [1, 2, 3, 4, 5]


def test_blocks_prune():
    rng = np.random.default_rng(2)
    m = np.floor(np.repeat(rng.standard_normal((20, 8)) * 256, 64, axis=0) + rng.integers(-9, 9, (1280, 8)))
    assert sorted(topk.in_blocks(m).tolist()) == list(range(1280))
    calls = []
    whole = topk.product

    def counted(a, b):
        calls.append(len(b))
        return whole(a, b)

    topk.product = counted
    try:
        found = list(topk.search_range(m, [np.array([i]) for i in range(1280)], m[:1], np.array([-(2**62)]), 5))
    finally:
        topk.product = whole
    assert sum(calls[2:]) < 600
    s = m @ m[0]
    assert found[0][2].tolist() == np.sort(s)[::-1][:6].astype(int).tolist()


def test_ranges_hold_alike_vectors_and_few_are_visited(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "MEETINGS", 1)
    monkeypatch.setattr(topk, "EXTREMES", 8)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((16, 16))
    x = (centres[np.arange(1200) % 16] + 0.05 * rng.standard_normal((1200, 16))).astype(np.float32)
    rows = [[i, x[i].tolist(), 1, "a", "b"] for i in range(1200)]
    sent, ranges = [], []
    whole = topk._sent

    def counted(queries, extremes, *rest):
        out = topk.stored(whole(queries, extremes, *rest), "sent")
        sent.append(out.selectExpr("sum(q_n)").first()[0] or 0)
        ranges.append(extremes.selectExpr("sum(length(parts)) / 8").first()[0])
        return out

    monkeypatch.setattr(topk, "_sent", counted)
    got = {}
    for r in topk.search(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 5, 50, True)
    assert {q: [(a, b) for _, a, b in sorted(v)] for q, v in got.items()} == {q: [(a, int(b)) for a, b in v[0]] for q, v in want.items()}
    assert ranges[0] >= 16 and sum(sent) < 0.4 * 24 * ranges[0]


def test_ranges_place_every_vector():
    rng = np.random.default_rng(9)
    m = np.floor(rng.standard_normal((500, 4)) * 256)
    at = topk.Ranges(m[:64], 3).place(m)
    assert set(at) == set(range(8)) and np.bincount(at).max() < 200
    assert set(topk.Ranges(np.ones((9, 4)), 2).place(m)) == {0}
    assert set(topk.Ranges(np.zeros((0, 0)), 0).place(m)) == {0}


def test_few_rows(spark):
    rows = data(3)[:1] + [[100, [0.5] * 16, 1, "a", "b"], [7, [0.5] * 16, 1, "a", "b"]]
    df = spark.createDataFrame(rows, SCHEMA)
    assert topk.search(df).count() == 4 and ann.search(df).count() == 4
    assert topk.search(df.limit(0)).count() == 0 and ann.search(df.limit(0)).count() == 0
    one = df.where("vec_id = 100")
    assert topk.search(one).count() == 0 and ann.search(one).count() == 0


def test_ann_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 40)
    monkeypatch.setattr(ann, "LIST_PART", 64)
    monkeypatch.setattr(ann, "SAMPLE", 500)
    rows = data(4)
    want = brute(rows, 20, 20, False)
    got = {}
    for r in ann.search(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = total = 0
    vec = {i: np.array(v, np.float64) for i, v, *_ in rows if i is not None and v}
    for q, x in got.items():
        x.sort()
        assert [r for r, _, _ in x] == list(range(1, 21)) and all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(x, x[1:]))
        if q != 250:
            for _, i, s in x:
                if i != 250:
                    assert abs(s - vec[q] @ vec[i]) < 1e-12
            floor = want[q][0][-1][1]
            hit += sum(s >= floor - 1e-12 for _, _, s in x)
            total += 20
    assert hit / total >= 0.9


def test_adaptive_scan_abandons_and_keeps():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    q = x[0] + 0.05 * rng.standard_normal(64)
    y = np.ascontiguousarray(x.T)
    d = ((x - q) ** 2).sum(axis=1)
    limit = np.sort(d)[20]
    who, alive = ann.scan([y[a : a + 16] for a in range(0, 64, 16)], np.stack((q, q)), np.array([limit, 0.0]))
    assert set(who) == {0}
    assert len(set(alive) & set(np.argsort(d)[:21])) >= 19 and len(alive) <= 21


def test_usual_length(spark):
    df = spark.createDataFrame([[1, [1.0, 2.0], 0, "", ""], [2, [1.0], 0, "", ""], [3, [3.0, 4.0], 0, "", ""]], SCHEMA)
    assert {r.vec_id for r in vectors.usable(df, True).collect()} == {1, 3}
