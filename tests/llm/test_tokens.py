import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from perilframe.llm import dac, edit_counts, packing, treebpe
from perilframe.llm.bpe import Bpe, bpe, ids_of

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = [*"aab'st  \n\t!.,éÉ<|>5²x_", "'s", "'re", " the", "<|endoftext|>", " ", "’", "ß", "Ω", "中", "\x1c", "\x85", "́", "İ", "\v", "ing", "tion"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType()), T.StructField("row", T.StringType())])


def fuzz(n, most=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def texts():
    rng = random.Random(7)
    word = "".join(rng.choice("abcdefghij") for _ in range(5000))
    return [None, "", "a", "a", " ", "<|endoftext|>", word, "ab " * 3000, "日本語" * 800, *fuzz(60), *(["same text again."] * 5)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_librarys(path):
    lib, own = Tokenizer.from_file(path), Bpe(path, limit=500)
    for t in fuzz(4000):
        assert ids_of(own.encode(t)).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_tree_joins_exactly():
    lib = Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    letters = "".join(rng.choice("etaoinshrd") for _ in range(6000))
    for t in [*fuzz(300, 400), letters, "é" * 3000, "日本" * 2000, "1" * 3000, "!'" * 1500, "a<|endoftext|>b" * 300, "hello world " * 500]:
        for leaf in (7, 64, 501):
            assert treebpe.encode_text(t, BYTE, leaf).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_tree_documents(spark):
    rows = list(enumerate(texts())) + [(None, "x y"), (3, "a")]
    lib = Tokenizer.from_file(BYTE)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in treebpe.digests(frame(spark, rows), BYTE, leaf_chars=100).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert treebpe.digests(frame(spark, []), BYTE).count() == 0


def test_dac_round_trip(spark, tmp_path):
    rows = list(enumerate(texts()))
    random.Random(2).shuffle(rows)
    lib = Tokenizer.from_file(WORD)
    at, want = 0, []
    for i, t in sorted(rows):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    out = f"file://{tmp_path}/dac"
    dac.write(frame(spark, rows).repartition(3), WORD, out, segment_ids=700)
    assert sorted(tuple(r) for r in dac.read(spark, out).collect()) == want
    assert dac.round_trip(frame(spark, [(5, None), (5, None), (None, "b")]), WORD).count() == 3
    assert dac.round_trip(frame(spark, []), WORD).count() == 0


@pytest.mark.parametrize("bits", [4, 8, 12])
def test_dac_random_access(bits):
    rng = np.random.default_rng(1)
    ids = np.concatenate((rng.integers(0, 300, 2000), rng.integers(0, 50_000, 3000), [0, 2**32 - 1])).astype(np.uint32)
    rng.shuffle(ids)
    s = dac.Segment(dac.encode_segment(ids, np.array([0, 10, 10, len(ids)]), bits))
    assert [s[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
    for a, b in ((0, len(ids)), (511, 513), (1024, 1024), (600, 3333)):
        assert s.range(a, b).tolist() == ids[a:b].tolist()
    assert s.document(1).tolist() == [] and s.document(0).tolist() == ids[:10].tolist()
    with pytest.raises(IndexError):
        s[len(ids)]


def test_dac_point_reads_from_files(spark, tmp_path, capsys):
    rows = list(enumerate(texts())) + [(3, "again"), (None, "no id")]
    out = f"file://{tmp_path}/dac"
    dac.write(frame(spark, rows).repartition(3), WORD, out, segment_ids=700)
    lib = Tokenizer.from_file(WORD)
    ids = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    places = [(i, p) for i, x in ids if i is not None for p in (0, 1, len(x) // 2, len(x) - 1, len(x), -1)]
    ask = lambda some: spark.createDataFrame(some, "doc_id long, position long")
    got = sorted((tuple(r) for r in dac.tokens_at(spark, out, ask([*places, places[0], (10**9, 0), (None, 0), (1, None)])).collect()), key=str)
    want = [(i, p, x[p] if 0 <= p < len(x) else None) for i, p in set(places) for j, x in ids if j == i]
    assert got == sorted(want, key=str)
    dac.tokens_at(spark, out, ask([(2, 0)])).explain("formatted")
    plan = capsys.readouterr().out
    assert "In(part" in plan or "EqualTo(part" in plan
    assert all("data" not in line for line in plan.splitlines() if "ReadSchema" in line and "doc_ids" in line)
    assert dac.tokens_at(spark, out, ask([])).count() == 0


def test_packing(spark):
    rows = list(enumerate(texts())) + [(3, "a")]
    got = packing.pack(frame(spark, rows), BYTE, group_pieces=40).toPandas()
    lib = Tokenizer.from_file(BYTE)
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert got["length"].sum() == sum(len(ids[i]) for i, _ in rows)
    for doc, g in got[got.doc_id != 3].groupby("doc_id"):
        g = g.sort_values("start")
        assert (g["start"].to_numpy() == np.r_[0, g["length"].cumsum().to_numpy()[:-1]]).all() and g["length"].sum() == len(ids[doc])
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.r_[0, g["length"].cumsum().to_numpy()[:-1]]).all() and g["length"].sum() <= 1024
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def test_differencing_balances_and_raises_the_count():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 257, 3000)
    sums = np.bincount(packing.divide(sizes, 1024), weights=sizes)
    assert sums.max() <= 1024 and sums.sum() / (1024 * len(sums)) > 0.99
    sums = np.bincount(packing.divide(np.full(7, 600), 1024), weights=np.full(7, 600))
    assert sums.max() <= 1024 and len(sums) == 7
    assert np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4]).max() <= 16


def test_edits_follow_full_encoding():
    rng, encoder = random.Random(9), bpe(BYTE)
    for text in [*fuzz(150, 300, 5), "word " * 500, "x" * 900, ""]:
        leaves = edit_counts.cut_leaves(text, 20)
        assert "".join(leaves) == text
        tree = edit_counts.CountTree(leaves, edit_counts.count(encoder, leaves))
        for _ in range(8):
            at, n, new = rng.randint(0, len(text)), rng.randint(0, 30), rng.choice(["", " ", "new words ", "\n", "'s", "x"])
            text = text[:at] + new + text[at + n :]
            tree.edit(encoder, at, n, new)
            assert "".join(tree.leaves) == text
            assert tree.total() == len(encoder.encode(text)) // 4


def test_edit_counts_documents(spark):
    rows = [(1, "mail me.2@x.example.com or call +1 (555) 555-0199 now " * 30), (2, None), (3, ""), (4, "nothing here"), (4, "nothing here"), (None, "4111 1111 1111 1111")]
    docs = edit_counts.redactions(frame(spark, rows))
    edited = {(r.doc_id, r.text): r.edits for r in docs.select("doc_id", "text", "edits").collect()}
    got = edit_counts.count_edited(docs, BYTE).collect()
    assert len(got) == len(rows)
    want = {}
    for (i, t), edits in edited.items():
        new = t or ""
        for e in reversed(edits):
            new = new[: e.start] + e.insert + new[e.start + e.length :]
        want[i] = (len(bpe(BYTE).encode(t)) // 4, len(bpe(BYTE).encode(new)) // 4, len(edits))
    assert {r.doc_id: (r.n_tokens, r.n_tokens_edited, r.n_edits) for r in got} == want and want[1][2] == 60 and want[None][2] == 1
    assert edit_counts.count_edited(edit_counts.redactions(frame(spark, [])), BYTE).count() == 0


def test_redactions_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "write to a.b@c.org now", "p", "f")], "doc_id long, text string, parts string, found string")
    r = edit_counts.redactions(df).first()
    assert (r.parts, r.found, [tuple(e) for e in r.edits]) == ("p", "f", [(9, 9, "[removed]")])
