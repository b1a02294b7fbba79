import random

import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline as P

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("extra", T.StringType())])
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    en, de = "the and ing tion of her wh es".split(), "der die ung sch ein ich zu ß".split()
    rows = {i: (prose(rng, en if i % 2 else de, 60 + i), "en" if i % 2 else "de") for i in range(40)}
    passage = prose(rng, en, 60)
    for i in (3, 9, 21):
        rows[i] = (rows[i][0] + " " + passage, "en")
    copy = rows[5][0].split(" ")
    copy[4] = "changed"
    rows |= {50: (rows[5][0], "en"), 51: (" ".join(copy), "en"), 60: ("1234 5678 !!", None), 61: (None, "en"), 62: ("", "en"), 63: (prose(rng, en, 40) + " call +1 (988) 555-2485 now", None)}
    data = [(i, t, x, "s", None if t is None else len(t), "e") for i, (t, x) in rows.items()] + [(63, rows[63][0], None, "s", len(rows[63][0]), "e")]
    docs, kept = spark.createDataFrame(data, SCHEMA), []
    for name, stage in P.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), "none")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == COLUMNS
    texts = [{r.doc_id: r.text for r in d.collect()} for d in kept[:4]]
    assert set(texts[0]) == set(rows) - {60, 61, 62}
    # 51 differs in three or fewer of over 60 shingles: it links with 5 and 50.
    assert set(texts[1]) == set(texts[0]) - {50, 51} and kept[1].count() == len(texts[1])
    inner = " ".join(passage.split(" ")[16:40])
    assert [i for i, t in texts[2].items() if inner in t] == [3] and set(texts[2]) == set(texts[1])
    assert all(texts[2][i] == texts[1][i] for i in texts[1] if i not in (9, 21))
    assert "988" not in texts[3][63] and all(texts[3][i] == texts[2][i] for i in texts[2] if i != 63)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts[3].items()}
    got = {r.doc_id: r.n for r in kept[4].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want and kept[4].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_near_copies_of_080_link(spark):
    # Two scattered words of 100 changed: 86 of 106 five-word shingles, but 92 of 104 three-word ones.
    words = [f"w{i}" for i in range(100)]
    near, far = list(words), list(words)
    for i in (30, 70):
        near[i] = "changed"
    for i in (20, 40, 60, 80):
        far[i] = "other"
    data = [(i, " ".join(w), "en", "s", 9, "e") for i, w in enumerate((words, near, far))]
    got = P.jaccard_dedup(spark, spark.createDataFrame(data, SCHEMA), "none").collect()
    assert sorted(r.doc_id for r in got) == [0, 2]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "none")
        assert docs.count() == 0
