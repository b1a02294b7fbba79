"""Vectors as packed rows, for the searches of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of vectors without null or non-finite components, of the usual length.

    The usual length is the most frequent one. ``zero``: whether all-zero vectors take part.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = df.where("vec_id is not null and embedding is not null and size(embedding) > 0").select("vec_id", v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (usual[0]["d"] if usual else 0))


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): distinct vectors and their ``keep`` least ids. No result of a search for keep - 1 needs more."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.select("vec_id", "v").withColumn("r", rank).where(F.col("r") <= keep).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def packed(rows: DataFrame, by: str, most: int, total: int, floors: bool = False) -> DataFrame:
    """Rows (key, v, ids) of each ``by``, dealt by hash to parts of about ``most``: (by, part, n, vectors, ids, counts).

    ``floors``: rows have a ``floor``, a long, and parts a column of them.
    """
    sizes = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("parts"))
    dealt = rows.join(sizes, by).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        ids = [np.asarray(x, np.int64) for x in frame["ids"]]
        out = {
            by: frame[by].iloc[:1].array, "part": frame["part"].iloc[:1].array, "n": [len(frame)], "vectors": [matrix(frame["v"]).tobytes()],
            "ids": [np.concatenate(ids).tobytes()], "counts": [np.array([len(x) for x in ids], np.int64).tobytes()],
        }
        return pd.DataFrame(out | ({"floors": [frame["floor"].to_numpy(np.int64).tobytes()]} if floors else {}))

    return dealt.groupBy(by, "part").applyInPandas(pack, f"{by} long, part long, n long, vectors binary, ids binary, counts binary" + ", floors binary" * floors)


def unpack(n: int, data: bytes, ids: bytes, counts: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    m = np.frombuffer(data, np.float64).reshape(n, -1)
    return m, np.split(np.frombuffer(ids, np.int64), np.cumsum(np.frombuffer(counts, np.int64))[:-1])


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` distinct vectors, those with the least hashes: a bounded sample of all rows."""
    return matrix(pd.Series([r["v"] for r in rows.select("v").orderBy(F.xxhash64("v")).limit(most).collect()]))


def ranked(found: DataFrame, k: int, score: str) -> DataFrame:
    """The k best of (query_id, vec_id, score), ties to smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score).alias("score"))


def expand(found: Iterator[tuple[int, np.ndarray, np.ndarray]], queries: list[np.ndarray]) -> pd.DataFrame:
    """Rows for (query number, vec_ids, scores) triples, one for each id of the query but the vector's own."""
    who, vecs, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, ids, scores in found:
        who.append(np.repeat(queries[q], len(ids)))
        vecs.append(np.tile(ids, len(queries[q])))
        values.append(np.tile(scores, len(queries[q])))
    out = pd.DataFrame({"query_id": np.concatenate(who), "vec_id": np.concatenate(vecs), "score": np.concatenate(values)})
    return out[out["query_id"] != out["vec_id"]]
