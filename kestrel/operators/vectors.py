"""Hash embeddings, cosine search in blocks of queries, k-means."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import text as T

DIM = 384
_TOKEN = re.compile(r"[^ \t\n\x0b\f\r]+")


def hash_cell(token: Column, dim: int = DIM) -> tuple[Column, Column]:
    """(place, sign) of a token: little-endian first four bytes of its sha256 modulo dim, parity of the fifth."""
    h = F.sha2(token, 256)
    le = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return (F.conv(le, 16, 10).cast("bigint") % dim).cast("int"), F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def hash_cells(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, idx, value) of the non-zero cells of the embedding of each text, before normalising."""
    words = rows.select("id", F.explode(T.tokens(F.lower(F.coalesce("text", F.lit(""))))).alias("t")).groupBy("id", "t").agg(F.count("*").alias("n"))
    idx, sign = hash_cell(F.col("t"), dim)
    return words.select("id", idx.alias("idx"), (sign * F.col("n")).alias("v")).groupBy("id", "idx").agg(F.sum("v").alias("value")).filter("value <> 0")


class Cells(dict):
    """(place, sign) of each token, kept while few enough."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        h = hashlib.sha256(token.encode()).digest()
        found = self[token] = int.from_bytes(h[:4], "little") % self.dim, 1 if h[4] % 2 == 0 else -1
        return found


def hash_embed(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, embedding): the cells of each text as a dense vector of length one, in one pass; texts without tokens are left out."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = Cells(dim)
        for batch in batches:
            ids, out = [], []
            for key, text in zip(batch["id"], batch["text"]):
                found = _TOKEN.findall((text or "").lower())
                if found:
                    at = np.array([cells[t] for t in found])
                    v = np.bincount(at[:, 0], at[:, 1], dim)
                    out.append((v / (np.linalg.norm(v) + 1e-9)).astype(np.float32))
                    ids.append(key)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=batch["id"].dtype), "embedding": pd.Series(out, dtype=object)})

    return rows.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<float>")


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of (id, embedding) for each (query_id, embedding).

    Queries go in blocks of about `block`, each a pass over the vectors: give a written table.
    A task keeps its own k best of all its rows, then they meet by query. Rows without an embedding take no part.
    Scores are rounded to five digits before ranking; ties go to the smaller id.
    """
    queries, vectors = (x.filter("embedding IS NOT NULL") for x in (queries, vectors))
    blocks = max(1, -(-queries.count() // block))
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    out = queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double")
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        ids = np.array([r["query_id"] for r in rows], object)
        q = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
        q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-9)

        def run(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            score, best = np.empty((len(ids), 0)), np.empty((len(ids), 0), object)
            for batch in batches:
                for lo in range(0, len(batch) if len(ids) else 0, 2000):
                    some = batch.iloc[lo : lo + 2000].sort_values("id")
                    own, n = some["id"].to_numpy(), len(some)
                    x = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                    s = np.rint(q @ (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)).T * 1e5).astype(np.int64)
                    at = np.argpartition(-(s * n + np.arange(n)[::-1]), min(k, n) - 1, axis=1)[:, :k]  # no two keys are equal
                    score = np.hstack([score, np.take_along_axis(s, at, 1) / 1e5])
                    best = np.hstack([best, own[at].astype(object)])
                    order = np.lexsort((best, -score), axis=1)[:, :k]
                    score, best = np.take_along_axis(score, order, 1), np.take_along_axis(best, order, 1)
            yield pd.DataFrame({"query_id": np.repeat(ids, score.shape[1]), "id": best.ravel(), "score": score.ravel()})

        out = out.unionByName(vectors.select("id", "embedding").mapInPandas(run, out.schema))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def kmeans(vectors: DataFrame, n_clusters: int = 5, seed: int = 42) -> DataFrame:
    """(id, cluster) by k-means; k = clamp(n / 6, max(12, n_clusters), 120), at most n."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    k = min(max(round(n / 6), 12, n_clusters), 120, max(n, 1))
    rows = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=max(2, k), seed=seed, maxIter=10).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))
