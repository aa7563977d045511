"""Exact top-k by integer inner product over norm-sorted, SVD-rotated vectors.

Vectors become integers and are written once in blocks of descending length, over the whole
table. Their second-moment matrix, summed over all rows, gives a rotation that gathers the
length in the first dimensions. Rounds take the first block, then ranges of blocks four times
as long each; blocks of queries and blocks of vectors meet in tasks of their own. The k-th
scores found so far go along with the queries: a query leaves for good when its length times
the greatest length to come cannot reach its k-th score; within a block partial sums over the
leading rotated dimensions plus the product of the residual lengths (Cauchy-Schwarz) decide
which vectors are scored. Scores are exact integers; ones beyond the range of a long count as
its greatest or least value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.llm import common

K = 5
#: Queries and vectors that meet in one task.
QUERY_BLOCK, ROWS = 4096, 8192
BLOCK = 512
SLACK = 1e-6
#: Inner products of vectors whose lengths multiply to less are exact in doubles.
EXACT = 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Below every score that is found.
NONE = LEAST


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with v = floor(256 x), whole numbers as doubles, which hold them exactly: scaling by a power of two is exact.

    Null vectors and ones with null or non-finite components (of 256 x too) are left out, as are rows without vec_id.
    """
    fine = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(256D * x) < double('Infinity'))"
    whole = "transform(embedding, x -> CASE WHEN abs(256D * x) < 4503599627370496D THEN double(floor(256D * x)) ELSE 256D * x END)"
    return rows.select("vec_id", "embedding").filter("vec_id IS NOT NULL").filter(fine).selectExpr("vec_id", f"{whole} AS v")


def _matrices(batch: pa.RecordBatch, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as a matrix) for each dimension that occurs."""
    col = batch.column(i)
    size = np.asarray(col.value_lengths())
    flat, start = np.asarray(col.flatten(), np.float64), np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat[(start[at][:, None] + np.arange(d)[None, :])] if d else np.zeros((len(at), 0))


def moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Second-moment matrix of the vectors of each dimension, over all rows of (v)."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, m in _matrices(batch, 0):
                sums[m.shape[1]] = sums.get(m.shape[1], 0) + m.T @ m
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["d", "i", "row"])

    parts = vectors.select("v").mapInArrow(run, "d int, i int, row array<double>")
    summed = parts.selectExpr("d", "i", "posexplode(row) AS (j, x)").groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in summed.collect():  # d x d numbers for each dimension
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["x"]
    return out


def rotation(moment: np.ndarray) -> tuple[np.ndarray, int]:
    """The orthogonal rotation and how many leading dimensions hold 80 % of the squared length."""
    value, basis = np.linalg.eigh((moment + moment.T) / 2)
    value, basis = np.maximum(value[::-1], 0), basis[:, ::-1]
    lead = int(np.searchsorted(np.cumsum(value), 0.8 * value.sum())) + 1
    return basis, min(max(1, lead), len(value))


class Best:
    """The k best (score, id) of each query; ties go to the smaller id, repeated rows count each."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE, np.int64)
        self.ids = np.full((n, k), MOST, np.int64)
        self.new = np.zeros((n, k), bool)

    def start(self, q: int, scores: list[int], ids: list[int]) -> None:
        self.score[q, : len(scores)], self.ids[q, : len(ids)] = scores, ids

    def floor(self) -> np.ndarray:
        """The k-th score, and whether there is one."""
        return np.where(self.ids[:, -1] == MOST, -np.inf, self.score[:, -1])

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        new = np.concatenate([self.new[q], np.ones(len(ids), bool)])
        top = np.lexsort((i, -np.maximum(s, LEAST + 1)))[: self.k]
        self.score[q], self.ids[q], self.new[q] = s[top], i[top], new[top]


def scores(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Inner products of one query with rows; `most` bounds the product of their lengths."""
    if most < EXACT:
        return (x @ q).astype(np.int64)
    own = [int(a) for a in q]
    exact = (sum(a * int(b) for a, b in zip(own, row)) for row in x)
    return np.array([min(MOST, max(LEAST, s)) for s in exact], np.int64)


def search(best: Best, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, basis: np.ndarray, lead: int) -> None:
    """Brings the best of each query up to date with the vectors x; a row with the query's id is its own and takes no part."""
    with np.errstate(over="ignore", invalid="ignore"):  # lengths beyond a double bound nothing
        xr, qr = x @ basis, q @ basis
        length, qlength = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        order = np.argsort(-length, kind="stable")
        rest, qrest = np.linalg.norm(xr[:, lead:], axis=1), np.linalg.norm(qr[:, lead:], axis=1)
        alive = np.arange(len(q))
        for at in range(0, len(order), BLOCK):
            rows = order[at : at + BLOCK]
            far = qlength * length[rows[0]]
            slack = SLACK * (1 + far)
            alive = alive[~(far[alive] + slack[alive] < best.floor()[alive])]
            if not len(alive):
                break
            bound = qr[alive, :lead] @ xr[rows, :lead].T + np.outer(qrest[alive], rest[rows])
            may = ~(bound + slack[alive, None] < best.floor()[alive, None]) & (qids[alive, None] != ids[rows][None, :])
            for a in np.flatnonzero(may.any(axis=1)):
                hit, one = rows[may[a]], alive[a]
                found = scores(q[one], x[hit], far[one])
                good = found >= best.floor()[one]
                if good.any():
                    best.add(one, found[good], ids[hit][good])


def ordered(vectors: DataFrame, rows: int) -> tuple[DataFrame, list[float]]:
    """The vectors written in blocks of about `rows` by descending length, and the greatest length from each block on."""
    sized = vectors.select("vec_id", "v", F.size("v").alias("d"), F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))").alias("len"))
    parts = max(1, -(-vectors.count() // rows))
    dealt = sized.repartitionByRange(parts, F.desc("len"), F.xxhash64("vec_id"))  # equal lengths are spread too
    table, _ = common.written(dealt.withColumn("block", F.spark_partition_id()), "vectors")
    tops = {r["block"]: r["top"] for r in table.groupBy("block").agg(F.max("len").alias("top")).collect()}
    top, out = 0.0, []
    for b in range(max(tops, default=-1), -1, -1):  # a block may be empty
        top = max(top, tops.get(b, 0.0))
        out.append(top)
    return table, out[::-1]


_FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query, fewer if there are fewer.

    Both inputs are (vec_id, v). Only vectors of the query's dimension are compared. A query
    id that repeats asks once, with its least vector; rows that repeat count each. Ties go to
    the smaller vec_id. Empty tables give no rows.
    """
    table, tops = ordered(vectors, rows)
    turns = {d: rotation(m) for d, m in moments(table.filter(F.col("len") < EXACT)).items()}
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("len", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))
    asked, _ = common.written(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("len").alias("qlen"), F.size("v").alias("d")), "queries")
    groups = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    best = asked.sparkSession.createDataFrame([], _FOUND)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = Best(0, k)
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            q = np.asarray(right.column("q").combine_chunks().flatten(), np.float64).reshape(right.num_rows, -1)
            x = np.asarray(left.column("v").combine_chunks().flatten(), np.float64).reshape(left.num_rows, -1)
            basis, lead = turns.get(q.shape[1], (np.eye(q.shape[1]), q.shape[1]))
            out, qids = Best(len(q), k), right.column("query_id").to_numpy()
            for i, found in enumerate(right.column("found").to_pylist()):
                if found:
                    found.sort(key=lambda r: (-r["score"], r["vec_id"]))
                    out.start(i, [r["score"] for r in found], [r["vec_id"] for r in found])
            search(out, left.column("vec_id").to_numpy(), x, qids, q, basis, lead)
            n, j = np.nonzero(out.new)
            return pa.table({"query_id": qids[n], "vec_id": out.ids[n, j], "score": out.score[n, j]})
        return pa.table({x: np.zeros(0, np.int64) for x in ("query_id", "vec_id", "score")})

    at, step = 0, 1
    while at < len(tops):
        end = min(len(tops), at + step)
        known = best.groupBy("query_id").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))  # k at most
        alive = asked.join(known, "query_id", "left") if at else asked.withColumn("found", F.lit(None).cast("array<struct<score: bigint, vec_id: bigint>>"))
        worst = F.when(F.size("found") >= k, F.array_min(F.col("found.score")).cast("double"))
        reach = F.col("qlen") * F.lit(tops[at])
        alive = alive.filter(worst.isNull() | ~(reach + SLACK * (1 + reach) < worst))
        if at:
            alive, _ = common.written(alive, "alive")
            if alive.isEmpty():
                break
        right = alive.withColumn("block", F.explode(F.sequence(F.lit(at), F.lit(end - 1))))
        left = table.filter(F.col("block").between(at, end - 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        found = left.groupBy("block", "part", "d").cogroup(right.groupBy("block", "part", "d")).applyInArrow(meet, _FOUND)
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        merged = best.unionByName(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
        best, _ = common.written(merged, "best")
        at, step = end, step * 4
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 best rows for each row whose id is divisible by 50; vectors with null or non-finite components take no part."""
    vectors = quantised(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT vec_id, min(v) AS v FROM fine WHERE vec_id % 50 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM asked q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
