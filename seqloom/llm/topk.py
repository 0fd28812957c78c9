"""Exact top-k inner-product search over an impact-ordered index, score at a time.

A component's posting list is cut into segments of equal quantised value. A query
goes through the segments of all components by descending impact, the greatest size
of a product in the segment, and adds up each row's products. What a row has still
ahead is bounded twice: by the impact reached times the components to come, and by
the norms of the query and the row over these (Cauchy and Schwarz). Rows that can't
reach the k-th score found so far drop out; once few are left, which the bounds prove
for all others, these are scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.session import materialise

#: Quantised values of a component within a block.
LEVELS = 32
#: Share of the postings after which the stop is tested.
TESTS = (0.35, 0.42, 0.5, 0.6, 0.7, 0.8)
#: Rows that are scored at once for a first bar, and share of rows that it pays to score instead of going on.
FIRST, FEW = 32, 1 / 6
#: No score known yet.
NO_BAR = -(1 << 62)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(vec_id long, v array<long>)`` of the rows whose vector is whole: no null, not a number or infinity."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


class ImpactIndex:
    """Posting segments of one block of vectors: for each component and quantised value the rows holding it, and their values."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        by = np.argsort(ids, kind="stable")  # ties in score go to the smaller id
        self.ids, self.x = ids[by], x[by]
        n, dims = x.shape
        low, high = self.x.min(0), self.x.max(0)
        level = (self.x - low) * levels // (high - low + 1)
        code = (np.arange(dims) * levels + level).T.ravel()  # component by component
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
        self.begin, self.end = first, np.r_[first[1:], n * dims]
        self.rows, self.dim = (order % n).astype(np.int32), code[order][first] // levels
        self.values = self.x.T.ravel()[order].astype(np.float64)
        self.most = np.maximum.reduceat(np.abs(self.values), first)
        self.norms = (self.x.astype(np.float64) ** 2).sum(1)
        #: Postings gone through and rows scored exactly, of all that there were.
        self.done, self.postings, self.scored, self.held = 0, 0, 0, 0

    def top(self, q: np.ndarray, own: int, k: int, bar: int = NO_BAR) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, id)`` but for rows of the id ``own``; those below ``bar``, a score that k others have, may be left out.

        The search stops when no more rows than it pays to score can still reach the bar.
        Sums of products of integers are exact as long as they fit 53 bits; the bounds
        allow for what they lose beyond, and the scores given are 64-bit integers.
        """
        n, dims = self.x.shape
        mine = self.ids == own
        k = min(k, n - int(mine.sum()))
        if not k:
            return []
        weight = np.abs(q[self.dim]) * self.most
        order = np.argsort(-weight, kind="stable")
        size = (self.end - self.begin)[order]
        upto = np.cumsum(size)
        loss = 1 + 1e-12 * dims * float(weight.max(initial=0))
        acc, left, q_left, x_left = np.zeros(n), np.full(n, float(dims)), np.full(n, float((q.astype(np.float64) ** 2).sum())), self.norms.copy()
        possible, done = np.flatnonzero(~mine), 0
        self.postings += n * dims
        self.held += len(possible)
        for share in TESTS:
            stop = int(np.searchsorted(upto, share * n * dims))
            some = order[done:stop]
            if len(some):
                count = self.end[some] - self.begin[some]
                at = np.repeat(self.begin[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
                rows, x, y = self.rows[at], self.values[at], np.repeat(q[self.dim[some]].astype(np.float64), count)
                acc += np.bincount(rows, x * y, n)
                left -= np.bincount(rows, minlength=n)
                q_left -= np.bincount(rows, y * y, n)
                x_left -= np.bincount(rows, x * x, n)
                self.done += len(at)
                done = stop
            ahead = float(weight[order[done]]) if done < len(order) else 0.0
            reach = acc + np.minimum(np.sqrt(np.maximum(q_left, 0) * np.maximum(x_left, 0)) * (1 + 1e-9), left * ahead) + loss
            best = possible[np.argsort(-acc[possible], kind="stable")[: k + FIRST]] if len(possible) > k + FIRST else possible
            if len(best) >= k:
                self.scored += len(best)
                bar = max(bar, int(np.sort(self.x[best] @ q)[-k]))
            possible = possible[reach[possible] >= bar]
            if len(possible) <= max(k + FIRST, n * FEW):
                break
        scores = self.x[possible] @ q
        self.scored += len(possible)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return [(int(scores[i]), int(self.ids[possible[i]])) for i in best if scores[i] >= bar]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which add nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and lens.min() == lens.max():
        return values.reshape(len(lens), -1)
    out = np.zeros((len(lens), int(lens.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
    return out


def _search(k: int, levels: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            x, q = _matrix(left.column("v")), _matrix(right.column("v"))
            width = max(x.shape[1], q.shape[1])
            x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
            if width and int(abs(x).max()) * int(abs(q).max()) * width >= 1 << 62:
                raise OverflowError("inner products do not fit 64 bits")
            if not width:
                x, q = np.zeros((len(left), 1), np.int64), np.zeros((len(right), 1), np.int64)
            index = ImpactIndex(left.column("vec_id").to_numpy(), x, levels)
            for qid, vector, bar in zip(right.column("vec_id").to_pylist(), q, right.column("bar").to_pylist()):
                for score, vec in index.top(vector, qid, k, bar):
                    out["query_id"].append(qid)
                    out["vec_id"].append(vec)
                    out["score"].append(score)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 8192, query_rows: int = 4096, levels: int = LEVELS) -> DataFrame:
    """For each query row the ``k`` other rows of greatest integer inner product: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on the integer column ``vec_id``. Components become
    ``floor(scale * x)``. Every block of candidates meets every block of queries
    once, in a task of its own that holds at most one of each; the k best of each
    meeting are merged by rank. Where there are several blocks the first one goes
    ahead, and the k-th score that a query has there is its bar in all others. Ties
    go to the smaller id. A null id, a null vector, or one with a null or non-finite
    component takes no part; an empty vector scores zero and a shorter one counts as
    filled with zeros. Rows with equal ids are candidates each, and one query by the
    least of their vectors; none is a candidate for a query of its own id. Fewer than
    ``k`` candidates give what there is; an empty table gives no rows; other columns
    are not read.
    """
    v = quantised(vectors, id_col, vec_col, scale)
    rows, asked = v.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, q_blocks = max(1, math.ceil(rows / block_rows)), max(1, math.ceil(asked / query_rows))
    queries = v.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int"))
    held = v.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

    def met(first: int, last: int, asked: DataFrame) -> DataFrame:
        left = held.where(F.col("b").between(first, last)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        right = asked.select(*(F.col(c).alias(c) for c in asked.columns)).withColumn("b", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        return left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(_search(k, levels), "query_id long, vec_id long, score long")

    part = met(0, 0, queries.withColumn("bar", F.lit(NO_BAR)))
    if blocks > 1:
        part = materialise(part, "top-first", compact=True)
        bars = part.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        asked = queries.join(bars, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "qb", F.coalesce("least", F.lit(NO_BAR)).alias("bar"))
        part = part.unionByName(met(1, blocks - 1, asked))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
