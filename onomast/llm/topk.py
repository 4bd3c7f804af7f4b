"""Exact top-k inner product search over a bit-sliced index.

Vectors become integers floor(scale * x). The index holds them in blocks of rows; for
each component the high bits (above ``DROP``) are quantised attribute slices: bitmap b
has row i's bit if bit b of its quantised component is set. A query's components are
quantised too, and the products are added with bitmap arithmetic alone: each set bit of
a query's component selects the attribute's slices at their weight, and carry-save
adders fold all selected bitmaps of a weight into one sum bitmap and carries for the
next weight. This gives each row's approximate score as slices, for many queries at
once. From the most significant slice downward the rows certainly in the top k and the
rows still tied are kept until the k-th approximate score is known.

Quantisation errors have exact bounds, kept for each block: the rows whose approximate
score lies within twice the bound of the k-th are the boundary. They, and only they,
are scored exactly and ranked by score, ties to the smaller id. Nothing else can be in
the top k, so the result is exact.

Every row is indexed. Queries are scanned in groups of bounded size (``group``), each
broadcast as such, against all blocks. Vectors that are null or hold null or non-finite
components take no part, nor do rows with a null id. An inner product needs two vectors
of one length, so each length is searched by itself; empty vectors score 0 with one another.
Rows that share a query's id are its own and are not candidates; an id with several vectors
asks with the least of them. Components and scores beyond 64 bits are held at the nearest
number of 64 bits, before ranking. Only id and vector are read, so other columns may be
called anything. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SCALE, GROUP, BLOCK, DROP = 10, 1024, 16_384, 16_384, 4


def integers(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of each component, as double."""
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(finite)
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def _save(columns: list[list[np.ndarray]]) -> None:
    """Carry-save: while a weight has three bitmaps, make them a sum and a carry."""
    level = 0
    while level < len(columns):
        have = columns[level]
        while len(have) > 2:
            a, b, c = have.pop(), have.pop(), have.pop()
            t = a ^ b
            have.append(t ^ c)
            if level + 1 == len(columns):
                columns.append([])
            columns[level + 1].append((a & b) | (t & c))
        level += 1


def _add(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Fold bitmaps by weight: full adders take three of a weight to a sum and a carry."""
    out = []
    level = 0
    while level < len(columns):
        have = columns[level]
        if level + 1 == len(columns) and len(have) > 1:
            columns.append([])
        while len(have) > 1:
            if len(have) > 2:
                a, b, c = have.pop(), have.pop(), have.pop()
                t = a ^ b
                have.insert(0, t ^ c)
                columns[level + 1].append((a & b) | (t & c))
            else:
                a, b = have.pop(), have.pop()
                have.append(a ^ b)
                columns[level + 1].append(a & b)
        out.append(have[0] if have else None)
        level += 1
    return out


class Block:
    """The slices of a block of rows, and what bounds the quantisation's error."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, drop: int = DROP):
        self.ids, self.v, self.drop = ids, v, drop
        self.valid = np.empty(-(-len(ids) // 64), np.uint64)
        self.large = bool(v.size) and float(np.abs(v.astype(np.float64)).max()) >= 2.0**61
        if self.large or not v.shape[1]:
            return  # scored without slices
        self.low = int(v.min()) if v.size else 0
        high = (v - self.low) >> drop  # quantised, from 0
        self.bits = max(1, int(high.max()).bit_length()) if v.size else 1
        rest = (v - self.low) - (high << drop)
        self.rest_norm = float(np.sqrt((rest.astype(np.float64) - (1 << drop) / 2) ** 2 @ np.ones(v.shape[1])).max()) if v.size else 0.0
        self.norm = float(np.sqrt((v.astype(np.float64) ** 2).sum(1)).max()) if v.size else 0.0
        words = -(-len(ids) // 64)
        padded = np.zeros((words * 64, v.shape[1]), np.int64)
        padded[: len(ids)] = high
        self.slices = [[np.packbits(((padded[:, d] >> b) & 1).astype(bool), bitorder="little").view(np.uint64) for b in range(self.bits)] for d in range(v.shape[1])]
        self.valid = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)

    def approximate(self, q: np.ndarray, q_drop: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Score slices for queries ``q`` (n x dims), and each query's error bound.

        With q = 2^s p + r and v = low + 2^t u + e, q.v is 2^(s+t) p.u but for what is the
        same for every row, r.v and 2^s p.(e - middle); Cauchy and Schwarz bound the last
        two. Negative components select the complement of u, the largest u minus u, so
        that all that is added is positive and differs from p.u by a constant.
        """
        p = np.rint(q / (1 << q_drop)).astype(np.int64)
        width = int(np.abs(p).max(initial=0)).bit_length()
        columns: list[list[np.ndarray]] = [[] for _ in range(self.bits + max(width, 1))]
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        for d in range(q.shape[1]):
            flip = np.where(p[:, d] < 0, ones, np.uint64(0))[:, None]
            size = np.abs(p[:, d])
            for j in range(width):
                take = np.where((size >> j) & 1, ones, np.uint64(0))[:, None]
                if not take.any():
                    continue
                for b in range(self.bits):
                    columns[j + b].append((self.slices[d][b][None, :] ^ flip) & take)
            _save(columns)  # two bitmaps of each weight at most are kept from one component to the next
        sums = _add(columns)
        sums = [np.zeros((len(q), len(self.valid)), np.uint64) if s is None else s & self.valid for s in sums]
        r = q - (p << q_drop)
        bound = np.sqrt((r.astype(np.float64) ** 2).sum(1)) * self.norm + np.sqrt(((p << q_drop).astype(np.float64) ** 2).sum(1)) * self.rest_norm
        return sums, bound

    def _all(self, q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every row, by integers of any size, held within 64 bits: for numbers too large for slices."""
        whole = q.astype(object) @ self.v.astype(object).T if q.shape[1] else np.zeros((len(q), len(self.ids)), object)
        which, row = np.nonzero(q_ids[:, None] != self.ids[None, :])
        return which, row, np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in whole[which, row]], np.int64)

    def top(self, q_ids: np.ndarray, q: np.ndarray, k: int = K, q_drop: int = DROP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, row, exact score) of every row that can be among a query's k best here."""
        if not self.v.shape[1] or self.large or _huge(q, self.v):
            return self._all(q_ids, q)
        sums, bound = self.approximate(q, q_drop)
        n = len(q)
        own = np.zeros((n, len(self.valid)), np.uint64)
        order = np.argsort(self.ids, kind="stable")
        lo, hi = np.searchsorted(self.ids[order], q_ids, "left"), np.searchsorted(self.ids[order], q_ids, "right")
        for i in np.flatnonzero(hi > lo):
            for row in order[lo[i] : hi[i]]:
                own[i, row >> 6] |= np.uint64(1) << np.uint64(row & 63)
        alive = self.valid[None, :] & ~own
        # from the most significant slice downward: the k-th largest approximate score
        sure, tied, kth = np.zeros(n, np.int64), alive.copy(), np.zeros(n, np.int64)
        for level in range(len(sums) - 1, -1, -1):
            with_bit = tied & sums[level]
            count = np.bitwise_count(with_bit).sum(1, dtype=np.int64)
            enough = sure + count >= k
            tied = np.where(enough[:, None], with_bit, tied & ~sums[level])
            kth += np.where(enough, 1 << level, 0)
            sure += np.where(enough, 0, count)
        few = np.bitwise_count(alive).sum(1) <= k
        slack = np.ceil(2 * bound / float(1 << (self.drop + q_drop))).astype(np.int64) + 1
        least = np.where(few, 0, np.maximum(kth - slack, 0))
        # rows whose slices are at least ``least``: compare slice by slice
        above, equal = np.zeros_like(alive), alive.copy()
        for level in range(len(sums) - 1, -1, -1):
            need = ((least >> level) & 1).astype(bool)[:, None]
            above = np.where(need, above, above | (equal & sums[level]))
            equal = np.where(need, equal & sums[level], equal & ~sums[level])
        boundary = above | equal
        which, row = np.nonzero(np.unpackbits(boundary.view(np.uint8), axis=1, bitorder="little"))
        score = np.empty(len(row), np.int64)
        for i in range(0, len(row), 1 << 16):
            score[i : i + (1 << 16)] = np.einsum("ij,ij->i", q[which[i : i + (1 << 16)]], self.v[row[i : i + (1 << 16)]])
        return which, row, score


def _stack(vectors: pd.Series, length: int) -> np.ndarray:
    return np.array(vectors.to_list(), np.int64).reshape(-1, length) if length else np.empty((len(vectors), 0), np.int64)


def _huge(q: np.ndarray, v: np.ndarray) -> bool:
    """Whether products may leave 62 bits."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    return most(q) * most(v) * max(1, q.shape[1]) >= 2.0**62 or max(most(q), most(v)) >= 2.0**61


def _best(which: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, which))
    start = np.flatnonzero(np.diff(which[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def search(index: DataFrame, queries: DataFrame, *, k: int = K, group: int = GROUP) -> DataFrame:
    """``query_id, rank, vec_id, score`` from tables of ``vec_id`` and integer vectors ``v``."""
    spark = index.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.count()
    groups = max(1, -(-asked // group))
    found = None
    for g in range(groups):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toPandas().sort_values("vec_id")  # about ``group`` rows
        if not len(part):
            continue
        asked_by = {d: (rows["vec_id"].to_numpy(np.int64), _stack(rows["v"], d)) for d, rows in part.groupby(part["v"].map(len))}
        shared = spark.sparkContext.broadcast(asked_by)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            best = {d: np.empty((0, 3), np.int64) for d in shared.value}
            held: dict[int, list[pd.DataFrame]] = {d: [] for d in best}

            def fold(d: int) -> None:
                q_ids, q = shared.value[d]
                rows = pd.concat(held[d])
                held[d] = []
                block = Block(rows["vec_id"].to_numpy(np.int64), _stack(rows["v"], d))
                step = max(1, (1 << 17) // (8 * max(1, len(block.valid))))
                for lo in range(0, len(q), step):
                    which, row, score = block.top(q_ids[lo : lo + step], q[lo : lo + step], k)
                    mine = _best(which, block.ids[row], score, k)
                    best[d] = np.concatenate([best[d], np.stack([which[mine] + lo, block.ids[row[mine]], score[mine]], 1)])
                best[d] = best[d][_best(*best[d].T, k)]

            for frame in frames:
                for d, rows in frame.groupby(frame["v"].map(len)):
                    for lo in range(0, len(rows) if d in best else 0, BLOCK):
                        held[d].append(rows.iloc[lo : lo + BLOCK])
                        if sum(map(len, held[d])) >= BLOCK:
                            fold(d)
            for d in best:
                if held[d]:
                    fold(d)
                kept = best[d]
                yield pd.DataFrame({"query_id": shared.value[d][0][kept[:, 0]], "vec_id": kept[:, 1], "score": kept[:, 2]})

        best = index.mapInPandas(run, "query_id long, vec_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
