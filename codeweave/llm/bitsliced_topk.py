"""Exact top-k inner products with a bit-sliced index.

Vector components are quantised to integers and stored, for a block of rows, as bit slices: one bitmap over the rows
for each component and bit. A query's score of all rows of a block is a sum of slices shifted by the query's bits; it
is made with carry-save bitmap additions and comes out as bit slices itself. The top rows are taken from the most
significant slice downward: rows with the bit set go before those without it, until the wanted number is certain; the
rows at the boundary, which agree in every slice, are told apart exactly by id.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small_batches

#: Rows in a block of the index, and queries that one task sends through a block's index.
BLOCK_ROWS, BLOCK_QUERIES = 16384, 65536


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v array<double>)``: vectors that are null or hold null or non-finite components are left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where("vec_id is not null and embedding is not null").where(fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def quantise(v: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each row, and which rows are small enough for inner products of 64 bits. The others are
    integers of Python, so nothing is rounded or wraps around."""
    most = math.isqrt((1 << 62) // max(1, v.shape[1]))
    small = (np.abs(v) < most / scale - 1).all(1) if v.shape[1] else np.ones(len(v), dtype=bool)
    if small.all():
        return np.floor(v * scale).astype(np.int64), small
    exact = np.empty(v.shape, dtype=object)
    for i, j in np.ndindex(v.shape):
        exact[i, j] = math.floor(Fraction(float(v[i, j])) * scale)
    return exact, small


class BitSlices:
    """The index of a block: component values less their least value, as bitmaps packed in 64-bit words."""

    def __init__(self, values: np.ndarray):
        self.rows = len(values)
        self.low = values.min(0)
        raised = (values - self.low).astype(np.uint64)
        self.bits = [int(x).bit_length() for x in raised.max(0)]
        self.words = -(-self.rows // 64)
        self.valid = self._pack(np.ones(self.rows, dtype=bool))
        self.slices = [[self._pack((raised[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(n)] for d, n in enumerate(self.bits)]

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, dtype=np.uint8)
        packed = np.packbits(flags.astype(bool), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Bit slices, least significant first, of the rows' scores up to a constant of the query.

        A negative weight takes the complement of a component's slices, so that only additions are needed.
        """
        addends: list[list[np.ndarray]] = []
        for weight, slices in zip(query.tolist(), self.slices, strict=True):
            if weight == 0:
                continue
            terms = slices if weight > 0 else [~s & self.valid for s in slices]
            for shift in range(abs(weight).bit_length()):
                if abs(weight) >> shift & 1:
                    while len(addends) < shift + len(terms):
                        addends.append([])
                    for b, term in enumerate(terms):
                        addends[shift + b].append(term)
        out, place = [], 0
        while place < len(addends):
            stack = addends[place]
            if not stack:
                out.append(np.zeros(self.words, dtype=np.uint64))
            else:
                level = np.stack(stack)
                carries = []
                while len(level) > 1:
                    n = len(level) // 3
                    a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
                    rest = level[3 * n :]
                    if n == 0:
                        a, b = level[:1], level[1:2]
                        carries.append(a & b)
                        level = a ^ b
                        continue
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    level = np.concatenate([half ^ c, rest])
                out.append(level[0])
                if carries:
                    if place + 1 == len(addends):
                        addends.append([])
                    addends[place + 1].extend(row for c in carries for row in c)
            place += 1
        return out

    def top(self, slices: list[np.ndarray], k: int, without: int | None) -> np.ndarray:
        """Rows of the ``k`` greatest scores and all rows equal to the last of them; ``without`` is left out."""
        open_rows, sure = self.valid.copy(), np.zeros(self.words, dtype=np.uint64)
        if without is not None:
            open_rows[without >> 6] &= ~np.uint64(1 << (without & 63))
        got = 0
        for s in reversed(slices):
            high = open_rows & s
            n = int(np.bitwise_count(high).sum())
            if got + n >= k:
                open_rows = high
            else:
                got += n
                sure |= high
                open_rows = open_rows & ~s
        flags = np.unpackbits((sure | open_rows).view(np.uint8), bitorder="little")[: self.rows]
        return np.flatnonzero(flags)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best rows of ``vectors(vec_id, embedding)`` but itself.

    Score is the integer inner product of the quantised vectors; ties go to the smaller vec_id; fewer rows give fewer
    results. Vectors that are null or hold null or non-finite components take no part, nor do those of another length
    than the query. Vectors too large for inner products of 64 bits are ranked by exact integers all the same (up to 10**38, beyond
    which scores count as equal); a score beyond a long is shown as the nearest long. Repeated rows of one vec_id count once (the greatest vector of them).
    Other columns are ignored, whatever their names; an empty table gives an empty result.

    A task indexes one block of rows once and sends up to BLOCK_QUERIES queries through it, one after the other.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1024)
    rows = usable(vectors).groupBy("vec_id").agg(F.max("v").alias("v"))
    asked = usable(queries).groupBy("vec_id").agg(F.max("v").alias("v"))
    n_rows, n_asked = vectors.count(), queries.count()
    row_blocks, query_blocks = max(1, math.ceil(n_rows / BLOCK_ROWS)), max(1, math.ceil(n_asked / BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    length = F.size("v").alias("d")
    left = rows.select(part(row_blocks).alias("rb"), every(query_blocks).alias("qb"), length, F.lit(False).alias("asks"), "vec_id", "v")
    right = asked.select(every(row_blocks).alias("rb"), part(query_blocks).alias("qb"), length, F.lit(True).alias("asks"), "vec_id", "v")
    cells = left.unionByName(right).repartition(row_blocks * query_blocks, "rb", "qb").sortWithinPartitions("rb", "qb", "d", "asks", "vec_id")

    found = cells.mapInArrow(lambda batches: _search(batches, k, scale), "query_id bigint, vec_id bigint, score bigint, exact string")
    exact = F.col("exact").cast("decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), exact.desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Block:
    """The rows of a block of one length: small ones in the bit-sliced index, large ones beside it."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, scale: int):
        values, small = quantise(v, scale)
        self.ids, self.values = ids[small], values[small].astype(np.int64)
        self.large_ids, self.large = ids[~small], values[~small]
        self.index = BitSlices(self.values) if len(self.ids) else None

    def best(self, query_id: int, q: np.ndarray, small: bool, k: int) -> list[tuple[int, int]]:
        """The ``(score, vec_id)`` of the best rows, as exact integers."""
        out = []
        if small and self.index is not None:
            own = int(np.searchsorted(self.ids, query_id))
            own = own if own < len(self.ids) and self.ids[own] == query_id else None
            best = self.index.top(self.index.scores(q), k, own)
            score = self.values[best] @ q
            order = np.lexsort((self.ids[best], -score))[:k]
            out += zip(score[order].tolist(), self.ids[best][order].tolist(), strict=True)
        exact = q.astype(object)
        beside = [(self.large_ids, self.large)] if small else [(self.large_ids, self.large), (self.ids, self.values.astype(object))]
        for ids, values in beside:
            out += [(int(s), i) for s, i in zip(values @ exact, ids.tolist(), strict=True) if i != query_id] if len(ids) else []
        return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


def _search(batches, k: int, scale: int):
    """Streams blocks, rows before queries (see ``top_k``'s sort): only one block and one batch are held."""
    at, block, waiting = None, None, []
    for batch in batches:
        rb, qb, d, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        lists = batch.column(5)
        flat, begin = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        edges = np.flatnonzero((rb[1:] != rb[:-1]) | (qb[1:] != qb[:-1]) | (d[1:] != d[:-1]) | (asks[1:] != asks[:-1])) + 1
        out = []
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
            if lo == hi:
                continue
            key, v = (int(rb[lo]), int(qb[lo]), int(d[lo])), flat[begin[lo] : begin[hi]].reshape(hi - lo, int(d[lo]))
            if key != at:
                at, block, waiting = key, None, []
            if not asks[lo]:
                waiting.append((ids[lo:hi], v))
                continue
            if waiting:
                block, waiting = _Block(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]), scale), []
            if block is None:
                continue
            q, small = quantise(v, scale)
            for i in range(hi - lo):
                row = q[i].astype(np.int64) if small[i] else q[i]
                out += [(int(ids[lo + i]), vec_id, score) for score, vec_id in block.best(int(ids[lo + i]), row, bool(small[i]), k)]
        longs = [max(-(1 << 63), min((1 << 63) - 1, s)) for _, _, s in out]
        exact = [None if s == long else str(max(-(10**38) + 1, min(10**38 - 1, s))) for (_, _, s), long in zip(out, longs, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(longs, pa.int64()), pa.array(exact, pa.string())], names=["query_id", "vec_id", "score", "exact"])
