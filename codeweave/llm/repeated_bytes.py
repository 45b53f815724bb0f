"""Suffix-array dedup by prefix doubling: bytes inside a long string that also starts earlier are found and removed.

Ranking every byte's suffix would move many times the corpus. The ranked positions are therefore sampled by content:
of the WINDOWS strings of ``length`` bytes that start side by side, each is anchored at the place inside it whose gram
(``length - WINDOWS + 1`` bytes) has the least hash. Equal strings have their anchor at the same distance, and one
anchor stands for a block of up to WINDOWS starts, about 32 on average.

Spark sorts (position, rank) pairs in rounds, in which the compared length grows from the gram to ``length``:

1. anchors, by the rank of their gram;
2. parts of STEP starts, by the pair of that rank and the rank of the ``length - STEP + 1`` bytes their strings share;
3. single starts, by the pair of that rank and the rank of the whole string.

In each round a position whose string, as far as compared, occurs in one form only is dropped, and a block whose whole
range (all its strings) also occurs earlier is settled at once; the others go on to the next round. Sorting is by
range over the whole key, ending in the position, so that a string of any number of copies is spread over tasks; runs
that cross from one range to the next are joined by the ranges' first and last rows.

Ranks of equal bytes come from 64-bit fingerprints; that two strings are equal always rests on two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, ship
from .textkeys import mix

WINDOWS, STEP = 64, 8
#: Bytes of texts worked on together (a longer text is still taken whole), and rows of a sorted range.
SLICE_BYTES, RANGE_ROWS = 1 << 18, 1_000_000
_PLACE = np.uint64((1 << 30) - 1)
_P, _P_INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20250301).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: ``a, b``: the ranks a row is sorted by; ``shape``: the distances of its starts from the anchor; ``full``: its whole range.
KEY = ("a", "b", "shape", "full", "doc", "tie", "at")
ROW = "a bigint, b bigint, shape int, full bigint, doc bigint, tie bigint, at int"
RANKED = ROW + ", rank bigint, again boolean, mixed boolean, starts boolean, starts_full boolean, ends boolean, range int"


def _powers(n: int, have: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  those of usual sizes are kept
    if n > len(have.get("p", ())):
        run = np.full((2, max(n, 2 * SLICE_BYTES)), [[_P], [_P_INV]], np.uint64)
        run[:, 0] = 1
        power, inverse = np.cumprod(run, axis=1, dtype=np.uint64)
        if n > 2 * SLICE_BYTES:
            return power, inverse
        have["p"], have["q"] = power, inverse
    return have["p"], have["q"]


class _Prints:
    """Fingerprints of any range of some bytes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.inverse[start])

    def each(self, length: int) -> np.ndarray:
        return mix((self.total[length:] - self.total[:-length]) * self.inverse[: len(self.total) - length])


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, data, bounds)``: rows lo to hi of a string column, their bytes, and where each begins in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1), len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _batch(a, b, shape, full, doc, tie, at) -> pa.RecordBatch:
    columns = [_signed(a), _signed(b), pa.array(shape.astype(np.int32)), _signed(full), doc, tie, pa.array(at.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=list(KEY))


def _anchors(length: int):
    gram = length - WINDOWS + 1

    def run(batches):
        for batch in batches:
            doc, tie = batch.column(0), batch.column(1)
            for lo, hi, data, bounds in _slices(batch.column(2)):
                if len(data) < length:
                    continue
                prints = _Prints(data)
                grams = prints.each(gram)
                least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
                size = 1
                while size < WINDOWS:
                    least = np.minimum(least[:-size], least[size:])
                    size *= 2
                n = np.maximum(np.diff(bounds) - length + 1, 0)  # starts in each text
                if not n.any():
                    continue
                starts = np.repeat(bounds[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                anchor = (least[starts] & _PLACE).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                last = np.concatenate([first[1:], [len(anchor)]]) - 1
                place, begin, end = anchor[first], starts[first], starts[last]
                row = np.searchsorted(bounds, place, side="right") - 1
                take = pa.array(row + lo)
                yield _batch(grams[place], np.zeros(len(place)), (place - begin) * WINDOWS + place - end, prints.of(begin, end + length), doc.take(take), tie.take(take), place - bounds[row])

    return run


def _parts(length: int, step: int):
    """Of each block the parts of ``step`` starts, as rows; a block's ``rank`` becomes ``a``."""
    shared = length - step + 1

    def run(batches):
        for batch in batches:
            doc, tie, blocks = batch.column(0), batch.column(1), batch.column(3)
            first = blocks.offsets.to_numpy().astype(np.int64)
            at, shape, rank = (blocks.values.field(k).to_numpy().astype(np.int64) for k in range(3))
            for lo, hi, data, bounds in _slices(batch.column(2)):
                mine = np.arange(first[lo], first[hi])
                if not len(mine):
                    continue
                prints = _Prints(data)
                row = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
                low, high = shape[mine] % WINDOWS // step, shape[mine] // WINDOWS // step
                n = high - low + 1
                block = np.repeat(np.arange(len(mine)), n)
                part = low[block] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                near = np.maximum(part * step, (shape[mine] % WINDOWS)[block])
                far = np.minimum(part * step + step - 1, (shape[mine] // WINDOWS)[block])
                row = row[block]
                place = at[mine][block] + bounds[row]
                core = prints.of(place - part * step, place - part * step + shared)
                take = pa.array(row + lo)
                yield _batch(rank[mine][block], mix(core + part.astype(np.uint64)), far * WINDOWS + near, prints.of(place - far, place - near + length), doc.take(take), tie.take(take), at[mine][block])

    return run


def _rerank(batches):
    """Ranks the rows of one sorted range; rows that occur in one form only are left out, unless their run may go on
    in the range before or after."""
    pieces = list(batches)
    if not sum(len(p) for p in pieces):
        return
    table = pa.Table.from_batches(pieces)
    a, b, shape, full = (table.column(k).to_numpy() for k in range(4))
    differs = lambda *xs: np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in xs])])
    new_run = differs(a, b)
    new_full = new_run | differs(shape, full)
    run = np.cumsum(new_run) - 1
    n_full = np.bincount(run, new_full)
    mixed, starts, ends = (n_full > 1)[run], run == 0, run == run[-1]
    here = TaskContext.get().partitionId()
    rank = (here << 40) + np.flatnonzero(new_run)[run]
    kept = np.flatnonzero(~new_full | mixed | starts | ends)
    extra = [rank, ~new_full, mixed, starts, np.cumsum(new_full) == 1, ends, np.full(len(run), here, np.int32)]
    out = table.take(pa.array(kept))
    for name, x in zip(("rank", "again", "mixed", "starts", "starts_full", "ends", "range"), extra):
        out = out.append_column(name, pa.array(x[kept]))
    yield from out.to_batches(max_chunksize=1 << 16)


def _joined(edges: list) -> list[tuple]:
    """Of each range ``(range, start_rank, start_mixed, start_again, end_rank, end_mixed)``, from the ranges' first and
    last runs in order; a run that goes on over ranges has its first rank everywhere."""
    runs, of = [], {}
    for e in edges:
        start, end = (e.start_low, e.start_high, e.start_rank), (e.end_low, e.end_high, e.end_rank)
        again = False
        if runs and runs[-1]["key"] == start[0][:2]:
            again = runs[-1]["high"] == start[0]
            runs[-1]["high"] = start[1]
        else:
            runs.append({"key": start[0][:2], "low": start[0], "high": start[1], "rank": start[2]})
        mine = len(runs) - 1
        if end[0][:2] != start[0][:2]:
            runs.append({"key": end[0][:2], "low": end[0], "high": end[1], "rank": end[2]})
        of[e.range] = (mine, again, len(runs) - 1)
    mixed = [r["low"] != r["high"] for r in runs]
    return [(k, runs[i]["rank"], mixed[i], again, runs[j]["rank"], mixed[j]) for k, (i, again, j) in of.items()]


def _ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``rank``, ``again`` (its whole range also occurs earlier) and ``mixed`` (what was compared occurs
    in several forms); rows that are neither are left out, but for some at the ends of ranges."""
    spark = scratch.spark
    rows, n = scratch.counted(rows)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS + 1)
    found = scratch.cut(rows.repartitionByRange(ranges, *KEY).sortWithinPartitions(*KEY).mapInArrow(_rerank, RANKED))
    scratch.drop(rows)
    form = F.struct("a", "b", "shape", "full")
    ends = [(F.col("starts"), "start"), (F.col("ends"), "end")]
    edge = [x for here, name in ends for x in (F.min(F.when(here, form)).alias(f"{name}_low"), F.max(F.when(here, form)).alias(f"{name}_high"), F.min(F.when(here, F.col("rank"))).alias(f"{name}_rank"))]
    # one row a range
    edges = _joined(found.where("starts or ends").groupBy("range").agg(*edge).orderBy("range").collect())
    known = spark.createDataFrame(edges, "range int, start_rank bigint, start_mixed boolean, start_again boolean, end_rank bigint, end_mixed boolean")
    out = found.join(F.broadcast(known), "range")
    either = lambda name: F.when(F.col("starts"), F.col(f"start_{name}")).when(F.col("ends"), F.col(f"end_{name}")).otherwise(F.col(name))
    return out.select("doc", "tie", "at", "shape", either("rank").alias("rank"), either("mixed").alias("mixed"), (F.col("again") | (F.col("starts_full") & F.col("start_again"))).alias("again"))


def _kept(length: int):
    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            first, lows, highs = spans.offsets.to_numpy(), spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
            n_bytes, n_removed, removed, kept = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                low, high = lows[first[i] : first[i + 1]], highs[first[i] : first[i + 1]]
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order]) if len(high) else high
                new = np.concatenate([[True], low[1:] > high[:-1]]) if len(low) else np.zeros(0, bool)
                begin, end = low[new], high[np.concatenate([np.flatnonzero(new)[1:], [len(low)]]) - 1] if len(low) else high
                n_bytes.append(len(data))
                n_removed.append(int((end - begin).sum()))
                removed.append([{"start": int(x), "stop": int(y)} for x, y in zip(begin, end)])
                kept.append(b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, removed array<struct<start,stop>>, kept binary)`` for every row of
    ``docs(doc_id, text)``.

    A byte of a text's UTF-8 is removed if a string of ``length`` bytes over it also starts earlier: in a row of
    smaller doc_id, or further ahead in the same text; overlaps count, and all strings are judged on the texts as
    given. ``removed`` are the maximal runs of removed bytes, ``kept`` the other bytes. A null text counts as empty.

    Of several texts under one doc_id those of smaller xxhash64 count as earlier, and null ids as the largest id.
    Rows equal in id and text give equal results and are not each other's repeats. Other columns are ignored; an
    empty table gives an empty table.
    """
    if length < WINDOWS + 8:
        raise ValueError(f"length must be at least {WINDOWS + 8}")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    repeated = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    rows = rows.withColumn("tie", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    texts = rows.select("doc", "tie", "text").where(F.octet_length("text") >= length)
    if repeated:
        texts = texts.dropDuplicates(["doc", "tie"])

    settled = []

    def settle(ranked: DataFrame) -> None:
        near, far = F.col("shape") % WINDOWS, F.floor(F.col("shape") / WINDOWS).cast("int")
        settled.append(ranked.where("again").select("doc", "tie", (F.col("at") - far).alias("low"), (F.col("at") - near + length).alias("high")))

    def with_texts(ranked: DataFrame) -> DataFrame:
        """The texts of rows that are still open, with these as an array."""
        blocks = ranked.where("mixed and not again").groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "shape", "rank")).alias("blocks"))
        return texts.join(blocks, ["doc", "tie"]).select("doc", "tie", "text", "blocks")

    ranked = _ranked(texts.mapInArrow(_anchors(length), ROW), scratch)
    settle(ranked)
    for step in (STEP, 1):
        ranked = _ranked(with_texts(ranked).mapInArrow(_parts(length, step), ROW), scratch)
        settle(ranked)
    spans = settled[0].unionByName(settled[1]).unionByName(settled[2]).groupBy("doc", "tie").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = rows.join(spans, ["doc", "tie"], "left").select("doc_id", "text", F.coalesce("spans", F.expr("cast(array() as array<struct<low:int,high:int>>)")).alias("spans"))
    return spans.mapInArrow(_kept(length), "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, kept binary")
