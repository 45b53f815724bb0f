"""MinHash near-dedup with tensored banding.

Two collections of ``groups`` hash groups (``rows`` minhashes each) are computed per text. A table key pairs one
group of the first collection with one of the second, so ``groups ** 2`` tables of ``2 * rows`` minhashes each cost
``2 * groups * rows`` minhashes. At Jaccard s a pair shares a key with probability (1 - (1 - s^rows)^groups)^2:
0.9994 at 0.8 with the defaults. Candidates are confirmed on full shingle sets.

Texts of the same shingle set form one class, so that copies cost one pre-aggregated minimum. Classes sharing a key
are not paired with each other: each is checked against the key's centre (the class that shares most keys overall),
then the next one, unless links have joined them meanwhile. What ``star_rounds`` leave in different components though
it shares a key is joined exactly on its rarest shingles, so no link between different texts is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, keep_ids, small_batches
from .textkeys import distinct_windows, mix, slices

SIGNATURE = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, a array<bigint>, b array<bigint>"


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _signatures(shingle: int, groups: int, rows: int):
    rng = np.random.default_rng(20240917)
    n_hash = 2 * groups * rows
    xor = rng.integers(0, 1 << 63, n_hash, dtype=np.uint64)
    odd = rng.integers(0, 1 << 63, n_hash, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                h, bounds = distinct_windows(s, shingle)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                keys = np.zeros((len(n), 2 * groups), dtype=np.uint64)
                h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(some):
                    at = bounds[:-1][some]
                    h1[some], h2[some] = np.add.reduceat(h, at), np.bitwise_xor.reduceat(mix(h + np.uint64(77)), at)
                    for i in range(n_hash):
                        least = np.minimum.reduceat((h ^ xor[i]) * odd[i], at)
                        keys[some, i // rows] = mix(keys[some, i // rows] * np.uint64(31) + least)
                keys = keys.view(np.int64)
                width = np.where(n > 0, groups, 0)
                bound = np.concatenate([[0], np.cumsum(width)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), _lists(keys[some, :groups].ravel(), bound), _lists(keys[some, groups:].ravel(), bound)],
                    names=["doc_id", "n_shingles", "h1", "h2", "a", "b"],
                )

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                h, bounds = distinct_windows(s, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), _lists(h.view(np.int64), bounds)], names=["doc_id", "shingles"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity_pct: int = 80, groups: int = 8, rows: int = 2, star_rounds: int = 1) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Linked are texts with 100 * intersection >= similarity_pct * union of their distinct shingles; component_id is
    the smallest doc_id reachable by links. A text of 1 to shingle-1 words is one shingle; null, empty or blank texts
    have none and link with nothing. Rows of null doc_id link with nothing and are kept. Repeated rows give repeated
    result rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = scratch.cut(texts.mapInArrow(_signatures(shingle, groups, rows), SIGNATURE))
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "a", "b")).alias("m"))
    classes = scratch.cut(classes.select("h1", "h2", "n_shingles", F.col("m.doc_id").alias("rep"), "m.a", "m.b"))

    groups_of = scratch.cut(_shared_groups(classes))
    check = _Check(texts, shingle, similarity_pct, scratch)
    # the key of a class's two most common groups, then all keys of one class per component, join most copies; of all
    # keys of all classes only those that still span components are taken up
    check.stars(_keys(groups_of, top_only=True), rounds=1)
    check.stars(_keys(check.labelled(groups_of).where("component = rep").drop("component")), rounds=1)
    spread = check.labelled(groups_of)
    open_keys = _keys(spread).groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    check.stars(_keys(spread).drop("component").join(scratch.cut(open_keys).hint("merge"), "key", "left_semi"), rounds=star_rounds, rest=True)

    found = check.components()
    labelled = classes.join(found.hint("merge"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    labelled = labelled.withColumnRenamed("n_shingles", "n").hint("merge")
    out = sig.join(labelled, (sig.h1 == labelled.h1) & (sig.h2 == labelled.h2) & (sig.n_shingles == labelled.n) & sig.doc_id.isNotNull() & (sig.n_shingles > 0), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


class _Check:
    """Confirms candidates on full shingle sets and remembers what was compared.

    Joins are merge joins: what they join grows with the input, and none of it is to be gathered in the driver."""

    def __init__(self, texts: DataFrame, shingle: int, similarity_pct: int, scratch: Scratch):
        self.texts, self.shingle, self.pct, self.scratch = texts, shingle, similarity_pct, scratch
        self.tried: DataFrame | None = None
        self.found: DataFrame | None = None

    def compare(self, pairs: DataFrame) -> None:
        """Confirms ``pairs(rep, n, centre, n_centre)`` that weren't compared before and joins the linked ones' components."""
        possible = f"100 * least(n, n_centre) >= {self.pct} * greatest(n, n_centre)"
        pairs = pairs.where(possible).select("rep", "centre").distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried.select("rep", "centre").hint("merge"), ["rep", "centre"], "left_anti")
        pairs = self.scratch.cut(pairs)
        wanted, n_wanted = self.scratch.counted(pairs.select(F.explode(F.array("rep", "centre")).alias("doc_id")).distinct())
        if n_wanted == 0:
            return
        sets = keep_ids(self.texts, wanted, n_wanted).mapInArrow(_sets(self.shingle), "doc_id bigint, shingles array<bigint>")
        checked = pairs.join(sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("s1")).hint("merge"), "rep")
        checked = checked.join(sets.select(F.col("doc_id").alias("centre"), F.col("shingles").alias("s2")).hint("merge"), "centre")
        common = F.size(F.array_intersect("s1", "s2"))
        linked = 100 * common >= self.pct * (F.size("s1") + F.size("s2") - common)
        checked = self.scratch.cut(checked.select("rep", "centre", linked.alias("linked")).groupBy("rep", "centre").agg(F.max("linked").alias("linked")))
        self.scratch.drop(pairs, wanted)
        edges = checked.where("linked").select(F.col("rep").alias("u"), F.col("centre").alias("v"))
        if self.found is not None:
            edges = edges.unionByName(self.found.select(F.col("rep").alias("u"), F.col("component").alias("v")))
        self.found = self.scratch.cut(components(edges, self.scratch).select(F.col("node").alias("rep"), "component"))
        self.tried = checked if self.tried is None else self.tried.unionByName(checked)
        self.scratch.collect_garbage()

    def labelled(self, classes: DataFrame) -> DataFrame:
        """``classes(rep, ...)`` with their ``component``; a class without links is one of its own."""
        if self.found is None:
            return classes.withColumn("component", F.col("rep"))
        return classes.join(self.found.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def stars(self, members: DataFrame, rounds: int, rest: bool = False) -> None:
        """Compares the members ``(key, rep, n, shared)`` of each key with its centre, then, without it, with the next
        centre, ``rounds`` times.

        Members that links join with the centre already need no comparison, and keys within one component are done.
        With ``rest``, the members of keys that are still open are then joined exactly (see ``rest``).
        """
        for turn in range(rounds + rest):
            members = self.labelled(members)
            order = F.struct((-F.col("shared")).alias("p"), F.xxhash64("rep").alias("h"), F.col("rep").alias("centre"), F.col("n").alias("n_centre"), F.col("component").alias("c"))
            heads = members.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min(order).alias("m"))
            heads, n_heads = self.scratch.counted(heads.where("least <> most").select("key", "m.centre", "m.n_centre", "m.c"))
            if n_heads == 0:
                return
            members = self.scratch.cut(members.join(heads.hint("merge"), "key"))
            if turn == rounds:
                self.rest(members.select("rep", "component").distinct())
                return
            members = members.where("rep <> centre")
            self.compare(members.where("component <> c"))
            members = members.select("key", "rep", "n", "shared")

    def rest(self, left: DataFrame) -> None:
        """Compares all pairs of ``left(rep, component)`` that can be similar enough but are not of one component.

        Two such sets share one of their rarest shingles: of n shingles those but for the n - ceil(n * similarity) + 1
        rarest can be missed in any pair of that similarity. What is left of both sets from their first common shingle on
        must still be enough for the overlap. Passages that many texts share are rarely among the rarest of a text, so
        they make few pairs.
        """
        left, n_left = self.scratch.counted(left)
        sets = keep_ids(self.texts, left.select(F.col("rep").alias("doc_id")), n_left).mapInArrow(_sets(self.shingle), "doc_id bigint, shingles array<bigint>")
        each = self.scratch.cut(sets.select(F.col("doc_id").alias("rep"), F.size("shingles").alias("n"), F.explode("shingles").alias("s")).distinct())
        often = each.groupBy("s").agg(F.count("*").alias("f"))
        rarest = Window.partitionBy("rep").orderBy("f", "s")
        kept = each.join(often.hint("merge"), "s").withColumn("i", F.row_number().over(rarest)).where(f"i <= n - ceil(n * {self.pct} / 100) + 1 and f > 1")
        kept = self.scratch.cut(kept.join(left.hint("merge"), "rep").select("s", "rep", "n", "i", "component"))
        open_ = kept.groupBy("s").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("s")
        open_kept = self.scratch.cut(kept.join(open_.hint("merge"), "s", "left_semi"))
        other = open_kept.select("s", F.col("rep").alias("centre"), F.col("n").alias("n_centre"), F.col("i").alias("i2"), F.col("component").alias("c"))
        near = f"100 * least(n, n_centre) >= {self.pct} * greatest(n, n_centre) and {100 + self.pct} * (1 + least(n - i, n_centre - i2)) >= {self.pct} * (n + n_centre)"
        self.compare(open_kept.join(other.hint("merge"), "s").where("rep < centre and component <> c").where(near).select("rep", "n", "centre", "n_centre"))
        self.scratch.drop(each, kept, open_kept)

    def components(self) -> DataFrame:
        """``(rep, component)`` of the linked classes."""
        return self.found if self.found is not None else self.texts.sparkSession.createDataFrame([], "rep bigint, component bigint")


def _shared_groups(classes: DataFrame) -> DataFrame:
    """``(rep, n, shared, a, b)``: the hash groups that another class has too, of classes with some in both collections."""
    one = lambda col, side: classes.select("rep", F.col("n_shingles").alias("n"), F.posexplode(col).alias("i", "value")).withColumn("side", F.lit(side))
    groups = one("a", 0).unionByName(one("b", 1))
    common = groups.groupBy("side", "i", "value").agg(F.count("*").alias("c")).where("c > 1")
    group = F.struct((-F.col("c")).alias("few"), "i", "value")
    by_class = groups.join(common.hint("merge"), ["side", "i", "value"]).groupBy("rep", "n").agg(
        F.sum(F.col("c") - 1).alias("shared"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, group))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, group))).alias("b"),
    )
    return by_class.where("size(a) > 0 and size(b) > 0")


def _keys(groups_of: DataFrame, top_only: bool = False) -> DataFrame:
    """``(key, rep, ...)``: a row for each pair of a class's groups, or for its most common ones only."""
    others = [c for c in groups_of.columns if c not in ("a", "b")]
    if top_only:
        pairs = groups_of.select(*others, F.get("a", F.lit(0)).alias("x"), F.get("b", F.lit(0)).alias("y"))
    else:
        pairs = groups_of.select(*others, F.explode("a").alias("x"), "b").select(*others, "x", F.explode("b").alias("y"))
    return pairs.select(*others, F.xxhash64("x.i", "x.value", "y.i", "y.value").alias("key"))
