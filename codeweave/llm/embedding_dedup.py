"""Embedding near-dedup by collision-counting projections.

Every table projects the unit vectors on a random line of its own. Alone, a line lets each vector meet a fixed share of
all others, however many there are, so a table also splits its line: by which of ``lines`` further directions (and on
which side) a vector lies farthest, ``depth`` times. Within a split, vectors are sorted along the table's line, and a
window of ``WINDOW`` to either side of each vector holds those it collides with. Collisions are counted per pair over
the tables, and pairs that reach the calibrated count are verified in double precision. Splits grow in number with the
vectors and make collisions rarer, so ``plan`` takes as many tables as let a pair at the threshold reach two collisions
with probability ``recall``, and asks for the greatest count that keeps this.

Near copies are not paired out. Vectors within half the threshold's angle of a common centre are linked with each
other for certain; they form a ball, which takes part in the windows as the interval of its members' places and meets
other balls as one. Where the centres of two balls decide, all or none of their members are linked; else the members
are compared in blocks of bounded size, from which only counts leave.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, small_batches

#: Half the width of a window, on lines along which unit vectors spread with deviation 1.
WINDOW = 0.9
#: Directions of one split at most, each with two sides.
LINES = 64
#: Members of a ball, and of its partners, that are compared at once.
BLOCK = 1024
#: Rounds in which balls gather members.
GATHERINGS = 2
#: Slack, in radians, for the rounding of angles where a bound decides.
SLACK = 1e-6
#: Projections that a Python worker holds at once.
CELLS = 1 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of vectors that can link: not null, no null or non-finite component, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    kept = vectors.where("vec_id is not null and embedding is not null").where(fine & some)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def chance(threshold: float, depth: int, lines: int, trials: int = 20000) -> float:
    """That a pair of cosine ``threshold`` collides in a table. A pair's two values on a line are normal with that
    correlation whatever the vectors are, so the share of splits that agree is simulated, without any data."""
    apart = math.sqrt(2 * (1 - threshold))
    if apart == 0:
        return 1.0
    rng = np.random.default_rng(3)
    a = rng.standard_normal((trials, lines))
    b = threshold * a + math.sqrt(1 - threshold**2) * rng.standard_normal((trials, lines))
    agree = float((_side(a) == _side(b)).mean())
    return agree**depth * math.erf(WINDOW / apart / math.sqrt(2))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int, int, int]:
    """``(depth, lines, tables, count)`` for ``n`` vectors: about as many splits in a table as there are vectors."""
    depth = max(1, math.ceil(math.log(max(n, 2)) / math.log(2 * LINES)))
    lines = max(2, math.ceil(max(n, 2) ** (1 / depth) / 2))
    p = chance(threshold, depth, lines)
    tables = 2
    while p < 1 and 1 - (1 - p) ** tables - tables * p * (1 - p) ** (tables - 1) < recall:
        tables += 1
    return depth, lines, tables, least_count(p, tables, recall)


def least_count(p: float, tables: int, recall: float) -> int:
    """The greatest count of collisions, each of chance ``p``, that is reached with probability ``recall``."""
    if p >= 1:
        return tables
    term = below = (1 - p) ** tables
    if 1 - below < recall:
        raise ValueError(f"{tables} tables reach recall {1 - below:.3f}, not {recall}")
    count = 1
    while count < tables:
        term *= (tables - count + 1) / count * p / (1 - p)
        if 1 - below - term < recall:
            break
        below, count = below + term, count + 1
    return count


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _side(y: np.ndarray) -> np.ndarray:
    """The direction of greatest absolute value along the last axis, and its sign, as one number."""
    at = np.abs(y).argmax(-1)
    return 2 * at + (np.take_along_axis(y, at[..., None], -1)[..., 0] > 0)


def _vectors(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all vectors of a column, where each begins, and how many each has."""
    size = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])[:-1], size


def _keys(depth: int, lines: int, tables: int, seed: int):
    """``(bucket, value, rep)``: each vector's split and place in each table; vectors of other lengths never meet."""
    made: dict[int, np.ndarray] = {}
    wide = depth * lines + 1

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat, begin, size = _vectors(batch.column(1))
            for d in np.unique(size).tolist():
                if d not in made:
                    made[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * wide))
                rows = np.flatnonzero(size == d)
                step = max(1, CELLS // (tables * wide))
                for i in range(0, len(rows), step):
                    at = rows[i : i + step]
                    y = (unit(flat[begin[at][:, None] + np.arange(d)]) @ made[d]).reshape(len(at), tables, wide)
                    side = _side(y[:, :, 1:].reshape(len(at), tables, depth, lines)).astype(np.uint64)
                    bucket = np.full((len(at), tables), d, dtype=np.uint64) * np.uint64(tables) + np.arange(tables, dtype=np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(depth):
                            bucket = (bucket ^ (bucket >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + side[:, :, j]
                        bucket = (bucket ^ (bucket >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64).ravel()), pa.array(y[:, :, 0].astype(np.float32).ravel()), pa.array(np.repeat(ids[at], tables))], names=["bucket", "value", "rep"])

    return run


def _collisions(batches):
    """Pairs ``(a, b)`` of the intervals ``(bucket, lo, hi, ball)``, sorted by bucket and lo, that come within a window.

    What may still meet later rows is carried to the next batch: no more than one window holds."""
    kept = None
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(4)]
        old = 0 if kept is None else len(kept[0])
        bucket, lo, hi, ball = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        reach, n, shift = hi + np.float32(WINDOW), len(bucket), 1
        open_rows = np.arange(n)
        while len(open_rows := open_rows[open_rows + shift < n]):
            later = open_rows + shift
            meets = (bucket[open_rows] == bucket[later]) & (lo[later] <= reach[open_rows])
            open_rows, later = open_rows[meets], later[meets]
            new = later >= old
            a, b = ball[open_rows[new]], ball[later[new]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            shift += 1
        if n:
            still = np.flatnonzero((bucket == bucket[-1]) & (reach >= lo[-1]))
            kept = [x[still] for x in (bucket, lo, hi, ball)]


def _angles(batches):
    """Cosine of two vectors a row (null where the lengths differ), after the row's other columns."""
    for batch in batches:
        (flat_x, from_x, n_x), (flat_y, from_y, n_y) = _vectors(batch.column(batch.num_columns - 2)), _vectors(batch.column(batch.num_columns - 1))
        cosine = np.full(batch.num_rows, np.nan)
        for d in np.unique(n_x).tolist():
            at = np.flatnonzero((n_x == d) & (n_y == d))
            if len(at):
                cosine[at] = (unit(flat_x[from_x[at][:, None] + np.arange(d)]) * unit(flat_y[from_y[at][:, None] + np.arange(d)])).sum(1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(cosine)], names=[*batch.schema.names[:-2], "cosine"])


def _with_cosine(pairs: DataFrame, classes: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with the cosine of the vectors that its columns ``left`` and ``right`` name."""
    names = pairs.columns
    out = pairs.join(classes.select(F.col("rep").alias(left), F.col("v").alias("x_")).hint("merge"), left)
    out = out.join(classes.select(F.col("rep").alias(right), F.col("v").alias("y_")).hint("merge"), right).select(*names, "x_", "y_")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return out.mapInArrow(_angles, f"{schema}, cosine double").where("not isnan(cosine)")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, seed: int = 5) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``.

    n_links counts the other vectors of cosine ``threshold`` or more, of which a pair exactly at the threshold is found
    with probability ``recall``; component_id is the smallest vec_id reachable. A cosine equal to the threshold links.
    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different lengths, link
    with nothing. A null vec_id has a null component and is kept. Repeated rows of one vec_id and vector count as other
    vectors to each other; of different vectors under one vec_id the greatest takes part and the others link with
    nothing. Equal vectors form one class and are expanded only in the counts. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark, 512)
    scratch = Scratch(spark)
    same = usable(vectors).groupBy("vec_id", "v").agg(F.count("*").alias("c"))
    rows = scratch.cut(same.groupBy("vec_id").agg(F.max(F.struct("v", "c")).alias("m")).select("vec_id", "m.v", "m.c"))
    classes = scratch.cut(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sum("c").alias("copies")).select("rep", "copies", "v"))
    depth, lines, tables, count = plan(classes.count(), threshold, recall)
    keys = scratch.cut(classes.select("rep", "v").mapInArrow(_keys(depth, lines, tables, seed), "bucket bigint, value float, rep bigint"))
    members = _balls(classes, keys, math.acos(threshold) / 2 - SLACK, count, scratch)

    intervals = keys.join(members.select("rep", "ball").hint("merge"), "rep").groupBy("bucket", "ball").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    along = intervals.repartition("bucket").sortWithinPartitions("bucket", "lo").select("bucket", "lo", "hi", "ball")
    met = along.mapInArrow(_collisions, "a bigint, b bigint").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("c")).where(F.col("c") >= count).select("a", "b")
    balls = scratch.cut(members.groupBy("ball").agg(F.sum("copies").alias("size"), F.count("*").alias("n"), F.max("angle").alias("radius"), F.min("centre").alias("centre")))
    for side in ("a", "b"):
        met = met.join(balls.select(F.col("ball").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "n", "radius", "centre")]).hint("merge"), side)
    judged = _with_cosine(scratch.cut(met), classes, "centre_a", "centre_b")
    angle, reach = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine")))), F.col("radius_a") + F.col("radius_b")
    single = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    every = F.when(single, F.col("cosine") >= threshold).otherwise(angle + reach <= math.acos(threshold) - SLACK)
    none = F.when(single, F.col("cosine") < threshold).otherwise(angle - reach > math.acos(threshold) + SLACK)
    judged = scratch.cut(judged.select("a", "b", "size_a", "size_b", "n_a", "n_b", every.alias("every"), none.alias("none")).where("not none"))

    whole = judged.where("every")
    per_ball = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("links")).unionByName(whole.select(F.col("b").alias("ball"), F.col("size_a").alias("links")))
    per_ball = per_ball.groupBy("ball").agg(F.sum("links").alias("ball_links"))
    compared = scratch.cut(_compared(judged.where("not every"), members, classes, threshold))
    per_member = compared.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("own_links"))
    edges = whole.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(compared.where("rep is null").select("u", "v"))
    found = components(edges, scratch).select(F.col("node").alias("ball"), "component")

    of_ball = balls.join(per_ball.hint("merge"), "ball", "left").join(found.hint("merge"), "ball", "left")
    of_ball = of_ball.select("ball", (F.col("size") - 1 + F.coalesce("ball_links", F.lit(0))).alias("ball_links"), F.coalesce("component", "ball").alias("component_id"))
    per_class = members.join(of_ball.hint("merge"), "ball").join(per_member.hint("merge"), "rep", "left").join(classes.select("rep", "v").hint("merge"), "rep")
    per_class = per_class.select("v", (F.col("ball_links") + F.coalesce("own_links", F.lit(0))).alias("n_links"), "component_id")
    of_row = rows.join(per_class.hint("merge"), "v").select("vec_id", "v", "n_links", "component_id")
    asked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    of_row = of_row.withColumnRenamed("vec_id", "id_").hint("merge")
    out = asked.join(of_row, (asked.vec_id == of_row.id_) & (asked.e == of_row.v), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _balls(classes: DataFrame, keys: DataFrame, radius: float, count: int, scratch: Scratch) -> DataFrame:
    """``(rep, copies, centre, angle, ball)``: each vector with the centre it gathers to, itself if none is near.

    In every split the vectors collide with one of them only (of the largest ball so far, then of least hash), so a
    split of any size makes as many pairs as it has rows. Vectors that have a centre of their own, or serve as one for others,
    stay. ball is the smallest rep of a centre's members.
    """
    members = classes.select("rep", "copies", F.col("rep").alias("centre"), F.lit(0.0).alias("angle"))
    for turn in range(GATHERINGS):
        if turn == 0:
            free = keys.select("bucket", "value", "rep", F.lit(1).alias("n"))
        else:
            sizes = members.groupBy(F.col("centre").alias("rep")).agg(F.count("*").cast("int").alias("n"))
            free = keys.join(sizes.hint("merge"), "rep").select("bucket", "value", "rep", "n")
        first = F.min(F.struct((-F.col("n")).alias("few"), F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("centre"), F.col("value").alias("at")))
        heads = free.groupBy("bucket").agg(first.alias("m"), F.count("*").alias("many")).where("many > 1").select("bucket", "m.centre", "m.at")
        near = free.where("n = 1").join(heads.hint("merge"), "bucket").where((F.col("rep") != F.col("centre")) & (F.abs(F.col("value") - F.col("at")) <= WINDOW))
        near = near.groupBy("rep", "centre").agg(F.count("*").alias("c")).where(F.col("c") >= count).select("rep", "centre")
        near = scratch.cut(_with_cosine(near, classes, "rep", "centre").where(F.col("cosine") >= math.cos(radius)))
        settled = near.join(near.select(F.col("rep").alias("centre")).distinct().hint("merge"), "centre", "left_anti")
        angle = F.acos(F.least(F.lit(1.0), F.col("cosine")))
        chosen = settled.groupBy("rep").agg(F.min(F.struct(F.xxhash64("centre", F.lit(turn)).alias("h"), F.col("centre").alias("to"), angle.alias("turned"))).alias("m"))
        joined = members.join(chosen.select("rep", "m.to", "m.turned").hint("merge"), "rep", "left")
        members = scratch.cut(joined.select("rep", "copies", F.coalesce("to", "centre").alias("centre"), F.coalesce("turned", "angle").alias("angle")))
    named = members.groupBy("centre").agg(F.min("rep").alias("ball"))
    return scratch.cut(members.join(named.hint("merge"), "centre").select("rep", "copies", "centre", "angle", "ball"))


def _compared(pairs: DataFrame, members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``(rep, links, u, v)``: for balls that bounds don't decide, what each member links with (copies counted), and a
    row of null rep for each two balls with a link.

    The ball of more members stands on the left. Its members and those of all its partners meet in blocks."""
    left_first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    pairs = pairs.select(F.when(left_first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(left_first, F.col("b")).otherwise(F.col("a")).alias("v"), F.greatest("n_a", "n_b").alias("n_u"), F.least("n_a", "n_b").alias("n_v"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    grids = pairs.groupBy("u").agg(blocks(F.max("n_u")).alias("rows"), blocks(F.sum("n_v")).alias("columns"))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = members.select("rep", "copies", "ball")
    left = of.withColumnRenamed("ball", "u").join(grids.hint("merge"), "u").select("u", F.lit(None).cast("bigint").alias("v"), "rep", "copies", part("rows").alias("i"), every("columns").alias("j"))
    right = of.withColumnRenamed("ball", "v").join(pairs.select("u", "v").hint("merge"), "v").join(grids.hint("merge"), "u").select("u", "v", "rep", "copies", every("rows").alias("i"), part("columns").alias("j"))
    cells = left.unionByName(right).join(classes.select("rep", F.col("v").alias("x")).hint("merge"), "rep")

    def run(part):
        import pandas as pd

        out = []
        for _, same in part.groupby(part.x.map(len)):
            a, b = same[same.v.isna()], same[same.v.notna()]
            if not len(a) or not len(b):
                continue
            linked = unit(np.stack(a.x.to_numpy())) @ unit(np.stack(b.x.to_numpy())).T >= threshold
            out.append(pd.DataFrame({"rep": a.rep.to_numpy(), "links": linked @ b.copies.to_numpy(), "u": None, "v": None}))
            out.append(pd.DataFrame({"rep": b.rep.to_numpy(), "links": a.copies.to_numpy() @ linked, "u": None, "v": None}))
            hit = np.unique(b.v.to_numpy()[linked.any(0)]).astype(np.int64)
            out.append(pd.DataFrame({"rep": None, "links": None, "u": int(part.u.iloc[0]), "v": hit}))
        names = ["rep", "links", "u", "v"]
        return pd.concat([x.astype("Int64") for x in out]) if out else pd.DataFrame({c: pd.array([], "Int64") for c in names})

    return cells.groupBy("u", "i", "j").applyInPandas(run, schema="rep bigint, links bigint, u bigint, v bigint").where("rep is null or links > 0")
