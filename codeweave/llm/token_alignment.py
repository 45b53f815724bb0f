"""Alignment of two tokenizers' tokens: byte ranges cut where tokens of both end, and the id pairs that share a range.

A is a byte-level BPE of the ``tokenizers`` library, B a ``sentencepiece`` model. Coarse cuts are A's character offsets
and B's piece spans; tokens that share a multi-byte character, byte-fallback pieces and trimmed white space have no
span of their own and are placed by the bytes that they decode to. (The installed sentencepiece no longer gives its
immutable proto; ``offset_mapping`` returns the same spans.)

Neither tokenizer joins what is before a space with the space, if no white space comes before it: A's words begin
there, and no piece of B has a space after another character. Texts are therefore cut at such places into units, and
of each unit only the first occurrence within a stretch of texts is encoded and aligned.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, release, ship

#: Bits of an id in a pair's code.
ID_BITS = 18
#: Characters of new units that are encoded together, and of texts that are looked at together.
ENCODED_CHARS, SLICE_CHARS = 1 << 16, 1 << 22
#: Units that a worker remembers (about 300 bytes each); beyond it, the half that was met most stays.
MAX_UNITS = 500_000
#: A group of more links than this is counted by its distinct ids instead of being paired out.
LARGE_GROUP = 4096
#: Pairs whose counts are broadcast (24 bytes each); the links of all others are joined by a shuffle.
MAX_BROADCAST_PAIRS = 400_000

_CUT = re.compile(r" (?<=\S )(?=.)", re.S)
_SPACE = "▁"
ROW = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def _utf8_lengths(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


def _ends(begin: np.ndarray, end: np.ndarray, byte_at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes. A span that the next one does not reach into is a cut; other tokens are placed
    by the decoded bytes since the cut before them."""
    placed = np.cumsum(width)
    cut = end > begin
    cut[:-1] &= begin[1:] >= end[:-1]
    last = np.maximum.accumulate(np.where(cut, np.arange(len(end)), -1))
    return np.where(last >= 0, byte_at[end[last]] + placed - placed[last], placed)


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within runs of the given lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _pairs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n_groups: int):
    """Codes, multiplicities and groups of all links; ``of_a`` and ``of_b`` are the tokens' groups."""
    n_a, n_b = np.bincount(of_a, minlength=n_groups), np.bincount(of_b, minlength=n_groups)
    first_b = np.cumsum(n_b) - n_b
    small = n_a * n_b <= LARGE_GROUP
    mine = np.flatnonzero(small[of_a])
    width = n_b[of_a[mine]]
    partner = np.repeat(first_b[of_a[mine]], width) + _runs(width)
    codes, groups = (np.repeat(a[mine], width) << ID_BITS) | b[partner], np.repeat(of_a[mine], width)
    times = np.ones(len(codes), np.int64)
    for g in np.flatnonzero(~small):
        x, n_x = np.unique(a[of_a == g], return_counts=True)
        y, n_y = np.unique(b[of_b == g], return_counts=True)
        codes = np.concatenate([codes, ((x[:, None] << ID_BITS) | y[None, :]).ravel()])
        times = np.concatenate([times, (n_x[:, None] * n_y[None, :]).ravel()])
        groups = np.concatenate([groups, np.full(len(x) * len(y), g)])
    order = np.argsort(groups, kind="stable")
    return codes[order], times[order], groups[order]


class Aligner:
    """Both tokenizers, and the alignment of the units met so far (at most about MAX_UNITS between two slices)."""

    def __init__(self, json_a: str, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        shape, byte_of = json.loads(json_a).get("pre_tokenizer") or {}, _byte_of_letter()
        plain = {t.content: t.content.encode() for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = plain.get(token) or bytes(byte_of[c] for c in token)
        self.bytes_b, joined = [], False
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode())
            joined |= _SPACE in piece.lstrip(_SPACE)
        self.cuttable = shape.get("type") == "ByteLevel" and shape.get("use_regex", True) and not joined
        if max(len(self.bytes_a), len(self.bytes_b)) >= 1 << ID_BITS:
            raise ValueError(f"a vocabulary has {1 << ID_BITS} or more ids")
        self.width_a, self.width_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        every = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.listed, self.turned, self.closed = (np.array([f"{i}{mark}" for i in every], object) for mark in ",|;")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.written: list[str] = []
        self.used = np.zeros(0, np.int64)
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; n_a -1: bytes differ
        self.codes, self.times, self.bounds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def units(self, text: str) -> list[str]:
        return [" " + part for part in _CUT.split(text)] if self.cuttable else [" " + text]

    def learn(self, units: list[str]) -> None:
        """Aligns units that aren't known yet; those that end in white space stand alone, the others are put together."""
        chunks, chunk, size = [], [], 0
        for unit in units:
            if unit[-1].isspace() or not self.cuttable:
                chunks.append([unit])
                continue
            chunk.append(unit)
            size += len(unit)
            if size >= ENCODED_CHARS:
                chunks.append(chunk)
                chunk, size = [], 0
        if chunk:
            chunks.append(chunk)
        found = [x for c in chunks for x in self._align(c)]
        order = [u for c in chunks for u in c]
        self.index.update(zip(order, range(len(self.written), len(self.written) + len(order))))
        self.written += [x[1] for x in found]
        self.counts = np.concatenate([self.counts, np.array([x[0] for x in found], np.int64).reshape(-1, 4)])
        sizes = np.array([len(x[2]) for x in found], np.int64)
        self.codes, self.times = (np.concatenate([have, *[x[i] for x in found]]) for i, have in ((2, self.codes), (3, self.times)))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def _align(self, units: list[str]) -> list[tuple]:
        text = "".join(units)
        raw = text.encode()
        of_a = self.a.encode(text, add_special_tokens=False)
        of_b = self.b.encode(text[1:], return_type="offset_mapping")
        a, b = np.array(of_a.ids, np.int64), np.array(of_b["ids"], np.int64)
        if b"".join(map(self.bytes_a.__getitem__, of_a.ids)) != raw or b"".join(map(self.bytes_b.__getitem__, of_b["ids"])) != raw:
            nothing = np.zeros(0, np.int64)
            return [((-1, 0, 0, 0), "", nothing, nothing)] if len(units) == 1 else [x for u in units for x in self._align([u])]
        byte_at = np.arange(len(text) + 1) if text.isascii() else np.concatenate([[0], np.cumsum(_utf8_lengths(text))])
        spans_a, spans_b = (np.fromiter(chain.from_iterable(x), np.int64, 2 * len(x)).reshape(-1, 2) for x in (of_a.offsets, of_b["offsets"]))
        spans_b += 1  # behind the space that B puts first
        ends_a = _ends(spans_a[:, 0], spans_a[:, 1], byte_at, self.width_a[a])
        ends_b = _ends(spans_b[:, 0], spans_b[:, 1], byte_at, self.width_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n = len(common)
        upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
        codes, times, group = _pairs(a, b, group_a, group_b, n)
        # the digest's text: each group's ids of A, then those of B
        out = np.empty(len(a) + len(b), object)
        last_a, last_b = ends_a == common[group_a], ends_b == common[group_b]
        before_b = np.concatenate([[0], upto_b[:-1]])
        out[np.arange(len(a)) + before_b[group_a]] = np.where(last_a, self.turned[a], self.listed[a])
        out[np.arange(len(b)) + upto_a[group_b]] = np.where(last_b, self.closed[b], self.listed[b])
        out = out.tolist()
        # units end where tokens of both end
        sizes = np.array([len(u) for u in units], np.int64)
        last = np.searchsorted(common, byte_at[np.cumsum(sizes)])
        stop_g, stop_a, stop_b, stop_l = last + 1, upto_a[last], upto_b[last], np.searchsorted(group, last, side="right")
        total = np.concatenate([[0], np.cumsum(times)])
        rows, g, ia, ib, il = [], 0, 0, 0, 0
        for jg, ja, jb, jl in zip(stop_g.tolist(), stop_a.tolist(), stop_b.tolist(), stop_l.tolist()):
            rows.append(((ja - ia, jb - ib, jg - g, int(total[jl] - total[il])), "".join(out[ia + ib : ja + jb])[:-1], codes[il:jl], times[il:jl]))
            g, ia, ib, il = jg, ja, jb, jl
        return rows

    def batch(self, texts: list[str]):
        """Of each text ``(n_a, n_b, n_groups, n_links)``, the digest, and its distinct pairs with their numbers."""
        split = [self.units(t) if t else [] for t in texts]
        self.learn(list(dict.fromkeys(u for units in split for u in units if u not in self.index)))
        known = self.index.__getitem__
        at = [[known(u) for u in units] for units in split]
        del split
        sizes = np.array([len(x) for x in at], np.int64)
        flat = np.array([i for x in at for i in x], np.int64)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), bool)
        bad[text_of[self.counts[flat, 0] < 0]] = True
        good = ~bad[text_of]
        flat, text_of = flat[good], text_of[good]
        totals = np.stack([np.bincount(text_of, self.counts[flat, k], len(texts)) for k in range(4)], axis=1).astype(np.int64)
        digests = ["" if bad[i] or not x else hashlib.sha256(";".join([self.written[k] for k in x]).encode()).hexdigest() for i, x in enumerate(at)]
        width = self.bounds[flat + 1] - self.bounds[flat]
        where = np.repeat(self.bounds[flat], width) + _runs(width)
        owner, codes, times = np.repeat(text_of, width), self.codes[where], self.times[where]
        order = np.argsort((owner << (2 * ID_BITS)) | codes, kind="stable")
        owner, codes, times = owner[order], codes[order], times[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        times = np.add.reduceat(times, first) if len(first) else times
        bounds = np.searchsorted(owner[first], np.arange(len(texts) + 1))
        met = np.bincount(flat, minlength=len(self.written))
        met[: len(self.used)] += self.used
        self.used = met
        if len(self.index) > MAX_UNITS:
            self._keep()
        return totals, digests, codes[first], times, bounds

    def _keep(self) -> None:
        """Forgets the half of the units that was met least since the last time."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: MAX_UNITS // 2])
        names, written = list(self.index), self.written
        self.index, self.written = {names[i]: k for k, i in enumerate(kept.tolist())}, [written[i] for i in kept.tolist()]
        width = self.bounds[kept + 1] - self.bounds[kept]
        where = np.repeat(self.bounds[kept], width) + _runs(width)
        self.counts, self.codes, self.times, self.used = self.counts[kept], self.codes[where], self.times[where], self.used[kept]
        self.bounds = np.concatenate([[0], np.cumsum(width)])


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


_made: dict[str, Aligner] = {}


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)`` for every row of ``docs(doc_id, text)``:
    the distinct linked id pairs of a text, as ``a << ID_BITS | b``, and how often each is linked."""
    spark = docs.sparkSession
    ship(spark)
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        given = spark.sparkContext.broadcast((a.read(), b.read()))  # two vocabulary files, whatever the input
    key = f"{path_a}\n{path_b}"

    def rows(aligner, ids, texts):
        totals, digests, codes, times, bounds = aligner.batch(texts)
        lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (codes, times)]
        return pa.RecordBatch.from_arrays([ids, *[pa.array(totals[:, k]) for k in range(4)], pa.array(digests, pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    def run(batches):
        if key not in _made:
            _made[key] = Aligner(*given.value)
        aligner = _made[key]
        for batch in batches:
            texts, lo = batch.column(1).to_pylist(), 0
            sizes = np.cumsum([len(t or "") for t in texts])
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE_CHARS, side="right")))
                yield rows(aligner, batch.column(0).slice(lo, hi - lo), texts[lo:hi])
                lo = hi
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROW)


def pair_counts(links: DataFrame) -> DataFrame:
    """``(pair, n_docs, best)`` of the links that ``aligned`` gives: how many rows hold each pair, and whether no pair
    of the same A id is held by more."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    of_a = F.shiftright("pair", ID_BITS)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", of_a).join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, max_broadcast_pairs: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of
    ``docs(doc_id, text)``.

    A encodes a space and the text, B the text. Texts that are null or empty, or whose tokens' bytes differ from
    those of the space and the text, have no tokens: zeros and an empty digest. A pair's count is the number of rows
    that hold it; n_best counts links whose pair has the highest count of its A id, count_sum adds the counts of all
    links. Every row is a document of its own, whether its id is null or repeated; other columns are ignored; an empty
    table gives an empty table.

    Counts of the pairs held most are broadcast (``max_broadcast_pairs`` at most); links of other pairs are joined
    with theirs by a shuffle.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    links = scratch.cut(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts, n = scratch.counted(pair_counts(links))
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    value = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")]
    if n <= max_broadcast_pairs:
        sums = each.join(F.broadcast(counts), "pair").groupBy("row").agg(*value)
    else:
        common = scratch.cut(counts.orderBy(F.desc("n_docs"), "pair").limit(max_broadcast_pairs))
        known = each.join(F.broadcast(common), "pair", "left")
        near = known.where("n_docs is not null").groupBy("row").agg(*value)
        rare = known.where("n_docs is null").select("pair", "row", "times").join(counts.hint("merge"), "pair").groupBy("row").agg(*value)
        sums = near.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = links.drop("pairs", "times").join(sums.hint("merge"), "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
