"""Spelling variants: words one edit apart, found by Gram matrices of letter counts, and each word's usual form.

One edit changes a word's length by at most one and its letter counts by one (insertion, deletion) or by two ones
(replacement), a squared distance of at most two. Words are blocked by length and by how many of their letters fall
into each of LETTER_CLASSES; an edit leads from a block to itself, to one where one class lost a letter to another,
or to one with a letter more. Such pairs of blocks, in chunks of bounded size, are the tasks: the product of two
chunks' count matrices gives all squared distances at once, pairs at most two apart are compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, release, ship

#: Letters are split into these and all others; each class holds about a quarter of the letters of European languages.
LETTER_CLASSES = ("ea", "iont", "rshld")
#: Words and letters of a chunk, at most; candidates compared together, in letters.
CHUNK_WORDS, CHUNK_LETTERS, COMPARED_LETTERS = 1024, 1 << 20, 1 << 22
#: Distinct words that a task counts before it passes their counts on, and code points of a text looked at together.
COUNTED_WORDS, PIECE = 200_000, 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_KEY = ("length", *[f"c{i}" for i in range(len(LETTER_CLASSES))])
NEAR = "word string, n_near bigint, best_n bigint, best string"


def _pieces(text: str):
    """A long text in parts that end behind a run."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        while hi < len(text) and _RUN.match(text, hi):
            hi = _RUN.match(text, hi).end()
        yield text[lo:hi]
        lo = hi


def _counted(typo_modulus: int, least: int):
    def flush(found: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not (text := text.as_py()):
                    continue
                lowered = text.encode().lower().decode()  # of bytes, only A-Z are lower-cased
                if len(lowered) <= PIECE:
                    runs = Counter(_RUN.findall(lowered))
                else:
                    runs = Counter()
                    for piece in _pieces(lowered):
                        runs.update(_RUN.findall(piece))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % typo_modulus == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    found[word] += n
                if len(found) >= COUNTED_WORDS:
                    yield flush(found)
                    found = Counter()
        if found:
            yield flush(found)
        release()

    return run


def word_counts(docs: DataFrame, min_letters: int = 6, min_count: int = 5, typo_modulus: int = 199) -> DataFrame:
    """``(word, n)``: runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z in lower case, that have
    ``min_letters`` code points and occur ``min_count`` times.

    A run whose crc32 together with its doc_id (``doc_id:run``, a null id as nothing) is a multiple of
    ``typo_modulus`` first loses one letter: a corpus of invented prose has no typing errors of its own.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_counted(typo_modulus, min_letters), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _chunks(words: DataFrame) -> DataFrame:
    """Words by block (length and class counts), in chunks of at most about CHUNK_WORDS; large blocks have several."""
    of_class = [F.length(F.regexp_replace("word", f"[^{letters}]", "")).alias(f"c{i}") for i, letters in enumerate(LETTER_CLASSES)]
    keyed = words.select("word", "n", F.length("word").alias("length"), *of_class)
    most = F.greatest(F.lit(1), F.least(F.lit(CHUNK_WORDS), F.lit(CHUNK_LETTERS) / F.col("length")))
    sizes = keyed.groupBy(*_KEY).agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / most))
    part = F.pmod(F.xxhash64("word"), "parts").alias("chunk")
    split = keyed.join(sizes, list(_KEY)).select(*_KEY, part, F.struct("word", "n").alias("w"))
    return split.groupBy(*_KEY, "chunk").agg(F.collect_list("w").alias("w")).select(*_KEY, "chunk", F.col("w.word").alias("words"), F.col("w.n").alias("counts"))


def _steps() -> list[tuple[int, ...]]:
    """From a block to those that an edit can lead to, each pair of blocks in one direction: nothing, a letter more,
    or a letter from one class to a later one. The last class follows from the length."""
    classes = len(LETTER_CLASSES) + 1
    unit = lambda *signs: tuple(sum(s for c, s in signs if c == k) for k in range(classes - 1))
    longer = [(1, *unit((i, 1))) for i in range(classes)]
    moved = [(0, *unit((i, 1), (j, -1))) for i in range(classes) for j in range(i + 1, classes)]
    return [(0,) * classes, *longer, *moved]


def _meeting(chunks: DataFrame) -> DataFrame:
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"s{k}") for k, x in enumerate(s)], F.lit(not any(s)).alias("same")) for s in _steps()])
    out = chunks.withColumn("step", F.explode(steps))
    there = out.select(*[(F.col(k) + F.col(f"step.s{i}")).alias(k) for i, k in enumerate(_KEY)], F.col("step.same").alias("same"), F.col("chunk").alias("from_chunk"), F.col("words").alias("words_a"), F.col("counts").alias("counts_a"))
    met = there.join(chunks, list(_KEY)).where("not same or from_chunk <= chunk")
    return met.select("words_a", "counts_a", F.col("words").alias("words_b"), F.col("counts").alias("counts_b"), (F.col("same") & (F.col("from_chunk") == F.col("chunk"))).alias("itself"))


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length as letters, and their counts of each letter: a-z, then from U+00C0 on."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    column = np.where(letters >= 192, letters.astype(np.int64) - 192 + 26, letters.astype(np.int64) - 97)
    cells = (np.arange(len(words))[:, None] * 90 + column).ravel()
    return letters, np.bincount(cells, minlength=90 * len(words)).reshape(-1, 90).astype(np.float32)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b``, of the same length as those of ``a`` or one letter longer, are one edit from them."""
    width = a.shape[1]
    if b.shape[1] == width:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :width], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= width


def near_pairs(a: list[str], b: list[str], itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of words one edit apart; ``b`` holds words of the same length as ``a`` or of one more."""
    (letters_a, counts_a), (letters_b, counts_b) = _matrix(a), _matrix(b)
    squared = (counts_a**2).sum(axis=1)[:, None] + (counts_b**2).sum(axis=1)[None, :] - 2 * (counts_a @ counts_b.T)
    close = squared <= 2.5
    i, j = np.nonzero(np.triu(close, 1) if itself else close)
    step = max(1, COMPARED_LETTERS // letters_b.shape[1])
    found = [_one_edit(letters_a[i[k : k + step]], letters_b[j[k : k + step]]) for k in range(0, len(i), step)]
    good = np.concatenate(found) if found else np.zeros(0, bool)
    return i[good], j[good]


def _best(words: list[str], of: np.ndarray, others: list[str], counts: np.ndarray, other: np.ndarray):
    """Of each word with neighbours: the word, their number, and the most frequent (ties: the smallest)."""
    rank = np.empty(len(others), np.int64)
    rank[sorted(range(len(others)), key=others.__getitem__)] = np.arange(len(others))
    order = np.lexsort((rank[other], -counts[other], of))
    first = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(of) else np.zeros(0, np.int64)
    n = np.diff([*first, len(of)])
    return [words[k] for k in of[order][first]], n, counts[other[order][first]], [others[k] for k in other[order][first]]


def _near(batches):
    for batch in batches:
        words, n, best_n, best = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for a, n_a, b, n_b, itself in zip(*[batch.column(k).to_pylist() for k in range(5)]):
            i, j = near_pairs(a, b, itself)
            n_a, n_b = np.array(n_a, np.int64), np.array(n_b, np.int64)
            for own, of, others, counts, other in ((a, i, b, n_b, j), (b, j, a, n_a, i)):
                w, k, m, o = _best(own, of, others, counts, other)
                words += w
                best += o
                n.append(k)
                best_n.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.concatenate(n)), pa.array(np.concatenate(best_n)), pa.array(best, pa.string())], names=["word", "n_near", "best_n", "best"])


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words(word, n)``, distinct words of letters.

    n_near is the number of words one inserted, deleted or replaced code point away. A word's form is the most
    frequent of them (ties: the smallest in code-point order) if it occurs at least ``ratio`` times as often; root
    follows forms to the last, and is the word itself where it has none. An empty table gives an empty table.
    """
    scratch = Scratch(words.sparkSession)
    ship(scratch.spark)
    words = scratch.cut(words.select("word", F.col("n").cast("long").alias("n")))
    met = _meeting(scratch.cut(_chunks(words))).repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    near = met.mapInArrow(_near, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("m")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("m.k")).alias("best_n"), "m.best")
    usual = F.col("best_n") >= ratio * F.col("n")
    out = scratch.cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n")))
    # a form is at least ``ratio`` times as frequent, so that chains are short; each round doubles the steps taken
    roots, n = scratch.counted(out.where("form is not null").select("word", F.col("form").alias("root")))
    while n:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after, n = scratch.counted(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).where("moved"))
        roots, kept = scratch.cut(after.select("word", "root").unionByName(roots.join(after.select("word"), "word", "left_anti"))), roots
        scratch.drop(kept)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, min_letters: int = 6, min_count: int = 5, ratio: int = 5, typo_modulus: int = 199) -> DataFrame:
    """``variants`` of the words of whole texts in ``docs(doc_id, text)``, counted by ``word_counts``. Null texts have no
    words, repeated rows count as often as they stand there, other columns are ignored."""
    return variants(word_counts(docs, min_letters, min_count, typo_modulus), ratio)
