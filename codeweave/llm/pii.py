"""Personal data by bootstrapped contextual extraction.

Base kinds (email, ip, card, phone) are found in each text and serve as seeds. The words before seeds induce lexical
patterns: the last word, and the last two. Patterns with enough different seeds are looked up in all texts, where each
occurrence is followed by an identifier-like token (an instance) or by something else (counted against the pattern).
Spark then scores the pattern-instance graph: a pattern's confidence is the share of believed instances among all that
follows it (different instances and other words, so that copies of a text count once), an instance's is 1 minus the
product of its patterns' doubts. Patterns that could not be confident even if all their instances were believed, which
is what common words come to, are dropped before their other words are gathered. After ``rounds`` rounds, instances that confident patterns extract become spans of
kind ``id``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .scratch import Scratch, quoted, small_batches
from .spans import ARROW_SPANS, SPAN_TYPE, as_structs, digest, text_key, with_added
from .textkeys import Slice, mix, slices, windows

KINDS = ("email", "ip", "card", "phone", "id")
BASE_KINDS = KINDS[:4]
#: Patterns looked up in one pass over the texts (8 bytes each, sent to every worker); more take further passes.
PATTERNS_PER_PASS = 1_000_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP_TAIL = re.compile(r"[0-9]\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_WORD = re.compile("[^\\x20\\x09-\\x0d]+")
_NOT_DIGIT = re.compile("[^0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._@/-]{4,}[A-Za-z0-9]")


def _small(digits: str) -> bool:
    """At most 255, whatever the number of digits."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and (not digits or int(digits) <= 255)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, place of the kind, end)`` by start, then kind. Each kind takes time in proportion to the text:
    an email is sought from its @, an address from its first dot, and both grow leftwards from there."""
    found = []
    done = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            before = text[done : m.start()]
            local = len(before) - len(before.rstrip(_LOCAL))
            if local:
                found.append((m.start() - local, 0, m.end()))
            done = m.end() if local else m.start()
    if not _DIGITS.search(text):
        return found
    done = 0
    for m in _IP_TAIL.finditer(text):
        before = text[done : m.start()]
        start = m.start() - (len(before) - len(before.rstrip("0123456789")))
        done = m.end()
        if all(map(_small, (text[start : m.start() + 1], *m.groups()))):
            found.append((start, 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def context(text: str, starts: list[int]) -> list[str]:
    """The last two words, or parts of words, before each of ``starts``, joined by a space."""
    words = [m.span() for m in _WORD.finditer(text)] if starts else []
    begins = [w[0] for w in words]
    out = []
    for at in starts:
        n = bisect_left(begins, at)
        out.append(" ".join(text[a : min(b, at)] for a, b in words[max(0, n - 2) : n]))
    return out


def _pattern_hashes(contexts: list[str]) -> list[list[int]]:
    """Of each context the hashes of its last word and its last two, as ``textkeys`` gives them for the same words."""
    out: list[list[int]] = [[] for _ in contexts]
    for s in slices(pa.array(contexts, pa.string())):
        for k in (1, 2):
            h, rows, _ = windows(s, k, short=False)
            last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else rows
            for row, value in zip(rows[last].tolist(), h[last].view(np.int64).tolist(), strict=True):
                out[s.lo + row].append(value)
    return out


def _scan_base(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        spans = [base_spans(t) for t in texts]
        before = [c for t, found in zip(texts, spans, strict=True) for c in context(t, [a for a, _, _ in found])]
        patterns = iter(_pattern_hashes(before))
        contexts = [[{"pattern": p, "instance": text_key(t[a:b].lower())} for a, _, b in found for p in next(patterns)] for t, found in zip(texts, spans, strict=True)]
        counts = [pa.array([sum(s[1] == k for s in found) for found in spans], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(text_key, texts), pa.string()), *counts, pa.array([digest(x, KINDS) for x in spans], pa.string()), pa.array(map(as_structs, spans), ARROW_SPANS), pa.array(contexts, pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.string())])))],
            names=["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "contexts"],
        )


def _base_schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, text_key string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base {SPAN_TYPE}, contexts array<struct<pattern:bigint,instance:string>>"


def _occurrences(s: Slice, patterns: np.ndarray):
    """What follows each of the sorted ``patterns`` in a slice, as arrays of ``(pattern, row, word)``; word is -1 at a text's end."""
    found = []
    for k in (1, 2):
        h, rows, at = windows(s, k, short=False)
        h = h.view(np.int64)
        hit = np.flatnonzero(patterns[np.minimum(np.searchsorted(patterns, h), len(patterns) - 1)] == h)
        word = at[hit] + k
        found.append((h[hit], rows[hit], np.where(word < s.first[rows[hit] + 1], word, -1)))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


_SEEN = "text_key string, pattern bigint, instance string, start bigint, stop bigint, other bigint"
#: Pairs of a pattern and another word that a task holds before it passes them on.
PAIRS_HELD = 500_000


def _different(pairs: list[np.ndarray]) -> np.ndarray:
    """The different columns of some arrays of two rows, in the order of the first."""
    both = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    with np.errstate(over="ignore"):
        key = mix(both[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + both[1].astype(np.uint64))
    both = both[:, np.unique(key, return_index=True)[1]]
    return both[:, np.argsort(both[0], kind="stable")]


def _look_up(shared, words: bool):
    """Rows of ``doc_id`` and _SEEN. With ``words``, the pairs of a pattern and another word after it, each once a task
    (or more often, if it holds too many). Else a row for each identifier after a pattern, and for each pattern how many
    different other words the task saw. Base spans, keys and offsets are found once for a text, whatever it holds."""

    def run(batches):
        patterns, held = shared.value, []
        for batch in batches:
            column, ids, rows = batch.column(1), batch.column(0), []
            for s in slices(column):
                pattern, row, word = _occurrences(s, patterns)
                hashes = np.append(s.hashes.view(np.int64), 0)  # the last one stands for a text's end
                digits = np.concatenate([[0], np.cumsum((s.data >= 48) & (s.data <= 57))])
                digit = np.append(digits[s.ends] > digits[s.starts], False)[word]
                held.append(np.stack([pattern[~digit], hashes[word[~digit]]]))
                chars = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
                known, base = -1, []
                for i in np.flatnonzero(digit)[np.argsort(row[digit], kind="stable")].tolist():
                    r, w = int(row[i]), int(word[i])
                    m = _TOKEN.search(bytes(s.data[s.starts[w] : s.ends[w]]).decode())
                    if m is None or not _DIGITS.search(m[0]):
                        held.append(np.array([[pattern[i]], [hashes[w]]]))
                        continue
                    if words:
                        continue
                    if r != known:
                        text = column[s.lo + r].as_py()
                        known, base, key = r, base_spans(text), text_key(text)
                    begin = int(chars[s.starts[w]] - chars[s.bounds[r]])
                    a, b = begin + m.start(), begin + m.end()
                    if not any(x < b and a < y for x, _, y in base):
                        rows.append((ids[s.lo + r].as_py(), key, int(pattern[i]), text_key(m[0].lower()), a, b, None))
            yield _seen(rows, ids.type)
            if sum(x.shape[1] for x in held) > PAIRS_HELD:
                held = [_different(held)]
                if held[0].shape[1] > PAIRS_HELD // 2:
                    yield from _others(held.pop(), words, ids.type)
        if held:
            yield from _others(_different(held), words, ids.type)

    return run


def _seen(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "text_key", "pattern", "instance", "start", "stop", "other"])


def _others(pairs: np.ndarray, words: bool, kind: pa.DataType):
    if not words:
        pairs = np.stack(np.unique(pairs[0], return_counts=True))
    for i in range(0, pairs.shape[1], 100_000):
        pattern, other = pairs[:, i : i + 100_000]
        none = [pa.nulls(len(pattern), t) for t in (kind, pa.string(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays([none[0], none[1], pa.array(pattern), none[3], none[2], none[2], pa.array(other)], names=["doc_id", "text_key", "pattern", "instance", "start", "stop", "other"])


def _passes(texts: DataFrame, patterns: DataFrame, n: int, words: bool, scratch: Scratch) -> DataFrame:
    """What ``_look_up`` finds of ``n`` patterns, one pass after the other, so that the driver holds those of one only."""
    spark, seen, passes = texts.sparkSession, None, math.ceil(n / PATTERNS_PER_PASS)
    kind = texts.schema["doc_id"].dataType.simpleString()
    for i in range(passes):
        chunk = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == i).toArrow().column(0).to_numpy()
        shared = spark.sparkContext.broadcast(np.sort(chunk))
        part = scratch.cut(texts.mapInArrow(_look_up(shared, words), f"doc_id {kind}, {_SEEN}"))
        shared.destroy()
        seen = part if seen is None else seen.unionByName(part)
    return seen


def find(docs: DataFrame, min_seeds: int = 5, min_confidence: float = 0.6, rounds: int = 3) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added
    and all_spans (an array).

    A null text counts as empty and has no spans. Rows of null or repeated doc_id are scanned like any other. Added
    spans never overlap base ones. Offsets count code points; ends are exclusive. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    scratch = Scratch(spark)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = scratch.cut(texts.mapInArrow(_scan_base, _base_schema(texts)))
    added = _contextual(texts, base, scratch, min_seeds, min_confidence, rounds)
    return with_added(base, added, KINDS).select("doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "all_spans")


def _contextual(texts: DataFrame, base: DataFrame, scratch: Scratch, min_seeds: int, min_confidence: float, rounds: int) -> DataFrame:
    spark = texts.sparkSession
    kind = texts.schema["doc_id"].dataType.simpleString()
    seeds = base.select(F.explode("contexts").alias("c")).select("c.pattern", "c.instance").distinct()
    nothing = spark.createDataFrame([], f"doc_id {kind}, text_key string, start bigint, place int, stop bigint")
    induced, n = scratch.counted(seeds.groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds).select("pattern"))
    if n == 0:
        return nothing
    seen = _passes(texts, induced, n, False, scratch)
    known = seeds.join(induced, "pattern").withColumn("seed", F.lit(1.0))
    fresh = seen.where("instance is not null").select("pattern", "instance", F.lit(0.0).alias("seed")).distinct()
    graph = scratch.cut(known.unionByName(fresh).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    least = seen.where("other is not null").groupBy("pattern").agg(F.max("other").alias("least"))
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n")).join(least, "pattern", "left")
    hopeful, n = scratch.counted(sizes.where(min_confidence * F.coalesce("least", F.lit(0)) <= (1 - min_confidence) * F.col("n") + 1e-9).select("pattern"))
    if n == 0:
        return nothing
    against = _passes(texts, hopeful, n, True, scratch).select("pattern", "other").distinct().groupBy("pattern").agg(F.count("*").alias("others"))
    against = scratch.cut(against)
    graph = scratch.cut(graph.join(hopeful, "pattern", "left_semi"))
    belief = graph.groupBy("instance").agg(F.max("seed").alias("belief"))
    patterns = None
    for _ in range(rounds):
        scored = graph.join(belief, "instance").groupBy("pattern").agg(F.sum("belief").alias("good"), F.count("*").alias("n"))
        scored = scored.join(against, "pattern", "left").withColumn("others", F.coalesce("others", F.lit(0)))
        confidence = F.when(F.col("good") >= min_seeds, F.col("good") / (F.col("n") + F.col("others"))).otherwise(0.0)
        patterns = scratch.cut(scored.select("pattern", confidence.alias("confidence")))
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
        belief = graph.join(patterns, "pattern").groupBy("instance").agg(F.greatest(F.max("seed"), 1 - F.exp(doubt)).alias("belief"))
        belief = scratch.cut(belief)
    sure = seen.where("instance is not null").join(patterns.where(F.col("confidence") >= min_confidence), "pattern")
    sure = sure.join(belief.where(F.col("belief") >= min_confidence), "instance", "left_semi")
    return sure.select("doc_id", "text_key", "start", F.lit(len(KINDS) - 1).cast("int").alias("place"), "stop").distinct()


def mask(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every span of ``found`` (the result of ``find`` on it) replaced by ``<KIND>`` and n_chars renewed.

    Base spans are found again while a text passes; only added ones are joined in, by id and text, so that rows of null
    or repeated id get their own. Overlapping spans are replaced together, by the kind that starts first. Null texts
    stay null; all columns of ``docs`` are kept, whatever their names, and all rows, repeated ones too.
    """
    small_batches(docs.sparkSession, 256)
    extra = found.where("n_added > 0").select("doc_id", "text_key", "all_spans").distinct()
    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    place = schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            columns = batch.column(0).flatten()
            texts, new = columns[place].to_pylist(), []
            for text, more in zip(texts, batch.column(1).to_pylist(), strict=True):
                spans = [(s["start"], s["place"], s["stop"]) for s in more] if more else base_spans(text or "")
                new.append(masked(text, spans) if spans else text)
            for i, field in enumerate(schema.fields):
                if i == place:
                    columns[i] = pa.array(new, columns[i].type)
                elif field.name == "n_chars":
                    columns[i] = pa.array([None if t is None else len(t) for t in new], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col("doc_id").alias("of"), F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("key"))
    if extra.isEmpty():
        return rows.select("row", F.lit(None).cast(SPAN_TYPE).alias("all_spans")).mapInArrow(run, schema)
    keyed = rows.join(extra, rows.of.eqNullSafe(extra.doc_id) & (rows.key == extra.text_key), "left")
    return keyed.select("row", "all_spans").mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for a, k, b in sorted(spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])
