"""Secret scan by a randomness test battery.

Base kinds (assign, access, hex) come from fixed patterns. Beyond them, every token of 20 characters or more from the
alphabets of hex, base32, base62 and base64 is a candidate; the narrowest alphabet that holds it is its inferred
encoding. Three tests ask whether its symbols look drawn at random from that alphabet: a chi-squared test of
uniformity, a runs test about the alphabet's middle, and a test of lag-one serial correlation. Fisher's method
combines them into one level of randomness.

A reported token is claimed to be no ordinary text, so the share of ordinary text among the reported is what is
controlled. How random ordinary text of the same encoding and length looks is simulated: symbols are drawn with the
frequencies they have in the whole corpus outside the candidates, and run through the same battery. A token's p-value is the share of those
that look as random as it does (below the least simulated ones, the tail of a log-normal law fitted to them, so that a
few secrets among any number of ordinary tokens are still told apart), and within each stratum of encoding and length a Benjamini-Hochberg step-up over all
tokens of the corpus reports tokens as kind ``random`` at false-discovery rate ``q``. Short tokens, on which the tests
have little power, are thus held to what ordinary text of their own length reaches.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .spans import ARROW_SPANS, SPAN_TYPE, as_structs, digest, text_key, with_added

KINDS = ("assign", "access", "hex", "random")
#: Levels of randomness are counted in this many bins of -log10 p, each DECADE_BINS to a decade.
DECADE_BINS, BINS = 10, 400
#: Symbols of ordinary text simulated for a stratum, how many of the least tokens the fitted tail takes over from, and
#: what its spread is multiplied by (the classes' lengths differ) and is at least.
SIMULATED, TAIL, WIDER, LEAST_SPREAD = 1 << 20, 10, 1.1, 0.25
#: Longer tokens are held to ordinary text of this length, which looks more random than ordinary text of their own.
LONGEST = 2048

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_DIGITS = "0123456789"
#: Encodings from the narrowest alphabet to the widest, in the order of their symbols' values.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
_VALUES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, place of the kind, end)`` of the whole matches, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token; None if none does, or for less than 6 different symbols or no letter
    (of random tokens of 20 hex digits, 1 in 10 000 has no letter; in the other alphabets still fewer). Whether a token
    without digits is a word is left to the tests."""
    symbols = set(token)
    if len(symbols) < 6 or not symbols & (_SETS["base64"] - set(_DIGITS) - {"+", "/"}):
        return None
    return next((name for name, s in _SETS.items() if symbols <= s), None)


_erfc = np.vectorize(math.erfc, otypes=[float])


def battery(values: np.ndarray, size: int) -> np.ndarray:
    """Fisher's combination of the three tests' p-values for each row of symbol values below ``size``: small for tokens
    that don't look random."""
    m, n = values.shape
    counts = np.bincount((np.arange(m)[:, None] * size + values).ravel(), minlength=m * size).reshape(m, size)
    chi = ((counts - n / size) ** 2).sum(1) / (n / size)
    spread = 2 / (9 * (size - 1))  # Wilson and Hilferty's cube root of chi-squared
    uniform = 0.5 * _erfc((np.cbrt(chi / (size - 1)) - (1 - spread)) / math.sqrt(2 * spread))
    high = values >= size / 2
    n1 = high.sum(1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    mean = 1 + 2 * n1 * (n - n1) / n
    deviation = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    p_runs = np.where((n1 > 0) & (n1 < n), _erfc(np.abs(runs - mean) / deviation / math.sqrt(2)), 2.0 ** (1 - n))
    centred = values - (size - 1) / 2
    correlation = (centred[:, 1:] * centred[:, :-1]).sum(1) / ((n - 1) * (size * size - 1) / 12)
    p_serial = _erfc(np.abs(correlation) * math.sqrt((n - 1) / 2))
    half = -sum(np.log(np.clip(p, 1e-300, 1.0)) for p in (uniform, p_runs, p_serial))
    return np.minimum(1.0, np.exp(-half) * (1 + half + half * half / 2))


def levels(values: np.ndarray, size: int) -> np.ndarray:
    """The bin of each row's battery; 0 looks most random."""
    return np.minimum(BINS - 1, (-np.log10(np.maximum(battery(values, size), 1e-300)) * DECADE_BINS).astype(int))


def length_class(n: int) -> int:
    """In eighths of a doubling of the length; from 64 on, where the tests tell far apart, two classes to a doubling."""
    return int(math.log2(n) * 8) if n < 64 else 4 * int(math.log2(n) * 2)


def ordinary_levels(name: str, of_class: int, frequencies: np.ndarray) -> np.ndarray:
    """Sorted levels of tokens of the class's lengths (SIMULATED symbols in all), drawn with the corpus's ``frequencies`` of the symbols
    of base64 (in that alphabet's order); where the corpus has none of an alphabet's symbols, evenly."""
    rng = np.random.default_rng([17, of_class, list(ALPHABETS).index(name)])
    symbols = ALPHABETS["base64"]
    share = np.array([frequencies[symbols.index("+/"["-_".index(c)] if c in "-_" else c)] for c in ALPHABETS[name]], dtype=float)
    share = share / share.sum() if share.sum() else np.full(len(share), 1 / len(share))
    least, most = max(20, int(2 ** (of_class / 8))), int(2 ** ((of_class + 4) / 8)) + 2
    lengths = [LONGEST] if least > LONGEST else [n for n in range(least, most) if length_class(n) == of_class]
    lengths = [min(LONGEST, lengths[len(lengths) * (2 * i + 1) // 8]) for i in range(4)]
    return np.sort(np.concatenate([levels(rng.choice(len(share), size=(SIMULATED // 4 // n, n), p=share), len(share)) for n in lengths]))


def p_value(level: int, ordinary: np.ndarray) -> float:
    """The share of ordinary tokens at ``level`` or below, from their sorted simulated levels. Below the TAIL-th it is
    that of a log-normal law through it and their median, a little wider."""
    below = int(np.searchsorted(ordinary, level, side="right"))
    if below >= TAIL:
        return (1 + below) / (1 + len(ordinary))
    met = TAIL / (1 + len(ordinary))
    centre, edge = math.log1p(float(np.median(ordinary))), math.log1p(float(ordinary[TAIL - 1]))
    spread = max((centre - edge) / -NormalDist().inv_cdf(met) * WIDER, LEAST_SPREAD)
    share = lambda x: 0.5 * math.erfc((centre - x) / spread / math.sqrt(2))
    return min(met, met * share(math.log1p(level)) / max(share(edge), 1e-300))


def greatest_level(counts: dict[int, int], ordinary: np.ndarray, q: float) -> int:
    """The step-up of one stratum: tokens up to this level (-1: none) are reported. ``counts``: tokens by level."""
    total, so_far, found = sum(counts.values()), 0, -1
    for level in sorted(counts):
        so_far += counts[level]
        if p_value(level, ordinary) * total <= q * so_far:
            found = level
    return found


# Letters of ordinary text in a thousand.
LETTERS = {"a": 82, "b": 15, "c": 28, "d": 43, "e": 127, "f": 22, "g": 20, "h": 61, "i": 70, "j": 2, "k": 8, "l": 40, "m": 24, "n": 67, "o": 75, "p": 19, "q": 1, "r": 60, "s": 63, "t": 91, "u": 28, "v": 10, "w": 24, "x": 2, "y": 20, "z": 1}
#: Symbols that count as seen before the corpus, and how many of them in a thousand are capitals, digits and + and /.
PRIOR, CAPITALS, NUMERALS, MARKS = 20_000, 30, 15, 5


def prior_frequencies() -> np.ndarray:
    """Counts of the symbols of base64 in PRIOR symbols of ordinary text, for corpora too small to tell."""
    letters = np.array([LETTERS[c] for c in _LOWER]) / sum(LETTERS.values())
    parts = [letters * CAPITALS, letters * (1000 - CAPITALS - NUMERALS - MARKS), np.full(10, NUMERALS / 10), np.full(2, MARKS / 2)]
    return np.concatenate(parts) * PRIOR / 1000


_PLACES = np.full(256, 64, dtype=np.int64)
_PLACES[np.frombuffer(ALPHABETS["base64"].encode(), np.uint8)] = np.arange(64)


def _scan(batches):
    """Base spans and candidates of each text. The first row of a batch also has how often its texts hold each symbol of
    base64 outside the candidates."""
    for batch in batches:
        keys, rows, sha, counts, candidates = [], [], [], [[], [], []], []
        symbols, alike = np.zeros(65, dtype=np.int64), {}
        for text in batch.column(1).to_pylist():
            symbols += np.bincount(_PLACES[np.frombuffer(text.encode(), np.uint8)], minlength=65)
            spans = base_spans(text)
            keys.append(text_key(text))
            rows.append(as_structs(spans))
            sha.append(digest(spans, KINDS))
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in spans))
            more, starts, reached = [], [a for a, _, _ in spans], list(accumulate((b for _, _, b in spans), max))
            for m in _CANDIDATE.finditer(text):
                name = encoding(m[0])
                before = bisect_left(starts, m.end())
                if name and not (before and m.start() < reached[before - 1]):
                    symbols -= np.bincount(_PLACES[np.frombuffer(m[0].encode(), np.uint8)], minlength=65)
                    more.append({"stratum": f"{name}/{length_class(len(m[0]))}", "bin": 0, "start": m.start(), "stop": m.end()})
                    alike.setdefault((name, len(m[0])), []).append((more[-1], m[0]))
            candidates.append(more)
        for (name, n), found in alike.items():
            values = np.array([[_VALUES[name][c] for c in token] for _, token in found]).reshape(len(found), n)
            for (candidate, _), level in zip(found, levels(values, len(ALPHABETS[name])).tolist(), strict=True):
                candidate["bin"] = level
        first = [symbols[:64].tolist(), *[None] * (batch.num_rows - 1)][: batch.num_rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.string()), *[pa.array(x, pa.int64()) for x in counts], pa.array(sha, pa.string()), pa.array(rows, ARROW_SPANS), pa.array(candidates, pa.list_(pa.struct([("stratum", pa.string()), ("bin", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))), pa.array(first, pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates", "symbols"],
        )


def find(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    A null text counts as empty and has no spans. Rows of null or repeated doc_id are scanned like any other. Added
    spans never overlap base ones. Offsets count code points; ends are exclusive. Tokens are tested whole, however
    long. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    scratch = Scratch(spark)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base {SPAN_TYPE}, candidates array<struct<stratum:string,bin:int,start:bigint,stop:bigint>>, symbols array<bigint>"
    base = scratch.cut(texts.mapInArrow(_scan, schema))
    tokens = base.select("doc_id", "text_key", F.explode("candidates").alias("c")).select("doc_id", "text_key", "c.*")
    added = tokens.join(F.broadcast(reported_levels(tokens, base, q)), "stratum").where("bin <= greatest")
    added = added.select("doc_id", "text_key", "start", F.lit(KINDS.index("random")).cast("int").alias("place"), "stop")
    return with_added(base, added, KINDS).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")


def reported_levels(tokens: DataFrame, base: DataFrame, q: float) -> DataFrame:
    """``(stratum, greatest)``: the step-up's level of each stratum, from the counts of all tokens by stratum and level
    and of all symbols of the corpus. There are no more strata than encodings times length classes, whatever the input."""
    frequencies = prior_frequencies()
    for place, n in base.select(F.posexplode("symbols").alias("place", "n")).groupBy("place").agg(F.sum("n")).collect():
        frequencies[place] += n
    strata: dict[str, dict[int, int]] = {}
    for stratum, level, n in tokens.groupBy("stratum", "bin").agg(F.count("*")).collect():
        strata.setdefault(stratum, {})[level] = n
    rows = []
    for stratum, counts in sorted(strata.items()):
        name, _, of_class = stratum.partition("/")
        rows.append((stratum, greatest_level(counts, ordinary_levels(name, int(of_class), frequencies), q)))
    return tokens.sparkSession.createDataFrame(rows, "stratum string, greatest int")
