import hashlib
import random

import pytest

from codeweave.llm import repeated_bytes


def by_hand(rows, length):
    """Removed flags of every byte, with a table of all strings; rows are (id, text) in order of precedence."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


def odd_texts(rng):
    alphabet = "ab "
    noise = lambda n, letters="abcdefghij é": "".join(rng.choice(letters) for _ in range(n))
    shared = [noise(n) for n in (99, 100, 101, 150, 163, 164, 300, 2000)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 5000, "xy" * 700, "é" * 200, noise(3000) + "x" * 300]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            lo = rng.randrange(len(s))
            part = rng.choice([s, s[lo:], s[:lo], noise(rng.randrange(120)), noise(rng.randrange(400), alphabet)])
            if part and rng.random() < 0.3:
                k = rng.randrange(len(part))
                part = part[:k] + "#" + part[k + 1 :]
            parts.append(part)
        texts.append("".join(parts))
    return texts + texts[20:40]


@pytest.mark.parametrize(("seed", "length"), [(1, 100), (2, 100), (3, 72), (4, 131)])
def test_against_all_strings(spark, seed, length):
    texts = odd_texts(random.Random(seed))
    rows = [(3 * i - 100, t) for i, t in enumerate(texts)]
    shuffled = random.Random(seed).sample(rows, len(rows))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in shuffled], "doc_id long, text string, rank int, doc string").repartition(5)
    found, want = got(repeated_bytes.remove_repeats(docs, length)), by_hand(rows, length)
    assert [(i, found[i], w) for (i, _), w in zip(rows, want) if found[i] != w] == []


def test_one_range_per_row(spark, monkeypatch):
    """Runs that cross many sorted ranges."""
    monkeypatch.setattr(repeated_bytes, "RANGE_ROWS", 7)
    texts = ["x" * 150 + "tail of the first", *["common passage " * 12 + str(i % 3) for i in range(40)], "x" * 170]
    rows = list(enumerate(texts))
    found = got(repeated_bytes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [found[i] for i, _ in rows] == by_hand(rows, 100)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    found = got(repeated_bytes.remove_repeats(docs))
    assert [found[i] for i, _ in rows] == by_hand(rows, 100) and sum(x[1] for x in found.values()) > 10_000


def test_odd_tables(spark):
    schema = "doc_id long, text string, `a b` string"
    assert repeated_bytes.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    a, b = "first " * 40 + "q", "second " * 40
    rows = [(1, a, "u"), (1, a, "v"), (2, b, "u"), (2, a + b, None), (None, b, "u"), (None, None, "u")]
    found = repeated_bytes.remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 6
    ones = [r for r in found if r.doc_id == 1]
    assert ones[0] == ones[1] and bytes(ones[0].kept) == b"first q"  # only what repeats within the text
    assert sorted(r.n_removed == r.n_bytes for r in found if r.doc_id is None) == [True, True]
    with pytest.raises(ValueError, match="at least"):
        repeated_bytes.remove_repeats(spark.createDataFrame(rows, schema), 50)
