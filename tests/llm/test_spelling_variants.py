import random
import re
import zlib
from collections import Counter

import pytest

from codeweave.llm import spelling_variants as sv

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def neighbours(word):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in LETTERS} | {a + c + b for a, b in cuts for c in LETTERS}
    return out - {word}


def counts_by_hand(rows, modulus=199):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def variants_by_hand(counts, ratio=5):
    near = {w: [x for x in neighbours(w) if x in counts] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = variants_by_hand(counts_by_hand([(r.doc_id, r.text) for r in docs.collect()]))
    assert got(sv.group_variants(docs)) == want and any(w[0] for w in want.values())


@pytest.mark.parametrize("limit", [1024, 7, 1])
def test_invented_words(spark, monkeypatch, limit):
    """Ties, chains of forms, accents, and blocks of several chunks."""
    monkeypatch.setattr(sv, "CHUNK_WORDS", limit)
    rng = random.Random(5)
    words = {"".join(rng.choice("aeinrt") for _ in range(rng.randrange(6, 9))): 5 for _ in range(60 if limit == 1 else 600)}
    chain = ["letters", "lettes", "lettres", "léttres", "léttrÀs", "léttr×s", "léttrsÿ"]
    words |= {w: 5 ** (len(chain) - i) for i, w in enumerate(chain)}
    words |= {w: rng.choice([5, 25, 125]) for w in list(words)[:50]} | {"z" * 3000: 5, "z" * 3001: 25}
    have = sv.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert got(have) == variants_by_hand({w: n for w, n in words.items() if len(w) < 3000} ) | {"z" * 3000: ("z" * 3001, "z" * 3001, 5, 1, 25), "z" * 3001: (None, "z" * 3001, 25, 1, None)}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sv, "PIECE", 50)
    monkeypatch.setattr(sv, "COUNTED_WORDS", 10)
    rng = random.Random(6)
    texts = [None, "", " \n", "É" * 200, *[" ".join(rng.choice(["Wördern", "worder", "WORDER", "ſword", "Straße×", "wo1rders", "x" * 70]) for _ in range(40)) for _ in range(12)]]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[5])] * 3
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, word string, `a b` int")
    counts = counts_by_hand(rows, 7)
    assert counts and got(sv.group_variants(docs, typo_modulus=7)) == variants_by_hand(counts)
    assert sv.group_variants(docs.limit(0)).count() == 0
