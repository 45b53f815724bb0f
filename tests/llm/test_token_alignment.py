import hashlib
import random
from collections import Counter

import pytest

from codeweave.llm import token_alignment as ta
from codeweave.llm.queries import piece_path, tokenizer_path


@pytest.fixture(scope="module")
def aligner():
    with open(tokenizer_path(), encoding="utf-8") as a, open(piece_path(), "rb") as b:
        return ta.Aligner(a.read(), b.read())


def by_hand(aligner, text):
    """Groups of one text, encoded whole and cut by decoded bytes alone: [([a ids], [b ids])], or None."""
    if not text:
        return None
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(aligner.bytes_a[i] for i in a) != raw or b"".join(aligner.bytes_b[i] for i in b) != raw:
        return None

    def ends(ids, table):
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        return out

    ea, eb = ends(a, aligner.bytes_a), ends(b, aligner.bytes_b)
    groups, lo = [], 0
    for cut in sorted(set(ea) & set(eb)):
        groups.append(([i for i, e in zip(a, ea) if lo < e <= cut], [i for i, e in zip(b, eb) if lo < e <= cut]))
        lo = cut
    return groups


def expected(aligner, texts):
    every = [by_hand(aligner, t) for t in texts]
    links = [Counter((x, y) for a, b in groups or () for x in a for y in b) for groups in every]
    counts = Counter(p for found in links for p in found)
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for groups, found in zip(every, links):
        if groups is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(found.values()), sum(n for (a, b), n in found.items() if counts[a, b] == most[a]), sum(n * counts[p] for p, n in found.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def odd_texts():
    rng = random.Random(4)
    pieces = ["a", "word", "é", "漢字", "🙂", "▁", " ", "  ", "\n", "\t", " ", "\u0085", "\x1c", "<s>", "<|endoftext|>", "<0x41>", "don't", "=" * 70, "12 345", "é", "‍", "\r\n", "Ａ", "ﬁ", ".", "\x00", "᠎"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    return texts + [None, "", " ", "  ", "\n", "a ", " a", "a  ", "-" * 20001 + "=" * 9999, "plain words", "plain words", "x" * 5000]


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("limit", [ta.MAX_BROADCAST_PAIRS, 50, 0])
def test_against_whole_texts(spark, aligner, limit):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, pair string, row long").repartition(3)
    got, want = rows(ta.align(docs, tokenizer_path(), piece_path(), limit)), expected(aligner, texts)
    assert [(i, texts[i], g, w) for i, (g, w) in enumerate(zip(got, want)) if g != w] == []
    assert sum(w[0] > 0 for w in want) > 700 and any(w[0] == 0 for w in want[:1500])


def test_documents(spark, aligner):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert rows(ta.align(docs, tokenizer_path(), piece_path())) == expected(aligner, texts)


def test_units_are_forgotten(aligner, monkeypatch):
    monkeypatch.setattr(ta, "MAX_UNITS", 40)
    texts = [t for t in odd_texts() if t][:300]
    whole = [aligner.batch([t]) for t in texts]
    assert len(aligner.index) < 400
    aligner.forget()
    for t, have in zip(texts, whole):
        want = aligner.batch([t])
        assert want[1] == have[1] and (want[0] == have[0]).all() and (want[2] == have[2]).all() and (want[3] == have[3]).all()
    aligner.forget()


def test_odd_tables(spark):
    schema = "doc_id long, text string, `a b` string"
    assert ta.align(spark.createDataFrame([], schema), tokenizer_path(), piece_path()).count() == 0
    got = ta.align(spark.createDataFrame([(None, "one", "x"), (3, "one", None), (3, "one", None)], schema), tokenizer_path(), piece_path()).collect()
    assert len(got) == 3 and {r.count_sum for r in got} == {3 * got[0].n_links}
