import random
import string

import numpy as np

import corpus_pipeline
from codeweave.llm import secrets


def test_few_secrets_among_many_ordinary_tokens():
    """What is reported doesn't depend on how many ordinary tokens there are."""
    ordinary = secrets.ordinary_levels("base62", secrets.length_class(40), secrets.prior_frequencies())
    rng = np.random.default_rng(5)
    common = {int(k): int(n) * 100 for k, n in zip(*np.unique(ordinary, return_counts=True))}
    assert sum(common.values()) > 1_000_000
    for planted in (5, 50):
        counts = dict(common)
        for level in secrets.levels(rng.integers(0, 62, (planted, 40)), 62).tolist():
            counts[level] = counts.get(level, 0) + 1
        reported = secrets.greatest_level(counts, ordinary, 0.05)
        assert sum(n for level, n in counts.items() if level <= reported) >= planted * 0.6
    assert secrets.greatest_level(common, ordinary, 0.05) == -1
    p = [secrets.p_value(x, ordinary) for x in range(0, 400)]
    assert all(a <= b for a, b in zip(p, p[1:])) and p[0] < 1e-6


def test_secrets_in_a_corpus(spark):
    rng = random.Random(8)
    alphabet = string.ascii_letters + string.digits
    planted = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(5)]
    letters = "".join(c * n for c, n in secrets.LETTERS.items())
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(40)) for _ in range(50))) for i in range(2000)]
    rows += [(10_000 + i, f"the key is {token} here") for i, token in enumerate(planted)]
    found = secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).where("n_added > 0").collect()
    assert {r.doc_id for r in found} == {10_000 + i for i in range(5)}


def test_long_tokens_and_base_spans_before_them(spark):
    rng = random.Random(9)
    token = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    groups = ".".join("".join(rng.choice("0123456789abcdef") for _ in range(16)) for _ in range(4))
    texts = [f"token={groups}.{token}", "x " + "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(200_000))]
    found = {r.doc_id: r for r in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found[0].n_added == 0 and found[0].n_assign == 1
    assert found[1].n_added == 1
    assert len(secrets.ordinary_levels("base64", secrets.length_class(10_000_000), secrets.prior_frequencies())) == secrets.SIMULATED // secrets.LONGEST


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = ["a b", "lang_pred", "key", "row", "doc_id2", "component", "x.y", "topic", "score"]
    named = docs.selectExpr("*", *[f"doc_id % 7 as `{c}`" for c in odd])
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept, plain = stage(spark, named, None), stage(spark, docs, None)
        assert kept.columns == named.columns and kept.count() == plain.count() > 0
        assert kept.where("doc_id % 7 <> `x.y` or doc_id % 7 <> `a b`").count() == 0
        assert stage(spark, named.limit(0), None).count() == 0
