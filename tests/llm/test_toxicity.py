"""The factorization machine against double sums and finite differences, and what it learns."""

import zlib

import numpy as np
import pytest

from tests.llm.test_text import rng, table, words
from tidelens.llm import toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def machine(r, m=40):
    known = np.sort(r.choice(toxicity.BUCKETS, m, replace=False)).astype(np.uint32)
    return toxicity.Machine(known, -0.7, r.normal(0, 0.3, m), r.normal(0, 0.3, (m, 5)))


def double_sum(m, i):
    z = m.bias + sum(m.linear[a] for a in i)
    z += sum(m.factors[a] @ m.factors[b] for k, a in enumerate(i) for b in i[:k])
    return 1 / (1 + np.exp(-z))


def test_scores_are_the_double_sum_over_pairs():
    r = rng(1)
    m = machine(r)
    rows = [np.sort(r.choice(40, int(r.integers(0, 15)), replace=False)) for _ in range(30)]
    assert np.allclose(m.scores(rows), [double_sum(m, i) for i in rows], atol=1e-12)
    assert m.score(m.known[[3, 5, 9]]) == pytest.approx(double_sum(m, [3, 5, 9])) and m.scores([]).shape == (0,)


def test_the_gradient_is_that_of_finite_differences():
    r = rng(2)
    m = machine(r, 12)
    rows = [np.sort(r.choice(12, int(r.integers(0, 6)), replace=False)) for _ in range(20)]
    y = r.integers(0, 2, 20).astype(float)
    doc, i = np.repeat(np.arange(20), [len(x) for x in rows]), np.concatenate(rows).astype(np.int64)

    def loss(w, v):
        p = toxicity.sigmoid(toxicity.logits(doc, i, 20, m.bias, w, v)[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    z, vi, total = toxicity.logits(doc, i, 20, m.bias, m.linear, m.factors)
    touched, dw, dv = toxicity.gradient(doc, i, toxicity.sigmoid(z) - y, vi, total)
    for k, a in enumerate(touched):
        step = np.zeros(12)
        step[a] = 1e-5
        assert dw[k] == pytest.approx((loss(m.linear + step, m.factors) - loss(m.linear - step, m.factors)) / 2e-5, abs=1e-8)
        for f in range(5):
            step = np.zeros((12, 5))
            step[a, f] = 1e-5
            assert dv[k, f] == pytest.approx((loss(m.linear, m.factors + step) - loss(m.linear, m.factors - step)) / 2e-5, abs=1e-8)


@pytest.mark.parametrize("toxic_if", [lambda a, b: a != b, lambda a, b: a and b])
def test_a_pair_is_learnt_whether_or_not_its_terms_show_alone(spark, toxic_if):
    r = rng(9)
    texts, toxic = [], []
    for i in range(4000):
        w = words(r, 30).split()
        insult, group = i % 2 == 0, i // 2 % 2 == 0
        w += ["insult"] * insult + ["people"] * group
        r.shuffle(w)
        texts.append(" ".join(w))
        toxic.append(int(toxic_if(insult, group)))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    learnt = toxicity.train(docs, labels)
    out = toxicity.score(docs, learnt, "score").collect()
    assert np.mean([(x["score"] >= 0.5) == toxic[x["doc_id"]] for x in out if x["doc_id"] < 4000 and held(x["doc_id"])]) > 0.98
    assert len(out) == 4002 and all(0 <= x["score"] <= 1 and x["size"] == 1 for x in out)
    assert [learnt.score(toxicity.terms(x["text"])) for x in out[:50]] == pytest.approx([x["score"] for x in out[:50]])


def test_repeated_ids_rows_and_order_change_nothing(spark):
    r = rng(3)
    texts = [words(r, 12) + (" fool" if i % 3 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    once, more = table(spark, texts), table(spark, texts * 3, [*range(600)] * 3)
    a, b = (toxicity.train(d, labels) for d in (once, more.repartition(5)))
    assert (a.known == b.known).all() and a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()
    two = toxicity.train(table(spark, ["a b", "c d", "e f"], [1, 1, 1]), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    assert two.score(toxicity.terms("a b")) == two.score(toxicity.terms(None))


def test_tables_without_rows_or_labels(spark):
    docs, labels = table(spark, ["a", None]), spark.createDataFrame([], "doc_id bigint, toxic int")
    none = toxicity.train(docs, labels)
    assert 0 < none.score(toxicity.terms("x")) < 1 and toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.score(docs, none).columns == [*docs.columns, "toxicity"] and toxicity.train(docs.limit(0), labels).bias == none.bias


def test_long_texts_count_whole(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    learnt = toxicity.train(table(spark, [f"w{i % 7} " + "fool" * (i % 2) for i in range(200)]), labels)
    long = "la " * 1_200_000
    a, b = (x["toxicity"] for x in toxicity.score(table(spark, [long, long + "fool"]), learnt).orderBy("doc_id").collect())
    assert a == learnt.score(toxicity.terms("la")) < 0.7 < b
