"""Quality classifier, toxicity and LM scoring: held-out accuracy and odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import lm_scoring, quality_classifier, toxicity
from factloom.llm._text import text_buffers
from factloom.llm.queries import op2_quality_classifier, op3_quality_rules, op5_lm_scoring, op9_toxicity

MIDDLE = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def joined(spark, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    kept = [r for r in rows if r.doc_id in labels]
    return kept, np.array([labels[r.doc_id] for r in kept])


def test_quality_held_out(spark):
    rows = op2_quality_classifier(spark, MIDDLE).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    kept, y = joined(spark, rows, "quality")
    held = np.array([r.held_out for r in kept])
    assert auc(y[held], np.array([r.score for r in kept])[held]) > 0.97


def test_toxicity_held_out(spark):
    rows = op9_toxicity(spark, MIDDLE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept, y = joined(spark, rows, "toxic")
    predicted = np.array([r.predicted for r in kept])
    assert (predicted == y).mean() > 0.9 and predicted[y == 1].mean() > 0.5


def test_rules_and_language_models_agree_with_labels(spark):
    rows, y = joined(spark, op3_quality_rules(spark, MIDDLE).collect(), "quality")
    passed = np.array([not r.base_failed for r in rows])
    assert np.array([r.kept for r in rows])[(y == 0)].mean() < 0.05
    assert np.array([r.kept for r in rows])[(y == 1) & passed].mean() > 0.98
    rows, y = joined(spark, op5_lm_scoring(spark, MIDDLE).collect(), "quality")
    assert auc(y, np.array([r.score for r in rows])) > 0.95


def test_language_model_against_plain_counts():
    texts, good = ["abcab", "", "bca", "é a"], [True, False, False, True]
    data, offs = text_buffers(pa.array(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(good)], names=["text", "good"])
    models = lm_scoring.Models(*lm_scoring._count(batch))
    got = models.loss_gap(data, offs)
    grams = [[Counter(), Counter()] for _ in lm_scoring.ORDERS]
    contexts = [[Counter(), Counter()] for _ in lm_scoring.ORDERS]
    rows = [t.encode() for t in texts]
    each = [(k, b"\0" * 4 + r, i + 4) for k, r in enumerate(rows) for i in range(len(r))]
    for k, padded, i in each:
        for j, n in enumerate(lm_scoring.ORDERS):
            for side in (0, 1) if good[k] else (0,):
                grams[j][side][padded[i - n + 1 : i + 1]] += 1
                contexts[j][side][padded[i - n + 1 : i]] += 1
    want = []
    for _, padded, i in each:
        p = [1e-6 + sum(lm_scoring.MIX[j] * grams[j][s][padded[i - n + 1 : i + 1]] / max(1, contexts[j][s][padded[i - n + 1 : i]]) for j, n in enumerate(lm_scoring.ORDERS)) for s in (0, 1)]
        want.append(np.log(p[1]) - np.log(p[0]))
    assert np.allclose(got, want, atol=1e-4)


def test_language_model_keeps_every_ngram_apart(spark):
    """Two 5-grams that share a slot of 2**20 keep their own counts, whichever way the model travels."""
    from factloom.llm._features import bucket

    rng = np.random.default_rng(5)
    some = rng.integers(97, 123, (20_000, 5)).astype(np.uint64)
    packed = sum(some[:, k] << np.uint64(8 * (4 - k)) for k in range(5))
    slots, seen = bucket(packed, 20, 5 * 7_000_003), {}
    a, b = next((seen[s], k) for k, s in enumerate(slots.tolist()) if seen.setdefault(s, k) != k and packed[seen[s]] != packed[k])
    texts = [bytes(some[a].astype(np.uint8)).decode() * 3, bytes(some[b].astype(np.uint8)).decode() * 3, "".join(map(chr, rng.integers(33, 127, 40_000)))]
    rows = [t.encode() for t in texts]
    counts = [[Counter(), Counter()] for _ in range(6)]
    each = [[(b"\0" * 4 + r)[i : i + 5] for i in range(len(r))] for r in rows]
    for k, grams in enumerate(each):
        for side in (0, 1) if k == 0 else (0,):
            for j, n in enumerate(lm_scoring.ORDERS):
                counts[2 * j][side].update(g[5 - n :] for g in grams)
                counts[2 * j + 1][side].update(g[5 - n : 4] for g in grams)
    p = lambda g, s: 1e-6 + sum(lm_scoring.MIX[j] * counts[2 * j][s][g[5 - n :]] / max(1, counts[2 * j + 1][s][g[5 - n : 4]]) for j, n in enumerate(lm_scoring.ORDERS))
    want = {k: sum(np.log(p(g, 1)) - np.log(p(g, 0)) for g in grams) / len(grams) for k, grams in enumerate(each)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = lm_scoring.fit(docs, docs.where("doc_id = 0"))
    for how in ({}, {"bound": 10, "group_bytes": 20_000}):
        got = {r.doc_id: r.score for r in lm_scoring.score(docs, fitted, **how).collect()}
        assert got == pytest.approx(want, abs=1e-6)
    assert fitted.count() == len(counts[4][0])
    new = spark.createDataFrame([(7, "zzzzz unseen"), (8, None)], "doc_id long, text string")
    both = [sorted(map(tuple, lm_scoring.score(new, fitted, **how).collect())) for how in ({}, {"bound": 10, "group_bytes": 20_000})]
    assert both[0][0][2] == pytest.approx(both[1][0][2]) and both[0][1] == both[1][1] == (8, 0, 0.0)


def test_dual_coordinate_descent_separates():
    r = np.random.default_rng(0)
    rows = [(np.unique(np.concatenate([r.integers(0, 500, 30), [1000 + y]])).astype(np.int64), y) for y in r.integers(0, 2, 200).tolist()]
    model = quality_classifier.fit(rows)
    margins = [(model.weight[f].sum() / np.sqrt(model.square[f].sum()) + model.bias) * model.slope + model.shift for f, _ in rows]
    assert all((m > 0) == bool(y) for m, (_, y) in zip(margins, rows))


@pytest.fixture(scope="module")
def costs(spark):
    return toxicity.language_model(spark.read.parquet(f"{MIDDLE}/documents.parquet"))


def test_deobfuscation(costs):
    restore = toxicity.Restorer(costs).restore
    for odd, plain in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("mooooron", "moron"), ("tr4sh", "trash"), ("cl0wn", "clown"), ("$cum", "scum"), ("stuuuupid", "stupid")]:
        assert restore(f"the {odd} of") == f"the {plain} of"
    for plain in ["the onthing of and", "4111111111111111 2.0", "+1 (555) 555-1234", "Onthre$$$ an!! the***", "mail a@b.co"]:
        assert restore(plain).lower() == plain.lower()


def test_rows_with_one_path_are_not_decoded(costs):
    """Every row that restoring changes is flagged for it."""
    r = toxicity.Restorer(costs)
    bits = ["the", "a", "é", "i d i o t", "é é é", "l0ser", "$cum", "aaa", "ééé", "!", "5", " ", "\n", "x.y.z", "a-b"]
    rng = np.random.default_rng(1)
    for _ in range(400):
        text = " ".join(rng.choice(bits, rng.integers(0, 6)))
        if r.restore(text).lower() != text.lower():
            assert toxicity.suspicious(*text_buffers(pa.array([text])))[0], text


def test_rows_with_a_euro_sign_are_decoded(costs):
    r = toxicity.Restorer(costs)
    for text in ("you l€per", "€vil man", "a h € y b"):
        assert r.restore(text).lower() != text and toxicity.suspicious(*text_buffers(pa.array(["", text, "a"]))).tolist() == [False, True, False], text


def test_lower_like_python():
    text = "ABC ÉÀÖÞ ×÷ ß Ÿ z"
    got = toxicity.lower(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()
    assert got == re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text)


ODD = [(1, None), (2, ""), (None, "some words"), (3, " \n"), (3, " \n"), (4, "word " * 40_000), (5, "é" * 10)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (4, 0, 1), (4, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        q = quality_classifier.score(docs, quality_classifier.train(docs, some)).collect()
        t = toxicity.score(docs, toxicity.train(docs, some)).collect()
        m = lm_scoring.score(docs, lm_scoring.fit(docs, some.where("quality = 1"))).collect()
        for rows in (q, t, m):
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ODD)
        assert all(0 <= r.score <= 1 for r in [*q, *t]) and all(r.held_out is False for r in [*q, *t] if r.doc_id is None)
        assert len({r.score for r in q if r.doc_id in (1, 2)}) == 1
    empty = docs.limit(0)
    assert quality_classifier.score(empty, quality_classifier.train(empty, labels)).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert lm_scoring.score(empty, lm_scoring.fit(empty, labels)).count() == 0
    scorer = toxicity.train(docs, labels)
    assert toxicity.drop_toxic(docs, scorer).columns == docs.columns
