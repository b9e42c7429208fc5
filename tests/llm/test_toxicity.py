import math
import re

import numpy as np
import pytest

from quietlog.llm import toxicity


def corpus(rng, n):
    texts, labels = {}, []
    for i in range(n):
        bad = i % 5 == 0
        words = ["w%d" % rng.randrange(300) for _ in range(60)]
        if bad:
            for at in range(1 + i % 7):
                words[at * 8] = rng.choice(["scum", "vile", "moronic"])
        texts[i] = " ".join(words)
        labels.append((i, int(bad)))
    return texts, labels


def test_held_out_accuracy_and_shared_weights(spark, documents, rng):
    texts, labels = corpus(rng, 500)
    df = documents(texts, clash=True)
    train = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    model = toxicity.fit(df, train)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    rows = {r["doc_id"]: r for r in toxicity.grade(df, model).collect()}
    held = [x for x in labels if not x[0] % 3]
    assert sum(rows[i]["rejected"] == bool(t) for i, t in held) / len(held) > 0.97
    assert rows[6 * 5]["expected_severity"] > rows[1]["expected_severity"]
    kept = toxicity.keep_civil(df, model)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if not r["rejected"]}


def test_missing_labels_and_texts(spark, documents, rng):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    df = documents([(1, "a"), (1, "a"), (None, None), (2, "")])
    model = toxicity.fit(df, labels)
    assert model.thresholds == [] and toxicity.keep_civil(df, model).count() == 4
    assert {(r["expected_severity"], r["grade"], r["rejected"]) for r in toxicity.grade(df, model).collect()} == {(0.0, 0, False)}
    empty = toxicity.fit(documents([]), labels.limit(0))
    assert toxicity.grade(documents([]), empty).count() == 0
    texts, pairs = corpus(rng, 100)
    fitted = toxicity.fit(documents(texts), spark.createDataFrame(pairs + [(0, 0), (5, 1)], "doc_id long, toxic int"))
    rows = {r["doc_id"]: r["rejected"] for r in toxicity.grade(documents({1: None, 2: "", 3: "scum " * 30000}), fitted).collect()}
    assert rows == {1: False, 2: False, 3: True}


def test_ordinal_gradient_reaches_the_likelihood_of_the_data():
    rows = [{0: 1.0}] * 30 + [{}] * 70
    grades = np.array([1] * 20 + [2] * 10 + [0] * 60 + [1] * 8 + [2] * 2)
    weights, thresholds = toxicity.fit_ordinal(rows, grades, 1, l2=0.0, steps=3000)
    assert thresholds[0] < thresholds[1] and weights[0] > 2
    above = 1 / (1 + np.exp(thresholds[0]))
    assert above == pytest.approx(0.14, abs=0.03)


def test_grades_split_toxic_documents_at_their_median():
    got = toxicity.severity_grades(np.array([True, True, False, True]), np.array([5, 1, 9, 2]))
    assert got.tolist() == [2, 1, 0, 1]


def test_grades_against_brute_force(spark, documents, rng):
    """The formula worked out text by text, from the weights and thresholds alone."""
    words = ["ab", "abcd", "abcdefgh", "Éa", "x1", "zz", "toxicword"]
    model = toxicity.OrdinalModel({"abcd": 0.7, "abcd-": -0.2, "abcde-": 1.1, "éa": 0.4, "zz": -0.9, "toxic-": 2.0}, [0.5, 1.75])
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(40))) for i in range(80)} | {900: None, 901: "", 902: "abcdefgh " * 9000}
    for r in toxicity.grade(documents(texts, clash=True), model).collect():
        counts = {}
        for w in re.findall(r"\w+", (texts[r["doc_id"]] or "").lower()):
            for f in {w, *(w[:n] + "-" for n in (4, 5, 6, 7) if len(w) > n)} & set(model.weights):
                counts[f] = counts.get(f, 0) + 1
        score = sum(model.weights[f] * math.log(1 + n) for f, n in counts.items())
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r["expected_severity"] == pytest.approx(sum(above)) and r["grade"] == sum(p > 0.5 for p in above)
        assert r["rejected"] == (above[0] > 0.5)


def test_fitted_parameters_are_those_of_the_greatest_likelihood():
    """No step in any direction raises the penalised likelihood by much."""
    r = np.random.default_rng(8)
    x = r.poisson(1.0, (400, 3)).astype(float)
    score = x @ [1.5, -1.0, 0.0] + r.logistic(size=400)
    grades = (score > 0.3).astype(int) + (score > 2.0)
    rows = [{j: v for j, v in enumerate(row) if v} for row in x]
    w, theta = toxicity.fit_ordinal(rows, grades, 3, l2=1e-4, steps=3000)

    def likelihood(w, theta):
        cuts = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = (1 / (1 + np.exp(-np.clip(cuts[grades + i] - x @ w, -500, 500))) for i in (1, 0))
        return np.log(upper - lower).mean() - 0.5e-4 * (w @ w)

    best = likelihood(w, theta)
    assert theta[0] < theta[1]
    for step in (0.05, -0.05):
        for j in range(3):
            assert likelihood(w + step * np.eye(3)[j], theta) <= best + 1e-4
        for j in range(2):
            assert likelihood(w, theta + step * np.eye(2)[j]) <= best + 1e-4
