import random

import numpy as np

from sparkloom.llm import toxicity


def corpus(n=1500, seed=2):
    rng = random.Random(seed)
    calm = ["river", "stone", "house", "winter", "garden", "letter", "music", "paper"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(calm) + rng.choice(["", "s", "ly"]) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["Scumbag", "moron", "trollen" + rng.choice(["a", "bb", "xyz"])])
        rows.append((i, " ".join(w), "score"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    truth = dict(labels)
    rows += [(None, "a moron", "x"), (5000, None, "x"), (5001, "", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    given = spark.createDataFrame([*labels, (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, given)).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got) and len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score and by_id[5000].predicted == 0
    kept = toxicity.kept(docs, toxicity.fit(docs, given))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted == 0}


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    import zlib

    rows, labels = corpus(400)
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()) for x in (labels, flipped))
    assert a == b


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()] == [0]
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def with_clean(*columns):
    """Voters for toxic, and the one for clean where none of them votes."""
    found = np.stack(columns, axis=1)
    return np.hstack([found, 1 - found.max(axis=1, keepdims=True)])


def test_correlated_voters_share_their_evidence():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    one = (rng.random(4000) < np.where(y, 0.6, 0.1)).astype(float)
    other = (rng.random(4000) < np.where(y, 0.6, 0.1)).astype(float)
    labels = y.astype(float)
    same = toxicity.label_model(with_clean(*[one] * 5), labels)
    single = toxicity.label_model(with_clean(one), labels)
    assert np.abs(same - single).max() < 0.05
    assert toxicity.label_model(with_clean(one, other), labels)[(one > 0) & (other > 0) & (labels > 0)].mean() > 0.9


def weak_votes(n=6000, voters=12, seed=4):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.2
    votes = [(rng.random(n) < np.where(y, 0.3, 0.001)).astype(float) for _ in range(voters)]
    return y.astype(float), with_clean(*votes), rng


def test_accuracies_are_estimated_without_the_given_labels():
    truth, votes, rng = weak_votes()
    # the labels say nothing but how many texts of each class there are
    noise = rng.permutation(truth)
    found = toxicity.label_model(votes, noise)
    assert ((found >= 0.5) == (truth == 1)).mean() > 0.97


def test_the_label_model_matters():
    truth, votes, rng = weak_votes()
    # most toxic texts are labelled clean, and some clean ones toxic
    given = np.where(truth == 1, rng.random(len(truth)) < 0.35, rng.random(len(truth)) < 0.02).astype(float)
    half = len(truth) // 2

    def caught(target):
        weights, bias = toxicity.linear_classifier(votes[:half], target)
        called = votes[half:] @ weights + bias >= 0
        return called[truth[half:] == 1].mean(), called[truth[half:] == 0].mean()

    by_model, by_labels = caught(toxicity.label_model(votes[:half], given[:half])), caught(given[:half])
    assert by_model[0] > 0.9 and by_model[1] < 0.03
    assert by_labels[0] < 0.7


def test_terms_beyond_the_strongest_are_pooled_not_cut():
    terms = [f"t{i}" for i in range(5000)]
    numbers = toxicity.voter_numbers(terms)
    assert numbers[: toxicity.ALONE] == list(range(toxicity.ALONE)) and numbers == sorted(numbers)
    assert set(numbers) == set(range(toxicity.ALONE + toxicity.LEXICA))
    assert toxicity.voter_numbers(terms[:5]) == [0, 1, 2, 3, 4] and toxicity.voter_numbers([]) == []


def test_long_text_and_clashing_columns(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t, _ in rows] + [(9000, "river stone " * 300_000 + "moron", "b", 2)], "doc_id long, text string, toxic string, feature int")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, model).collect()}
    assert got[9000] == 1
    kept = toxicity.kept(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, p in got.items() if p == 0}
