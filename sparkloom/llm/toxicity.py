"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model of their accuracies and
correlations, and a linear classifier trained on its posterior labels.

Voters are words and word beginnings that a bounded sample of the labelled training rows shows to be much more frequent in toxic
texts, the strongest alone and the others in lexica of several, and some fixed patterns; they vote toxic where they are found and
abstain elsewhere, as a text's language already keeps most of them out of it. A text without any listed term gets a vote for clean.
The label model takes the true label as hidden. Its classes start from the votes alone; expectation maximisation then estimates, for
each voter, how often it votes on toxic and on clean texts, and voters that vote together in texts of one class share their
evidence in proportion to their squared correlations. The given label is one more voter and only that: its estimated accuracy
counts up to ``ANCHOR``, so votes that agree overrule it. A logistic regression learns the posterior from the votes, and
scores every whole text. Labels, language, source and doc_id are never inputs of a score.

Defined cases: a null or empty text has no voter found and gets the score of that; texts of any length are read whole; a document with
several labels is toxic if any of them says so; labels of null ids or values, and of absent documents, are ignored; with no toxic
training label there are no lexicon voters and every score is low; repeated rows score alike; an empty table gives no rows; other
columns are ignored by ``scored`` and returned as they are by ``kept``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, slices, stage

#: At most so many labelled rows, those of least hash, are used to fit.
FIT_ROWS = 20_000
#: Terms that are voters of their own, the strongest, and lexica that all others are dealt to, in order of strength.
ALONE, LEXICA = 192, 8
#: A candidate has to occur in so many toxic texts, and its rate there has to be so many times that in clean texts.
LEAST_TOXIC, LEAST_LIFT = 3, 6.0
FALSE_RATE = 0.3
BEGINNINGS = (4, 5, 6)
FOLDS = 5
#: Words whose voters a worker keeps.
KNOWN = 100_000
#: The accuracy up to which the given label counts, and the log odds at which votes start.
ANCHOR, START = 0.9, 2.0
_WORD = re.compile(r"[^\W_]+")
#: Patterns that vote whatever the sample shows.
PATTERNS = {
    "shouting": re.compile(r"(?:\b[^\W\d_a-zß-öø-ÿ]{3,}\b\W+){3}"),
    "exclaiming": re.compile(r"[!?]{3,}"),
    "you are": re.compile(r"\b(?:you(?:'re| are)|du bist|tu es|eres)\s+\w+", re.I),
    "masked": re.compile(r"\b\w[*#@$%]{2,}\w*", re.I),
}
_SHOUTED = re.compile(r"[^\W\d_a-zß-öø-ÿ]{3}")


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0)


def features(text: str) -> set[str]:
    """The distinct words of a text, and beginnings of words (marked ``*``)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass(frozen=True)
class Model:
    """Voters and the classifier over their votes; ``words`` and ``starts`` have the number of each term's voter."""

    words: dict[str, int]
    starts: dict[str, int]
    lexicon: int
    weights: np.ndarray
    bias: float

    #: The voters of words met lately.
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def _voters(self, word: str) -> tuple[int, ...]:
        found = [self.words[word]] if word in self.words else []
        found += [self.starts[word[:n]] for n in BEGINNINGS if len(word) > n and word[:n] in self.starts]
        if len(self.known) >= KNOWN:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = tuple(found)
        return tuple(found)

    def votes(self, text: str) -> list[int]:
        """The voters found in a text."""
        found: set[int] = set()
        known = self.known
        for word in set(_WORD.findall(text.lower())):
            voters = known.get(word)
            if voters is None:
                voters = self._voters(word)
            if voters:
                found.update(voters)
        some = bool(found)
        # three shouted words are looked for only where there is one
        found.update(self.lexicon + i for i, (name, p) in enumerate(PATTERNS.items()) if (name != "shouting" or _SHOUTED.search(text)) and p.search(text))
        return sorted(found) if some else [*sorted(found), self.lexicon + len(PATTERNS)]

    def score(self, text: str | None) -> float:
        z = self.bias + float(sum(self.weights[i] for i in self.votes(text or "")))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior probabilities of label 1 under the generative model, whose true labels are hidden.

    ``votes`` has a column for each voter (1: votes, 0: abstains), the last one voting clean, the others toxic; ``given``
    has the given labels, a voter of bounded accuracy.
    """
    votes = votes.astype(np.float64)
    prior = np.clip(given.mean(), 1e-4, 1 - 1e-4)  # the balance of the classes is taken as given
    # a voter that votes on many texts says little: it starts with less
    start = START * np.clip(np.log(prior / np.maximum(votes.mean(axis=0), 1e-9)), 0, 1)
    start[-1] = -START
    z = np.log(prior / (1 - prior)) + votes @ start
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # smoothing towards the rate over all texts: a voter that never voted in a class has not shown it never will
        rate = (votes.sum(axis=0) + 0.5) / (len(votes) + 1)
        hit1 = (p @ votes + 2 * rate) / (p.sum() + 2)
        hit0 = ((1 - p) @ votes + 2 * rate) / ((1 - p).sum() + 2)
        right1 = min(ANCHOR, (p @ given + 2) / (p.sum() + 4))
        right0 = min(ANCHOR, ((1 - p) @ (1 - given) + 2) / ((1 - p).sum() + 4))
        # correlations inside each class; those that repeat each other share one voice
        shared = np.ones(votes.shape[1])
        for w in (p, 1 - p):
            centred = (votes - (w @ votes) / max(w.sum(), 1e-9)) * np.sqrt(w)[:, None]
            cov = centred.T @ centred
            dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            shared = np.maximum(shared, (np.maximum(cov / dev / dev[:, None], 0) ** 2).sum(axis=0))
        z = np.log(prior / (1 - prior)) + votes @ (np.log(hit1 / hit0) / shared)
        z += np.where(given == 1, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def linear_classifier(votes: np.ndarray, target: np.ndarray, penalty: float = 0.3, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton's method with a ridge."""
    x = np.hstack([votes.astype(np.float64), np.ones((len(votes), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _counted(sample: DataFrame, toxic: int, wanted: set[str] | None) -> DataFrame:
    """feature, n: the texts of one class that hold each feature, combined in each task before they are shuffled."""
    shared = sample.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = Counter(), shared.value

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["feature", "n"])

        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                found = features(text or "")
                held.update(found if some is None else found & some)
            if len(held) > 200_000:
                yield out()
                held.clear()
        yield out()

    return sample.filter(F.col("toxic") == toxic).select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def chosen_voters(positive: dict[str, int], negative: dict[str, int], toxic_texts: int, clean_texts: int) -> list[str]:
    """The features whose share of toxic texts is too high for chance, at a false discovery rate of ``FALSE_RATE``, those
    that tell most first."""
    base, tested = toxic_texts / max(1, toxic_texts + clean_texts), []
    for feature, n in positive.items():
        other = negative.get(feature, 0)
        lift = (n / (toxic_texts + 1)) / ((other + 1) / (clean_texts + 1))
        if lift >= LEAST_LIFT:
            tested.append((_tail(n, n + other, base), -n * math.log(lift), feature))
    tested.sort()
    passed = max((i for i, (chance, _, _) in enumerate(tested, 1) if chance <= FALSE_RATE * i / len(positive)), default=0)
    return [f for _, f in sorted(t[1:] for t in tested[:passed])]


def voter_numbers(terms: list[str]) -> list[int]:
    """The voter of each term, in order of strength: its own, or one of the lexica, which hold the rest in equal parts."""
    rest = max(0, len(terms) - ALONE)
    return [i if i < ALONE else ALONE + (i - ALONE) * min(LEXICA, rest) // rest for i in range(len(terms))]


def _tail(hits: int, tries: int, rate: float) -> float:
    """The chance of at least ``hits`` in ``tries`` at ``rate``."""
    logs = [math.lgamma(tries + 1) - math.lgamma(k + 1) - math.lgamma(tries - k + 1) + k * math.log(rate) + (tries - k) * math.log1p(-rate) for k in range(hits, tries + 1)] if 0 < rate < 1 else [0.0]
    return min(1.0, sum(math.exp(x) for x in logs))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from the training rows among ``labels`` (doc_id, toxic) and their texts in ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # ``fit_rows`` pairs of numbers: a fixed bound
    chosen = spark.createDataFrame(chosen.toArrow()) if chosen.count() else spark.createDataFrame([], "doc_id long, toxic int")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = stage(sample, "labelled")
    totals = dict(sample.groupBy("toxic").count().collect())
    toxic_texts, clean_texts = totals.get(1, 0), totals.get(0, 0)
    # the terms of at most ``fit_rows`` texts
    first = _counted(sample, 1, None).filter(F.col("n") >= LEAST_TOXIC)
    positive = {r["feature"]: r["n"] for r in first.collect()}
    negative = {r["feature"]: r["n"] for r in _counted(sample, 0, set(positive)).collect()} if positive else {}
    terms = chosen_voters(positive, negative, toxic_texts, clean_texts)
    number = dict(zip(terms, voter_numbers(terms)))
    lexicon = max(number.values(), default=-1) + 1
    words = {f: n for f, n in number.items() if not f.endswith("*")}
    starts = {f[:-1]: n for f, n in number.items() if f.endswith("*")}
    blank = Model(words, starts, lexicon, np.zeros(0), 0.0)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [blank.votes(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "votes"])

    table = sample.select("toxic", "text").mapInArrow(vote, "toxic int, votes array<int>").toArrow()
    width = lexicon + len(PATTERNS) + 1
    if not table.num_rows:
        return Model(words, starts, lexicon, np.zeros(width), -2.0)
    matrix = np.zeros((table.num_rows, width), np.float32)
    for i, row in enumerate(table.column("votes").to_pylist()):
        matrix[i, row] = 1
    label = table.column("toxic").to_numpy().astype(np.float64)
    weights, bias = linear_classifier(matrix, label_model(matrix, label))
    return Model(words, starts, lexicon, weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches, "text"):
            scores = [held.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id").cast("long")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches, at):
            yield batch.filter(pa.array([held.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
