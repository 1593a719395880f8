"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage of every document with block-max
WAND, and exact verification of question and answer overlap.

Items are indexed in units of up to ``UNIT`` words; scores are divided by a unit's score for its own words, so 1 is a full
match. Documents are read as overlapping passages of ``PASSAGE`` words, a step of ``STEP`` apart, which hold at least five
sixths of any unit. A retrieved item is verified on the words around the passage: the shares of the item's question's
and answer's word trigrams found there. The answer is the item's last sentence, or its last quarter if it has one sentence.

Every passage queries the index. What can be told by maxima is told for many passages at a time: the terms' largest contributions
have to reach the threshold; a unit that reaches it holds one of its leading terms, its weightiest ones, without which the others
stay below; and the terms' maxima over a window of ``BLOCK`` units have to reach it for some window of such a unit. Passages
that are left run block-max WAND, over the same windows, which returns every unit above the threshold. The trigrams decide only
whether what was retrieved is in the document.

The index is kept by each worker. It is built from about ``INDEX_ITEMS`` items and ``INDEX_BYTES`` bytes at a time; a larger
benchmark is searched in several passes. Document frequencies and the mean length are those of all items in every pass, and all
that decides about an item is its own, so the result is the same for any number of passes; they run one after the other.

Defined cases: null or wordless texts match nothing; null item texts are left out; items repeated under several ids are each
reported; an item in several places of a document is reported once, with its best passage; repeated document rows are each
reported; an item of fewer than three words has itself as its only n-gram; words are runs of letters and digits, lower-cased in
ASCII; very long texts are read whole, in passages; empty tables give no leaks; other columns are ignored by ``leaks`` and returned
as they are, whatever their names, by ``cleaned``.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, kept_by, slices, stage, utf8
from sparkloom.llm.shingles import document_words, lowered, mix, word_hashes

K1, B = 1.2, 0.75
UNIT, PASSAGE, STEP = 48, 64, 32
THRESHOLD = 0.5
QUESTION, ANSWER, TOGETHER = 0.5, 0.5, 0.7
NGRAM = 3
#: Units in a window that maxima are kept for, and passages that are looked at together.
BLOCK = 8
TOGETHER_PASSAGES = 8192
INDEX_ITEMS, INDEX_BYTES = 20_000, 8 << 20
#: Bytes that end a word: all of ASCII but letters and digits.
_BREAK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_SENTENCE = re.compile(r"[.!?。！？](?=\s|$)\s*")


def words_of(text: str) -> np.ndarray:
    return word_hashes(lowered(text.encode()), _BREAK)[0]


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """An item's words up to its answer, and its answer's."""
    ends = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    cut = next((e for e in reversed(ends) if e < len(text.rstrip()) and len(words_of(text[e:])) >= NGRAM), None)
    if cut is not None and len(words_of(text[:cut])) >= NGRAM:
        return words_of(text[:cut]), words_of(text[cut:])
    words = words_of(text)
    at = len(words) - len(words) // 4
    return words[:at], words[at:]


_SPREAD = np.random.default_rng(5).integers(1, 1 << 63, NGRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each run of ``NGRAM`` words; fewer words make one run."""
    if len(words) < NGRAM:
        return mix((words * _SPREAD[: len(words)]).sum(keepdims=True, dtype=np.uint64)) if len(words) else words
    n = len(words) - NGRAM + 1
    return mix(sum(words[j : n + j] * _SPREAD[j] for j in range(NGRAM)))


def grams(words: np.ndarray) -> set[int]:
    return set(gram_hashes(words).tolist())


def units_of(text: str) -> list[np.ndarray]:
    """An item's words in its units."""
    words = np.concatenate(question_and_answer(text))
    return [part for part in np.array_split(words, max(1, -(-len(words) // UNIT))) if len(part)]


@dataclass(frozen=True)
class Statistics:
    """Over the units of all items: how many there are, their words, and in how many units each term stands."""

    units: int
    words: int
    frequency: dict[int, int]


def statistics_of(texts: list[str]) -> Statistics:
    units = [u for text in texts for u in units_of(text)]
    return Statistics(len(units), sum(map(len, units)), Counter(w for u in units for w in set(u.tolist())))


class Index:
    """Postings with block maxima over the units of some items, weighted by the statistics of all."""

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None) -> None:
        self.ids, self.units, self.questions, self.answers = [], [], [], []
        unit_words: list[np.ndarray] = []
        for n, (item_id, text) in enumerate(items):
            question, answer = question_and_answer(text)
            self.ids.append(item_id)
            self.questions.append(grams(question))
            self.answers.append(grams(answer))
            for part in units_of(text):
                self.units.append(n)
                unit_words.append(part)
        #: words before and after a passage that an item found there may reach to
        self.reach = [len(q) + len(a) + 2 * NGRAM for q, a in zip(self.questions, self.answers)]
        whole = whole or statistics_of([text for _, text in items])
        frequency, total, mean = whole.frequency, whole.units, whole.words / max(1, whole.units)
        self.terms = np.array(sorted(set().union(*(u.tolist() for u in unit_words))), np.uint64)
        number = {w: i for i, w in enumerate(self.terms.tolist())}
        lists: list[list[tuple[int, float]]] = [[] for _ in number]
        leading: list[list[int]] = [[] for _ in number]
        for unit, words in enumerate(unit_words):
            weights = {}
            for w, tf in Counter(words.tolist()).items():
                idf = math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            own = sum(weights.values())
            left = 1.0
            for w, x in sorted(weights.items(), key=lambda wx: -wx[1]):
                lists[number[w]].append((unit, x / own))
                if left >= THRESHOLD - 1e-6:
                    leading[number[w]].append(unit // BLOCK)
                left -= x / own
        self.posted = [[u for u, _ in row] for row in lists]
        self.weights = [[x for _, x in row] for row in lists]
        self.windows, self.best = [], []
        for row in lists:
            held: dict[int, float] = {}
            for u, x in row:
                held[u // BLOCK] = max(held.get(u // BLOCK, 0.0), x)
            self.windows.append(list(held))
            self.best.append(list(held.values()))
        # the same for many look-ups at once: a term's windows in turn, and the windows of units that it leads
        self.in_all = max(1, -(-len(self.units) // BLOCK))
        self.window_keys = np.array([t * self.in_all + w for t, row in enumerate(self.windows) for w in row], np.int64)
        self.window_best = np.array([x for row in self.best for x in row])
        leading = [sorted(set(row)) for row in leading]
        self.lead_at = np.concatenate([[0], np.cumsum([len(row) for row in leading], dtype=np.int64)])
        self.lead_windows = np.array([w for row in leading for w in row], np.int64)
        self.most = np.array([*(max(x) for x in self.weights), 0.0])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The terms' numbers of words; len(terms) for words that are not in the index."""
        found = np.full(len(words), len(self.terms))
        if len(self.terms):
            maybe = np.flatnonzero(self.sieve[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.searchsorted(self.terms, words[maybe])
            at[at == len(self.terms)] = 0
            same = self.terms[at] == words[maybe]
            found[maybe[same]] = at[same]
        return found

    def retrieve(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All units whose score for the distinct ``terms`` reaches ``threshold``, by block-max WAND."""
        floor = threshold - 1e-9
        cursors = [[self.posted[t][0], t, 0] for t in terms if self.posted[t]]
        most, out = self.most, []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursors):
                bound += most[t]
                if bound >= floor:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            # the maxima of the window that the pivot unit is in bound its score more closely
            close, window = 0.0, unit // BLOCK
            for _, t, _ in cursors[: pivot + 1]:
                held = self.windows[t]
                at = bisect_left(held, window)
                if at < len(held) and held[at] == window:
                    close += self.best[t][at]
            if close < floor:
                goal = (window + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                self._advance(cursors, pivot + 1, max(goal, unit + 1))
            elif cursors[0][0] == unit:
                score = sum(self.weights[t][p] for u, t, p in cursors[: pivot + 1] if u == unit)
                if score >= floor:
                    out.append((unit, score))
                self._advance(cursors, pivot + 1, unit + 1)
            else:
                self._advance(cursors, pivot + 1, unit)
        return out

    def _advance(self, cursors: list[list[int]], upto: int, goal: int) -> None:
        """Moves the first ``upto`` cursors to their first unit not before ``goal``; those at their end go."""
        ended = False
        for c in cursors[:upto]:
            if c[0] < goal:
                posted = self.posted[c[1]]
                at = bisect_left(posted, goal, c[2])
                if at == len(posted):
                    c[0], ended = -1, True
                else:
                    c[0], c[2] = posted[at], at
        if ended:
            cursors[:] = [c for c in cursors if c[0] >= 0]

    def candidates(self, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(passage, its distinct terms) for those passages, given by where they start and end, that maxima don't rule out."""
        floor, known = THRESHOLD - 1e-6, np.flatnonzero(numbers < len(self.terms))
        first, last = np.searchsorted(known, starts), np.searchsorted(known, ends)
        passage, place = _expanded(first, last - first)
        pairs = np.unique(passage * len(self.terms) + numbers[known[place]])
        passage, term = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
        keep = np.bincount(passage, self.most[term], len(starts))[passage] >= floor
        passage, term = passage[keep], term[keep]
        # windows of units that a term leads, of each passage
        row, at = _expanded(self.lead_at[term], self.lead_at[term + 1] - self.lead_at[term])
        met = np.unique(passage[row] * self.in_all + self.lead_windows[at])
        met_passage, met_window = met // self.in_all, met % self.in_all
        begin, end = np.searchsorted(passage, met_passage), np.searchsorted(passage, met_passage, "right")
        which, at = _expanded(begin, end - begin)
        keys = term[at] * self.in_all + met_window[which]
        held = np.minimum(np.searchsorted(self.window_keys, keys), max(0, len(self.window_keys) - 1))
        best = np.where(self.window_keys[held] == keys, self.window_best[held], 0.0) if len(keys) else np.empty(0)
        for p in np.unique(met_passage[np.bincount(which, best, len(met)) >= floor]).tolist():
            a, b = np.searchsorted(passage, [p, p + 1])
            yield p, term[a:b].tolist()

    def search(self, words: np.ndarray, bounds: np.ndarray) -> list[dict[int, tuple[float, float, float, int]]]:
        """For each document, whose words lie between its bounds, item: (score, question share, answer share, passage's first
        word)."""
        out: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in range(len(bounds) - 1)]
        if not len(self.terms):
            return out
        sizes = np.diff(bounds)
        counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - PASSAGE) // STEP) + 1), 0)
        owner, nth = _expanded(np.zeros(len(counts), np.int64), counts)
        starts = bounds[owner] + nth * STEP
        ends = np.minimum(starts + PASSAGE, bounds[owner + 1])
        numbers = self.numbers(words)
        for i in range(0, len(starts), TOGETHER_PASSAGES):
            some = slice(i, i + TOGETHER_PASSAGES)
            for p, terms in self.candidates(numbers, starts[some], ends[some]):
                doc = int(owner[i + p])
                begin, end, s, e = int(bounds[doc]), int(bounds[doc + 1]), int(starts[i + p]), int(ends[i + p])
                for unit, score in self.retrieve(terms):
                    item, best = self.units[unit], out[doc]
                    if item in best and best[item][0] >= score:
                        continue
                    if shares := self.verified(item, words[max(begin, s - self.reach[item]) : min(end, e + self.reach[item])]):
                        best[item] = (score, *shares, s - begin)
        return out

    def verified(self, item: int, around: np.ndarray) -> tuple[float, float] | None:
        """The shares of an item's question's and answer's trigrams among the words around a passage, if they suffice."""
        question, answer, here = self.questions[item], self.answers[item], grams(around)
        q, a = len(question & here), len(answer & here)
        share_q, share_a = q / max(1, len(question)), a / max(1, len(answer))
        both = (q + a) / max(1, len(question) + len(answer))
        return (share_q, share_a) if share_q >= QUESTION and (share_a >= ANSWER or not answer) or both >= TOGETHER else None


def _expanded(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, ``counts`` numbers from ``first`` on: (row, number) of all of them."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]


_FOUND = "doc_id long, item_id long, score double, question_share double, answer_share double, first_word long"


def _passes(benchmark: DataFrame, index_items: int) -> tuple[int, Iterator[tuple[list[tuple[int, str]], Statistics]]]:
    """How many passes there are, and one after the other the items of each, a bounded number of them, with the statistics
    of all items for their terms."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    count, most = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-count // index_items), -(-most // INDEX_BYTES))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the term 0 is no word's: it counts the units in ``n`` and their words in ``words``
        for batch in slices(batches, "text"):
            held = statistics_of(batch.column("text").to_pylist())
            found = np.array([0, *held.frequency], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array([held.units, *held.frequency.values()], pa.int64()), pa.array([held.words] + [0] * len(held.frequency), pa.int64())],
                names=["term", "n", "words"],
            )

    bounded_batches(benchmark.sparkSession)
    counted = items.mapInArrow(terms, "term long, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    counted = stage(counted, "terms")
    units, words = counted.filter("term = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def each() -> Iterator[tuple[list[tuple[int, str]], Statistics]]:
        for i in range(passes):
            part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
            # bounded by INDEX_BYTES: the terms of the items of one pass
            own = part.mapInArrow(terms, "term long, n long, words long").select("term").distinct()
            table = counted.filter("term <> 0").join(own, "term", "left_semi").select("term", "n").toArrow()
            frequency = dict(zip(table.column("term").to_numpy().view(np.uint64).tolist(), table.column("n").to_pylist()))
            yield [tuple(r) for r in part.orderBy("item_id", "text").collect()], Statistics(units, words, frequency)

    return passes, each()


#: The index that a worker used last, by the name of its pass.
_indexes: dict[str, Index] = {}


def _index_for(name: str, items: list[tuple[int, str]], whole: Statistics) -> Index:
    kept_by["decontaminate"] = _indexes.clear
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(items, whole)
    return _indexes[name]


def leaks(docs: DataFrame, benchmark: DataFrame, index_items: int = INDEX_ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_share, answer_share, first_word for each item found in each row of ``docs``."""
    passes, each = _passes(benchmark, index_items)
    found = None
    for items, whole in each:
        one = _searched(docs, items, whole)
        one = one if passes == 1 else stage(one, "leaks")
        found = one if found is None else found.unionByName(one)
    return found


def cleaned(docs: DataFrame, benchmark: DataFrame, index_items: int = INDEX_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of ``benchmark``: each row is judged where it is read. A benchmark of
    several passes has what each of them leaves written between them."""
    passes, each = _passes(benchmark, index_items)
    for i, (items, whole) in enumerate(each, 1):
        docs = _filtered(docs, items, whole)
        docs = docs if i == passes else stage(docs, "cleaned")
    return docs


def _found_in(batches: Iterator[pa.RecordBatch], at: int | str, index: Index) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[int, dict]]]]:
    """Each slice of the batches with the items found in its rows: (row, {item: ...})."""
    for batch in slices(batches, at, owner="decontaminate"):

        def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple[int, dict]]:
            for first, last, words, bounds in document_words(utf8(batch.column(at)), _BREAK):
                yield from enumerate(index.search(words, np.asarray(bounds, np.int64)[: last - first + 1]), first)

        yield batch, rows()


def _searched(docs: DataFrame, items: list[tuple[int, str]], whole: Statistics) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast((items, whole)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_for(name, *shared.value)
        for batch, found in _found_in(batches, "text", index):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[i], index.ids[item], *told) for i, items_ in found for item, told in sorted(items_.items())]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                names = ["doc_id", "item_id", "score", "question_share", "answer_share", "first_word"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)


def _filtered(docs: DataFrame, items: list[tuple[int, str]], whole: Statistics) -> DataFrame:
    shared, name, at = docs.sparkSession.sparkContext.broadcast((items, whole)), uuid.uuid4().hex, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _found_in(batches, at, _index_for(name, *shared.value)):
            yield batch.filter(pa.array([not items_ for _, items_ in found], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
