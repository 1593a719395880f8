import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sparkloom.llm import importance

SCHEMA = "doc_id long, text string, row string, weight string"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text):
    w = words_of(text)
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(docs, target):
    corpus, wanted = Counter(), Counter()
    for _, text in docs:
        corpus.update(features(text))
    for text in target:
        wanted.update(features(text))
    S, T = corpus.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (S + 10000) / ((corpus[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        own = features(text)
        weight = sum(n * gain[b] for b, n in own.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    placed = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = 5 * len(placed) // 100
    return [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(placed)] + [(*r[:4], None) for r in rows if r[4] < 20]


def made(spark, docs):
    return spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)


def got(spark, docs, target):
    df = importance.resampled(made(spark, docs), spark.createDataFrame([(t, 1) for t in target], "text string, n_features int"))
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=str)


def some_docs(rng, n):
    parts = ["the", "Cat", "sat", "é", "ÉTÉ", "x1", "日本", "a\x00b", "don't", "\x1c", "_", "--", "Straße", "w\x7fw"]
    return [(i, "".join(rng.choice(parts) + rng.choice([" ", "\n", "", ". "]) for _ in range(rng.choice([0, 1, 2, 3, 15, 40, 90])))) for i in rng.sample(range(10_000), n)]


def test_against_plain_code(spark):
    rng = random.Random(11)
    docs = some_docs(rng, 400) + [(None, None), (7, None), (8, ""), (None, "word " * 30), (None, "word " * 30)]
    docs += [(20_000, "one two three four " * 6)] * 60
    target = [t for _, t in some_docs(rng, 20)] + [None, "", "one two three"]
    assert got(spark, docs, target) == sorted(plain(docs, target), key=str)
    assert sum(r[4] is not None for r in plain(docs, target)) > 5


def test_empty_tables(spark):
    assert got(spark, [], ["a b"]) == []
    docs = [(i, "a b c " * 10) for i in range(40)]
    assert got(spark, docs, []) == sorted(plain(docs, []), key=str)
    assert got(spark, [(1, None), (2, "!")], ["a"]) == sorted(plain([(1, None), (2, "!")], ["a"]), key=str)


@pytest.mark.parametrize("most", [1, 7, 50])
def test_pieces_of_long_texts(spark, most):
    rng = random.Random(most)
    text = "".join(rng.choice(["the ", "Cat", "-- ", "é", "\n", "longword ", "."]) for _ in range(400))
    cut = list(importance.pieces(text, most))
    assert "".join(p for p, _ in cut) == text and all(len(words_of(b)) <= 2 for _, b in cut)
    whole, parted = (importance.bucket_counts(made(spark, [(1, text), (2, "x y"), (3, text * 3)]), taken=t).collect() for t in (1 << 20, most))
    for rows in (whole, parted):
        for i, own in ((1, text), (2, "x y"), (3, text * 3)):
            mine = [r for r in rows if r.doc_id == i]
            assert sum((Counter({c.bucket: c.n for c in r.counts or []}) for r in mine), Counter()) == features(own)
            assert sum(r.n_words for r in mine) == len(words_of(own)) and len({r.row for r in mine}) == 1
    assert len(parted) > len(whole) == 3


def test_a_word_without_end(spark):
    text = "z" * 3_000_000 + " a " + "b" * 2_000_000
    assert got(spark, [(1, text), (2, "a")], ["a"]) == sorted(plain([(1, text), (2, "a")], ["a"]), key=str)


def test_whole_table(spark):
    from sparkloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op11_importance(spark, sf).collect()), key=str) == sorted(plain(docs, target), key=str)
