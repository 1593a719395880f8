import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import token_counts

FILE = token_counts.read_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_str(FILE.decode())


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(FILE)


def wanted(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


PARTS = ["the", "ing", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "日本", "кир", "😀", "'s", "'ll", "12", "²", "_", "...", "\xa0", "\x1c", "　", "x", "Q", "<|endoftext|>", "<|endof", "́", "ａ", "Ɤ", "՘", "\U0003d000", "\x00"]


def test_as_the_library_counts(counter):
    rng = random.Random(13)
    for _ in range(6000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 30)))
        assert counter.count(text) == wanted(text), text


def test_characters_of_all_planes(counter):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(chr(c) for c in (rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0x20000), rng.randrange(0x110000)]) for _ in range(20)) if not 0xD800 <= c < 0xE000)
        assert counter.count(text) == wanted(text), text


RANKED = {tuple(m): rank for rank, m in enumerate(json.loads(FILE)["model"]["merges"])}


def plain(piece):
    """Merging by scanning: the lowest rank, leftmost, until none is left."""
    held = [token_counts.byte_symbols()[b] for b in piece]
    while found := min(((RANKED[p], at) for at, p in enumerate(zip(held, held[1:], strict=False)) if p in RANKED), default=None):
        held[found[1] : found[1] + 2] = ["".join(held[found[1] : found[1] + 2])]
    return len(held)


def test_merges_against_scanning(counter):
    rng = random.Random(3)
    for _ in range(3000):
        piece = bytes(rng.choice(b"aaabertionsh \xc3\xa9\xff") for _ in range(rng.randrange(0, 25)))
        assert counter.merges.count(piece) == plain(piece)


def test_long_pieces_and_texts(counter, monkeypatch):
    rng = random.Random(2)
    for text in ("a" * 30_000, " " * 20_000 + "x", "".join(rng.choice(["tion", "er", "a", "zq"]) for _ in range(20_000)), "=-" * 5000):
        assert counter.count(text) == wanted(text)
    text = "".join(rng.choice(PARTS[:-3]) + " " * rng.randrange(2) for _ in range(30_000))
    monkeypatch.setattr(token_counts, "_SOME", 100)
    assert counter.count(text) == wanted(text)


def test_bounded_memory_does_not_change_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    few, text = token_counts.Counter(FILE), "one two three four five one six seven one " * 50
    assert few.count(text) == wanted(text) and all(len(kept) <= 3 for kept in (few.runs, few.runs.old, few.pieces))


def test_other_tokenizers_are_refused():
    for name in ("word_bpe_49k.json",):
        with pytest.raises(ValueError):
            token_counts.Counter(token_counts.read_file(public_tokenizers.path(name)))
    told = json.loads(FILE)
    told["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        token_counts.Counter(json.dumps(told).encode())


def test_rows(spark):
    rows = [(1, "Hello <|endoftext|> world", 1, "x"), (1, "Hello <|endoftext|> world", 1, "x"), (None, None, 2, "y"), (3, "", 3, None), (None, "é 😀", 4, "z"), (5, "word " * 1025, 5, "z")]
    # columns whose names clash with those of the result
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens long, over_limit string")
    got = token_counts.counted(docs, FILE).collect()
    want = [(d, len((t or "").encode()), wanted(t or ""), wanted(t or "") > 1024) for d, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.counted(docs.limit(0), FILE).count() == 0
    assert [r.over_limit for r in token_counts.counted(docs.filter("doc_id = 5"), FILE, limit=2000).collect()] == [False]


def test_whole_table(spark):
    from sparkloom.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = queries.op13_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, len((r.text or "").encode()), n := wanted(r.text or ""), n > 1024) for r in docs)
