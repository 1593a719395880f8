import codecs
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from sparkloom.llm import bpe

RAW = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
RANKS = bpe.parse_ranks(RAW)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, public_tokenizers.PATTERN)


def odd_text(rng, n):
    parts = ["the", "ing", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "日本", "кир", "😀", "'s", "12", "²", "_", "...", " ", "\x1c", " ", "x", "Q", "<|endoftext|>", "́", "ａ"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_as_the_reference_does(codec):
    rng = random.Random(9)
    for _ in range(3000):
        text = odd_text(rng, rng.randrange(0, 30))
        ids = codec.encode(text)
        assert ids == REFERENCE.encode_ordinary(text), text
        assert codec.decode_bytes(ids) == text.encode() and all("".join(codec.decode_stream(ids, run)) == text for run in (1, 7, 4096))


def test_any_bytes_and_long_pieces(codec):
    rng, machine = random.Random(2), codec.pieces.machine
    for _ in range(3000):
        piece = rng.randbytes(rng.randrange(1, 14))
        assert machine.encode(piece) == REFERENCE._encode_single_piece(piece)
    for piece in (b"a" * 5000, "".join(rng.choice(["tion", "er", "a", "zq"]) for _ in range(4000)).encode(), b" " * 3000):
        assert machine.encode(piece) == REFERENCE._encode_single_piece(piece)
        assert all(len(part) < bpe.LONG * 2 for part in machine.stream(piece))


def test_memory_bounds_do_not_change_ids():
    machine = bpe.Transducer(RANKS, kept_steps=50)
    for text in ("internationalization", "Donaudampfschifffahrt", "x" * 3000):
        assert machine.encode(text.encode()) == REFERENCE._encode_single_piece(text.encode())


def test_incremental_utf8():
    rng = random.Random(3)
    for _ in range(2000):
        data = b"".join(rng.choice(["é".encode(), "日".encode(), "😀".encode(), b"a", b"\xff", b"\xe2\x82", b"\xed\xa0\x80", b"\xf4\x90", b"\xc0"]) for _ in range(rng.randrange(8)))
        machine, out, at = bpe.Utf8Machine(), [], 0
        while at < len(data):
            n = rng.randrange(1, 4)
            out.append(machine.feed(data[at : at + n]))
            assert len(machine.waiting) <= 3
            at += n
        assert "".join(out) + machine.finish() == data.decode("utf-8", "replace")
        assert codecs.decode(data, "utf-8", "replace") == data.decode("utf-8", "replace")


def test_rows(spark):
    text = "Ein Satz, two  words\n" * 3000
    rows = [(1, text, "a"), (1, text, "a"), (2, None, "b"), (3, "", "c"), (None, "x", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.tokenized(docs, RAW, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == 5
    for r in got:
        source = {1: text, None: "x"}.get(r.doc_id, "")
        ids = REFERENCE.encode_ordinary(source)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(source.encode()).hexdigest()
    assert bpe.tokenized(docs.limit(0), RAW, public_tokenizers.PATTERN).count() == 0
