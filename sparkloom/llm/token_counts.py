"""Token counts by heap-and-linked-list byte-pair merging: no token identifiers are made.

The symbols of a piece are a doubly linked list, and its adjacent pairs that a merge exists for wait in a heap by rank, then
place. The lowest is popped again and again: a pair whose symbols have changed since is passed over, any other is merged, its
right symbol leaves the list, and the two pairs that the new symbol forms are pushed. A piece of n bytes counts n tokens
less one for each merge, in O(n log n) whatever its length.

Counting is one pass without a shuffle. A text is cut at the added tokens of the tokenizer's file, which count one each, then at
spaces that stand alone, since no piece goes on across one; a worker keeps the counts of short runs between them.

Defined cases: null or empty text has no bytes and no tokens; the string of an added token in a text is that token, as the library
has it; text of any length is counted whole; repeated rows each give a row; a null doc_id stays null; an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparkloom.llm.bpe import LATIN, SPACES, WORDWISE
from sparkloom.llm.common import bounded_batches, kept_by, slices

#: Tokens beyond which a document is over the limit.
LIMIT = 1024
#: Texts of at most so many characters whose counts a worker keeps, and how many in a generation.
KEPT_LENGTH, KEPT = 64, 200_000
#: Characters that the runs of a text are taken from at a time.
_SOME = 1 << 20
#: Bits of a symbol in a pair, and of a place in an entry of the heap.
_SYMBOL, _PLACE = 20, 40
_SYMBOLS, _PLACES = (1 << _SYMBOL) - 1, (1 << _PLACE) - 1
#: Fixed value: the pattern by which byte-level tokenizers cut a text, white space being the Unicode property.
PIECES = WORDWISE.replace(r"[^\s", "[^" + SPACES).replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others in
    turn from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Merges:
    """The merges of a byte-level BPE file, and the count of a piece under them. Symbols are vocabulary numbers; a pair is one
    number with its left symbol in the high bits, and so is what a pair becomes, with the rank above the new symbol."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        if len(pairs) >> _SYMBOL or max(vocabulary.values()) >> _SYMBOL:
            raise ValueError("more symbols than a pair has room for")
        self.start = [vocabulary[c] for c in byte_symbols()]
        self.ranked = {vocabulary[a] << _SYMBOL | vocabulary[b]: rank << _SYMBOL | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}

    def count(self, piece: bytes) -> int:
        symbol = list(map(self.start.__getitem__, piece))
        n, ranked = len(symbol), self.ranked.get
        # entries of the heap: rank, then place of the left symbol
        heap, at, left = [], -1, -1
        for right in symbol:
            if at >= 0 and (found := ranked(left << _SYMBOL | right)) is not None:
                heap.append(found >> _SYMBOL << _PLACE | at)
            at, left = at + 1, right
        if not heap:
            return n
        heapify(heap)
        after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            entry = heappop(heap)
            at = entry & _PLACES
            right = after[at]
            # a place whose symbol has left the list holds -1, and one whose pair has changed since has another rank
            if symbol[at] < 0 or right == n or (found := ranked(symbol[at] << _SYMBOL | symbol[right])) is None or found >> _SYMBOL != entry >> _PLACE:
                continue
            new = symbol[at] = found & _SYMBOLS
            symbol[right] = -1
            merged += 1
            beyond = after[at] = after[right]
            if beyond < n:
                before[beyond] = at
                if (found := ranked(new << _SYMBOL | symbol[beyond])) is not None:
                    heappush(heap, found >> _SYMBOL << _PLACE | at)
            back = before[at]
            if back >= 0 and (found := ranked(symbol[back] << _SYMBOL | new)) is not None:
                heappush(heap, found >> _SYMBOL << _PLACE | back)
        return n - merged


class Kept(dict):
    """Counts by text, worked out when first asked for, of short texts in two generations: a full one becomes the older one."""

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self.count, self.old = count, {}

    def __missing__(self, text: str) -> int:
        count = self.old.get(text)
        if count is None:
            count = self.count(text)
        if len(text) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[text] = count
        return count


class Counter:
    """Token counts of texts, as the library has them for the tokenizer of ``file``."""

    def __init__(self, file: bytes) -> None:
        import regex

        told = json.loads(file)
        odd = [t["content"] for t in told["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        cut = told["pre_tokenizer"] or {}
        if told["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or told["normalizer"] or odd:
            raise ValueError("not a byte-level BPE tokenizer without normalizer, prefix space and special matching of added tokens")
        self.merges = Merges(told["model"]["vocab"], told["model"]["merges"])
        added = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.split = regex.compile(PIECES)
        self.lone = re.compile(f"(?<![{SPACES}]) (?![{SPACES}])")
        self.letter, self.number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
        self.own_cut = None
        self.alike: set[str] = set()  # characters that the pattern and the library class alike
        self.apart: set[str] = set()  # and those that they do not
        self.pieces = Kept(lambda piece: self.merges.count(piece.encode()))
        #: runs between lone spaces, keyed without the space before them
        self.runs = Kept(self._run)

    def _run(self, run: str) -> int:
        # a run of settled letters is one piece
        return self.merges.count(b" " + run.encode()) if run.isalpha() and max(run) < LATIN else self.cut(" " + run)

    def cut(self, text: str) -> int:
        """The count of a text by its pieces."""
        if len(text) <= _SOME:
            return sum(map(self.pieces.__getitem__, self.split.findall(text)))
        return sum(self.pieces[m.group()] for m in self.split.finditer(text))

    def _classed(self, text: str) -> bool:
        """Whether the pattern takes all characters of ``text`` for what the library takes them for: their versions of Unicode
        may differ in characters of late assignment. Each character is asked about once a worker."""
        for c in set(text) - self.alike:
            if c in self.apart:
                return False
            if c >= LATIN:
                if self.own_cut is None:
                    from tokenizers.pre_tokenizers import ByteLevel

                    self.own_cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
                here = (self.letter.match(c) is not None, self.number.match(c) is not None)
                if here != tuple(len(self.own_cut(mate + c)) == 1 for mate in "b1"):
                    self.apart.add(c)
                    return False
            self.alike.add(c)
        return True

    def _between(self, text: str) -> int:
        """The count of a text without added tokens."""
        if not text.isascii() and not self._classed(text):
            return sum(self.merges.count(text[a:b].encode()) for _, (a, b) in self.own_cut(text))
        # stretches of whole runs, so that a very long text is not cut up at once
        total, at, first = 0, 0, self.cut
        while at <= len(text):
            found = self.lone.search(text, at + _SOME) if len(text) - at > _SOME else None
            head, *runs = self.lone.split(text[at : found.start()] if found else text[at:] if at else text)
            total += first(head) + sum(map(self.runs.__getitem__, runs))
            at, first = (found.end() if found else len(text) + 1), self.runs.__getitem__
        return total

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._between(text)
        total, at = 0, 0
        for m in self.added.finditer(text):
            total += self._between(text[at : m.start()]) + 1
            at = m.end()
        return total + self._between(text[at:])


_counters: dict[bytes, Counter] = {}


def counter_for(file: bytes) -> Counter:
    """The worker's counter, kept between tasks."""
    kept_by["token_counts"] = _counters.clear
    key = hashlib.sha1(file).digest()
    if key not in _counters:
        _counters[key] = Counter(file)
    return _counters[key]


def read_file(path: str) -> bytes:
    """The tokenizer's file, read on the driver (its size is fixed by the tokenizer)."""
    with open(path, "rb") as f:
        return f.read()


def counted(docs: DataFrame, file: bytes, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(shared.value)
        for batch in slices(batches, "text", owner="token_counts"):
            text = batch.column("text")
            tokens = pa.array([counter.count(t) if t else 0 for t in text.to_pylist()], pa.int64())
            size = pc.binary_length(text).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, tokens, pc.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
