"""Byte-level BPE encoding by a lazily determinised transducer, and decoding with an incremental UTF-8 machine.

A BPE encoding is valid exactly if each pair of neighbouring tokens is, and the last token of every prefix is unique. The
transducer reads a piece byte by byte; its state is the set of open beginnings, places where a token under way may have
begun, each as a node of the token trie with the token that ends before it. With each byte it gives the token that ends
there in the encoding of the prefix. Those on the way back from every open beginning are certain and are emitted, which
takes a lookahead of less than the longest token. States get numbers, and transitions are computed when they are first met.

Decoding joins the bytes of some thousand tokens at a time and passes them through a machine that holds back, of a character cut
by the end of a run, the bytes that are there, so a text of any length is decoded in bounded memory.

Defined cases: null or empty text has no tokens; text of any length is encoded whole; texts that look like special tokens
are ordinary text; tokens that BPE never builds from their own bytes are emitted only for a piece equal to them; repeated rows each
give a row; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice
from operator import getitem

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import bounded_batches, kept_by, slices

#: Entries that a worker keeps of encoded pieces, pairs and transitions before it starts anew.
KEPT_WORDS, KEPT_PIECES = 120_000, 60_000
KEPT_STEPS = 250_000
KEPT_LENGTH = 64
#: Tokens below a node of the trie up to which an open beginning there is told by those that fit.
FEW = 16
#: Bytes of a piece beyond which its tokens are emitted as they become certain.
LONG = 1024
_FLUSH = 1 << 16
#: Tokens that are decoded at a time.
RUN = 4096
#: The characters with the Unicode property White_Space, the first character beyond those whose letters never
#: changed, and the pattern whose pieces never cross from one word into the next one but by the single space that begins it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = "\u0250"
WORDWISE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class State(dict):
    """A state of the transducer: the next states by byte, worked out when they are first asked for.

    ``open`` has its open beginnings, ``token`` the token that ends here in the encoding of what was read, ``size`` that
    token's bytes."""

    __slots__ = ("machine", "open", "size", "token")

    def __init__(self, machine: Transducer, beginnings: tuple[tuple[int, int], ...], token: int) -> None:
        self.machine, self.open, self.token = machine, beginnings, token
        self.size = machine.length[token] if token >= 0 else 0

    def __missing__(self, byte: int) -> State:
        found = self[byte] = self.machine.step(self, byte)
        return found


class Transducer:
    """Pieces of bytes to token ids.

    An open beginning is a node of the trie with what decides which of the tokens below it may end there: the token before the
    beginning or, where at most ``few`` tokens are below, a bit for each that fits. Beginnings that none fits are dropped,
    and those that differ only in tokens that no longer matter are one."""

    def __init__(self, ranks: dict[bytes, int], kept_steps: int = KEPT_STEPS, few: int = FEW) -> None:
        self.ranks, self.kept_steps = ranks, kept_steps
        self.children: dict[int, int] = {}
        token_at, self.depth, self.below, upto = [-1], [0], [0], [0]
        # in the order of their bytes the tokens below a node stand together, its own one first
        self.in_order = [ranks[token] for token in sorted(ranks)]
        for place, token in enumerate(sorted(ranks)):
            node = 0
            upto[0] = place + 1
            for depth, byte in enumerate(token, 1):
                below = self.children.get(node << 8 | byte)
                if below is None:
                    below = self.children[node << 8 | byte] = len(token_at)
                    token_at.append(-1)
                    self.depth.append(depth)
                    self.below.append(place)
                    upto.append(place)
                node = below
                upto[node] = place + 1
            token_at[node] = ranks[token]
        self.token_at = token_at
        self.count = [e - s for s, e in zip(self.below, upto)]
        self.small = [n <= few for n in self.count]
        self.text = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.masks: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.states: dict[tuple[tuple[int, int], ...], State] = {}
        self.restart()

    def restart(self) -> None:
        """Forgets the states met so far."""
        for state in self.states.values():
            state.clear()
        self.states, self.met = {}, 0
        self.root = self.states[((0, -1),)] = State(self, ((0, -1),), -1)

    def merged(self, piece: bytes) -> list[int]:
        """Tokens by repeatedly joining the leftmost pair of least rank: the definition, for checks."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            least, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose joining made ``token``; (token, token) for a byte, None if BPE does not build it."""
        found = self.halves.get(token, 0)
        if found == 0:
            parts = [self.text[token][i : i + 1] for i in range(len(self.text[token]))]
            rank = self.ranks.get
            while len(parts) > 2:
                joined = [rank(x + y, 1 << 60) for x, y in zip(parts, parts[1:])]
                at = joined.index(min(joined))
                if joined[at] >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ends = [rank(x) for x in parts]
            found = (token, token) if len(ends) == 1 else (ends[0], ends[1]) if len(ends) == 2 and None not in ends else None
            self.halves[token] = found
        return found

    def _fits(self, before: int, token: int) -> bool:
        """Whether BPE leaves ``token`` whole after ``before`` (-1: at the start).

        Joining in order of rank, the parts at the border are the right ends of ``before`` and the left ends of ``token``,
        each until the joining that swallows it. The pair breaks if two of them are joined while both stand there.
        """
        key = before << 24 | token
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) >= self.kept_steps:
                self.pairs.clear()
            fits = self.pairs[key] = self._halves(token) is not None and (before < 0 or self._stands(before, token))
        return fits

    def _stands(self, left: int, right: int) -> bool:
        left_until = right_until = 1 << 60
        rank, text = self.ranks.get, self.text
        while True:
            joined = rank(text[left] + text[right])
            # of equal joinings the leftmost comes first: that inside the left token before this one, this one before the right's
            if joined is not None and joined < left_until and joined <= right_until:
                return False
            below_left, below_right = self._halves(left)[1], self._halves(right)[0]
            if below_left != left and (left > right or below_right == right):
                left, left_until = below_left, left
            elif below_right != right:
                right, right_until = below_right, right
            else:
                return True

    def _mask(self, node: int, before: int) -> int:
        """A bit for each token below ``node``, in order, that may stand after ``before``."""
        key = before << 24 | node
        mask = self.masks.get(key)
        if mask is None:
            if len(self.masks) >= self.kept_steps:
                self.masks.clear()
            at = self.below[node]
            mask = self.masks[key] = sum(self._fits(before, self.in_order[at + i]) << i for i in range(self.count[node]))
        return mask

    def step(self, state: State, byte: int) -> State:
        """The state after one more byte."""
        child, token_at, small, count = self.children.get, self.token_at, self.small, self.count
        ahead, ends = [], -1
        for parent, told in state.open:
            node = child(parent << 8 | byte)
            if node is None:
                continue
            if small[node]:
                if small[parent]:
                    told = told >> (self.below[node] - self.below[parent]) & ((1 << count[node]) - 1)
                else:
                    told = self._mask(node, told)
                if token_at[node] >= 0:
                    if ends < 0 and told & 1:
                        ends = token_at[node]
                    told &= -2
                if told:
                    ahead.append((node, told))
            else:
                if ends < 0 and token_at[node] >= 0 and self._fits(told, token_at[node]):
                    ends = token_at[node]
                ahead.append((node, told))
        if ends < 0:
            raise ValueError("the ranks lack a single byte")
        ahead.append((0, ends))
        self.met += 1
        key = tuple(ahead)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, key, ends)
        return found

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        if len(piece) > LONG:
            return [t for some in self.stream(piece) for t in some]
        if self.met >= self.kept_steps:
            self.restart()
        return _way([*accumulate(piece, getitem, initial=self.root)], len(piece))

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        """The ids of one piece as they become certain; what is held back is shorter than twice the longest token and ``LONG``."""
        if self.met >= self.kept_steps:
            self.restart()
        path, depth = [self.root], self.depth
        for byte in piece:
            if self.met >= self.kept_steps:
                here = path[-1]
                self.restart()
                path[-1] = self.states.setdefault(here.open, State(self, here.open, here.token))
            path.append(path[-1][byte])
            if len(path) > LONG:
                # open beginnings lie as far back as their nodes are deep; walk the farthest back to a place that all share
                open_at = {len(path) - 1 - depth[node] for node, _ in path[-1].open}
                while len(open_at) > 1:
                    last = max(open_at)
                    open_at.remove(last)
                    open_at.add(last - path[last].size)
                (sure,) = open_at
                if sure > 0:
                    yield _way(path, sure)
                    del path[:sure]
        yield _way(path, len(path) - 1)


def _way(path: list[State], place: int) -> list[int]:
    """The tokens on the way back from ``place``, in order."""
    out = []
    while place > 0:
        state = path[place]
        out.append(state.token)
        place -= state.size
    out.reverse()
    return out


class _Kept(dict):
    """What was encoded lately, in two generations: a full one becomes the old one, and what is asked for again moves on."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self.old: dict[str, bytes] = {}

    def encoded(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        packed = self.old.get(key)
        if packed is None:
            packed = self.encoded(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = packed
        return packed


class _Pieces(_Kept):
    """Encoded pieces: little-endian 32-bit ids, packed."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__(KEPT_PIECES)
        self.machine = machine

    def encoded(self, key: str) -> bytes:
        return array("I", self.machine.encode(key.encode())).tobytes()


class _Words(_Kept):
    """Encoded runs between single spaces, keyed without the space before them."""

    def __init__(self, codec: Codec) -> None:
        super().__init__(KEPT_WORDS)
        self.codec = codec

    def encoded(self, key: str) -> bytes:
        # runs of letters are one piece; beyond LATIN, libraries differ in what they know as letters
        if key.isalpha() and max(key) < LATIN:
            return array("I", self.codec.pieces.machine.encode(b" " + key.encode())).tobytes()
        return self.codec.encode_pieces(" " + key)


class Codec:
    """Encoding and decoding of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        # White_Space as the pattern's author has it: Python's also takes U+001C to U+001F
        own = pattern.replace(r"[^\s", "[^" + SPACES).replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
        self.split = regex.compile(own)
        # runs between single spaces are split alone as they are in the text, unless two white spaces meet somewhere
        self.meets = regex.compile(f"[{SPACES}][{SPACES}]") if pattern == WORDWISE else None
        self.pieces = _Pieces(Transducer(ranks))
        self.words = _Words(self)
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode_pieces(self, text: str) -> bytes:
        piece = self.pieces.__getitem__
        if len(text) < _FLUSH:
            return b"".join(map(piece, self.split.findall(text)))
        return b"".join(piece(m.group()) for m in self.split.finditer(text))

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.meets is None or self.meets.search(text):
            return self.encode_pieces(text)
        head, *words = text.split(" ")
        return self.encode_pieces(head) + b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], run: int = RUN) -> Iterator[str]:
        """Text as soon as its characters are complete, from ``run`` tokens at a time; malformed bytes become U+FFFD."""
        machine, rest = Utf8Machine(), iter(ids)
        while some := [*islice(rest, run)]:
            if text := machine.feed(self.decode_bytes(some)):
                yield text
        if text := machine.finish():
            yield text


class Utf8Machine:
    """Bytes in pieces of any size to characters; what waits is at most three bytes of a character begun."""

    def __init__(self) -> None:
        self.waiting = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Bytes at the end of ``data`` that begin a character which may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            needs = 2 if 0xC2 <= lead <= 0xDF else 3 if lead & 0xF0 == 0xE0 else 4 if 0xF0 <= lead <= 0xF4 else 1
            if needs <= back:
                return 0
            if back > 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        keep = self._open(data)
        self.waiting = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        left, self.waiting = self.waiting, b""
        return left.decode("utf-8", "replace")


_ROW = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec_for(rank_file: bytes, pattern: str) -> Codec:
    """The worker's codec, kept between tasks with what it has learnt."""
    kept_by["bpe"] = _codecs.clear
    key = (hashlib.sha1(rank_file).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(parse_ranks(rank_file), pattern)
    return _codecs[key]


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver (its size is fixed by the tokenizer)."""
    with open(path, "rb") as f:
        return f.read()


def tokenized(docs: DataFrame, rank_file: bytes, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value, pattern)
        for batch in slices(batches, "text", owner="bpe"):
            count, first, second, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                packed = codec.encode_packed(text or "")
                ids = array("I", packed)
                count.append(len(ids))
                first.append(hashlib.sha256(packed).hexdigest())
                decoded = hashlib.sha256()
                for some in codec.decode_stream(ids):
                    decoded.update(some.encode())
                second.append(decoded.hexdigest())
                if with_ids:
                    all_ids.append(ids.tolist())
            columns = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW + (", ids array<long>" if with_ids else ""))
