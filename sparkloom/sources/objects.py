"""Members of JSON objects of any size, read by byte ranges.

A file that is one object has no lines to split at. It is read as text whose records end at closing braces, which Spark cuts into
ranges wherever it likes; whether such a brace is part of a string, and how deep it closes, is not known inside a range. So there are two
passes. The first works out, for each range and each way it may begin (outside a string, inside one, behind a backslash), how it
ends, how many levels it goes up or down, and how many members begin at each level. These functions combine associatively: along the
ranges of a file they give the state, level and number of members before each range. The second pass knows them, cuts the members of the
outer object, and hands on what begins or ends in another range with its place; only such pieces are shuffled, by
their member.

Defined results: several objects in one file, one after the other, give the members of all; equal keys give a row each; an empty
file or object gives none; nor does what is not in an object, or is no JSON. Of a file that breaks off, what is there of its last member counts if one closing brace makes it JSON. A member has to
fit into one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import scratch

#: How a range may begin: outside a string, inside one, behind a backslash in one.
OUTSIDE, INSIDE, ESCAPED = range(3)
#: Bytes that are looked at together.
SLICE = 4 << 20
_PAIR = re.compile(rb"\\.", re.DOTALL)
_QUOTE, _COMMA = ord('"'), ord(",")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_TOLD = _STEP != 0
_TOLD[[_QUOTE, _COMMA]] = True

_RANGE = "path string, start long, ends array<int>, rises array<long>, levels array<array<long>>, members array<array<long>>"
_BEFORE = "path string, start long, state int, level long, member long"
_PIECE = "path string, member long, start long, whole boolean, text string"


def structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of brackets and commas outside of strings: places, bytes, and the level after each relative to that before ``data``;
    and the state after ``data``."""
    if state == ESCAPED:
        data = b"_" + data[1:]
    plain = _PAIR.sub(b"__", data)
    codes = np.frombuffer(plain, np.uint8)
    places = np.flatnonzero(_TOLD[codes])
    kinds = codes[places]
    inside = (np.cumsum(kinds == _QUOTE) + (state != OUTSIDE)) & 1
    ends = OUTSIDE if not (inside[-1] if len(inside) else state != OUTSIDE) else ESCAPED if plain.endswith(b"\\") else INSIDE
    keep = (inside == 0) & (kinds != _QUOTE)
    places, kinds = places[keep], kinds[keep]
    return places, kinds, np.cumsum(_STEP[kinds], dtype=np.int64), ends


def _begins(kinds: np.ndarray) -> np.ndarray:
    """Where a member of the level after it may begin: behind an opening bracket or a comma."""
    return (kinds == _COMMA) | (_STEP[kinds] > 0)


class Summary:
    """What a range does, for each way it may begin."""

    def __init__(self) -> None:
        self.ends = [OUTSIDE, INSIDE, ESCAPED]
        self.rises = [0, 0, 0]
        self.members: list[Counter] = [Counter(), Counter(), Counter()]

    def read(self, data: bytes) -> None:
        if not data:
            return
        told = {state: structure(data, state) for state in set(self.ends)}
        for i, state in enumerate(self.ends):
            _, kinds, levels, self.ends[i] = told[state]
            found, n = np.unique(levels[_begins(kinds)] + self.rises[i], return_counts=True)
            self.members[i].update(dict(zip(found.tolist(), n.tolist(), strict=True)))
            self.rises[i] += int(levels[-1]) if len(levels) else 0


class Cutter:
    """Cuts a range into members of the outer object: (member, whether it begins and ends here, its bytes)."""

    def __init__(self, state: int, level: int, member: int) -> None:
        self.state, self.level, self.member = state, level, member
        self.held: list[bytes] = []
        self.begun = False

    def read(self, data: bytes) -> Iterator[tuple[int, bool, bytes]]:
        places, kinds, levels, self.state = structure(data, self.state) if data else (np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64), self.state)
        levels = levels + self.level
        begins = _begins(kinds) & (levels == 1)
        marks = np.flatnonzero(begins | (_STEP[kinds] < 0) & (levels == 0))
        at = 0
        for place, begin in zip(places[marks].tolist(), begins[marks].tolist(), strict=True):
            if self.level or at:  # before the first bracket of a file there is nothing
                yield from self._cut(data[at:place], True)
            at, self.begun = place + 1, begin
            self.member += begin
            self.level = 1 if begin else 0
        self.level = int(levels[-1]) if len(levels) else self.level
        if self.level > 0:
            self.held.append(data[at:])

    def _cut(self, last: bytes, ends: bool) -> Iterator[tuple[int, bool, bytes]]:
        self.held.append(last)
        text, self.held = b"".join(self.held), []
        if text and (self.level > 0):
            yield self.member, self.begun and ends, text

    def finish(self) -> Iterator[tuple[int, bool, bytes]]:
        yield from self._cut(b"", False)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(path, start, bytes) of records that follow each other in a range, with the braces that ended them."""
    for batch in batches:
        paths, starts = batch.column("path"), batch.column("start").to_numpy()
        codes = pc.dictionary_encode(paths)
        number = codes.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(starts) != 0)) + 1).tolist(), len(starts)] if len(starts) else []
        texts = batch.column("value").cast(pa.large_binary())
        for a, b in zip(cuts, cuts[1:], strict=False):
            some, held = [], 0
            for text in texts.slice(a, b - a).to_numpy(zero_copy_only=False):
                for at in range(0, len(text) + 1, SLICE):
                    some.append(text[at : at + SLICE])
                some.append(b"}")
                held += len(text) + 1
                if held >= SLICE:
                    yield from ((paths[a].as_py(), int(starts[a]), data) for data in _joined(some))
                    some, held = [], 0
            yield from ((paths[a].as_py(), int(starts[a]), data) for data in _joined(some))


def _joined(some: list[bytes]) -> Iterator[bytes]:
    held: list[bytes] = []
    size = 0
    for x in some:
        if held and size + len(x) > SLICE:
            yield b"".join(held)
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield b"".join(held)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, told = None, Summary()
    for path, start, data in _ranges(batches):
        if at != (path, start):
            if at:
                yield _told(*at, told)
            at, told = (path, start), Summary()
        told.read(data)
    if at:
        yield _told(*at, told)


def _told(path: str, start: int, told: Summary) -> pa.RecordBatch:
    listed = [sorted(m.items()) for m in told.members]
    columns = [[path], [start], [told.ends], [told.rises], [[[k for k, _ in m] for m in listed]], [[[n for _, n in m] for m in listed]]]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "start", "ends", "rises", "levels", "members"])


def _before(ranges: pd.DataFrame) -> pd.DataFrame:
    """State, level and members before each range of a file: the combined functions of the ranges before it."""
    state, level, member, out = OUTSIDE, 0, 0, []
    for r in ranges.sort_values("start").itertuples(index=False):
        out.append((r.path, r.start, state, level, member))
        # members of the outer object are those at level 1
        member += dict(zip(r.levels[state], r.members[state], strict=True)).get(1 - level, 0)
        state, level = int(r.ends[state]), level + int(r.rises[state])
    return pd.DataFrame(out, columns=["path", "start", "state", "level", "member"])


def members(spark: SparkSession, path: str) -> DataFrame:
    """path, nth (from 1, in a file's order), text (``"key": value``) of each member of the objects in the files of ``path``."""
    # records end at closing braces; a range holds those that begin in it
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    before = text.mapInArrow(_summaries, _RANGE).groupBy("path").applyInPandas(_before, _BEFORE)
    # a row for each range, that is for each task of the scan at most, which the driver lists anyhow
    known = spark.sparkContext.broadcast({(r.path, r.start): (r.state, r.level, r.member) for r in before.collect()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cutter = None, None

        def rows(found: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
            columns = [[at[0]] * len(found), [m for m, _, _ in found], [at[1]] * len(found), [w for _, w, _ in found], [t.decode("utf-8", "replace") for _, _, t in found]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "member", "start", "whole", "text"])

        for path, start, data in _ranges(batches):
            if at != (path, start):
                if cutter:
                    yield rows(list(cutter.finish()))
                at = (path, start)
                if at not in known.value:
                    raise RuntimeError(f"{path} was cut otherwise at first: no state is known for byte {start}. Were files or settings changed?")
                cutter = Cutter(*known.value[at])
            yield rows(list(cutter.read(data)))
        if cutter:
            yield rows(list(cutter.finish()))

    pieces = scratch.written(text.mapInArrow(cut, _PIECE), "members")
    parted = pieces.filter("NOT whole").groupBy("path", "member").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    joined = parted.select("path", F.col("member").alias("nth"), F.array_join("parts.text", "").alias("text"))
    return pieces.filter("whole").select("path", F.col("member").alias("nth"), "text").unionAll(joined).filter("text RLIKE '[^ \\t\\r\\n]'")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, entry (VARIANT) of each member of the objects in the files of ``path``; null if it is no JSON."""
    found = members(spark, path).select(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,variant>").alias("m"))
    return found.select(F.explode("m").alias("entry_id", "entry"))


def write(rows: DataFrame, path: str) -> None:
    """Files of one object each, a file for each partition of ``rows`` (entry_id, entry: JSON text); a null entry is null."""
    lines = rows.select(F.concat(F.to_json(F.struct(F.col("entry_id").alias("k"))), F.lit("\n"), F.coalesce("entry", F.lit("null"))).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "{"
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                key, entry = line.split("\n", 1)
                out.append(f"{mark}{key[5:-1]}: {entry}")  # the key as JSON, out of {"k":...}
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["}" if mark == "," else "{}"])], names=["value"])

    lines.mapInArrow(run, "value string").write.text(path)
