"""Minimum-cost repair of chat roles by dynamic programming over an automaton of legal turns, and rendering.

Legal conversations are an optional system turn, then user and assistant turns in alternation, ending with the
assistant. Each turn is kept, merged into the one before it, relabelled, or preceded by empty turns; the cheapest choice for the
whole conversation is taken. A turn's effect is a matrix of costs between the automaton's states and such matrices multiply
in the (min, +) sense, so a conversation of more than ``CHUNK`` turns is cut into chunks: the chunks' matrices give the costs at
each chunk's start, a backward pass the states at each chunk's end, and then every chunk is repaired on its own. The result is the
same as of one pass over the whole conversation, whatever the chunk size. Other conversations are shuffled once and repaired
where they arrive.

Turns are ordered by (turn, role, first 64 characters of the text, hash of the text), nulls first. Ties between repairs go to the earlier state at each step, seen from
the end (start, system, user, assistant), then to keep, merge, insert, relabel in this order.

Defined cases: a null or unknown role is relabelled (cheaply, cost ``UNKNOWN``) or merged; a null text is rendered empty; repeated rows
are turns of their own; rows of a null conv_id are one conversation; conversations and texts of any length are repaired whole; an
empty table gives no rows; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, stage

MERGE, INSERT, RELABEL, UNKNOWN = 2, 3, 4, 1
CHUNK = 4096
#: Names of long conversations that are broadcast; more meet the turns in a shuffled join.
BROADCAST_ROWS = 1_000_000
#: Other names of the roles.
ALIASES = {"system": ("system", "developer"), "user": ("user", "human", "prompter"), "assistant": ("assistant", "bot", "gpt", "model", "ai", "chatbot")}
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_BIG = 1 << 40
_SEPARATOR, _OPEN, _CLOSE = "\n\n", "<|im_start|>{}\n", "<|im_end|>\n"


def symbol(role: Column) -> Column:
    """1 to 3 for a known role, 0 for any other or none."""
    name = F.lower(F.trim(role))
    found = F.lit(0)
    for number, key in ((SYSTEM, "system"), (USER, "user"), (ASSISTANT, "assistant")):
        found = F.when(name.isin(*ALIASES[key]), number).otherwise(found)
    return found.cast("int")


def _shortest(start: int, end: int) -> list[int] | None:
    """The empty turns between two states so that the step to ``end`` is legal; at most two are ever needed."""
    queue: list[tuple[int, list[int]]] = [(start, [])]
    for state, path in queue:
        if end in LEGAL[state]:
            return path
        if len(path) < 2:
            queue += [(s, [*path, s]) for s in LEGAL[state]]
    return None


def _choices(given: int) -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, list[int]]]]:
    """Costs between states for a turn of role ``given`` and what attains them."""
    cost, how = np.full((4, 4), _BIG, np.int64), {}
    for start in range(4):
        for end in (SYSTEM, USER, ASSISTANT):
            off = 0 if end == given else UNKNOWN if given == 0 else RELABEL
            options = []
            if end in LEGAL[start]:
                options.append((off, 0 if off == 0 else 3, "keep" if off == 0 else "relabel", []))
            if start == end:
                options.append((MERGE + off, 1, "merge", []))
            between = _shortest(start, end)
            if between:
                options.append((INSERT * len(between) + off, 2, "insert" if off == 0 else "insert, relabel", between))
            if options:
                best = min(options, key=lambda o: o[:2])
                cost[start, end], how[start, end] = best[0], (best[2], best[3])
    return cost, how


_TURNS = [_choices(given) for given in range(4)]
_COSTS = np.stack([c for c, _ in _TURNS])
_ENDING = {s: [*(_shortest(s, ASSISTANT) or []), ASSISTANT] if s != ASSISTANT else [] for s in (SYSTEM, USER, ASSISTANT)}
_END_COST = np.array([_BIG, *(INSERT * len(_ENDING[s]) for s in (SYSTEM, USER, ASSISTANT))])
_BEGIN = np.array([0, _BIG, _BIG, _BIG])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _BIG)


def chunk_matrix(given: np.ndarray) -> np.ndarray:
    """The (min, +) product of the turns' matrices, by halves."""
    row = _COSTS[given]
    while len(row) > 1:
        odd = row[-1:] if len(row) % 2 else None
        row = np.minimum((row[0 : len(row) - 1 : 2, :, :, None] + row[1::2, None, :, :]).min(axis=2), _BIG)
        if odd is not None:
            row = np.concatenate([row, odd])
    return row[0]


def walk(given: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Costs of the states after the turns, and for each turn the best state before it by the state after it."""
    before = []
    for g in given.tolist():
        total = costs[:, None] + _COSTS[g]
        before.append(total.argmin(axis=0))
        costs = np.minimum(total.min(axis=0), _BIG)
    return costs, before


def states_from(end: int, before: list[np.ndarray]) -> list[int]:
    """The states before, between and after the turns on the best way to ``end``."""
    states = [end]
    for step in reversed(before):
        states.append(int(step[states[-1]]))
    return states[::-1]


def pieces(given: np.ndarray, texts: list[str | None], costs: np.ndarray, end: int | None, last: bool) -> list[tuple[str, str, str, int, str]]:
    """action, role, inserted, cost and rendered piece of each turn of a chunk that starts at ``costs``."""
    after, before = walk(given, costs)
    if end is None:
        end = int((after + _END_COST).argmin())
    states, out = states_from(end, before), []
    for i, (g, text) in enumerate(zip(given.tolist(), texts)):
        start, to = states[i], states[i + 1]
        action, between = _TURNS[g][1][start, to]
        piece = _SEPARATOR if action == "merge" else "".join((_CLOSE if s else "") + _OPEN.format(ROLES[r]) for s, r in zip((start, *between), (*between, to)))
        piece += text or ""
        cost, added = int(_COSTS[g][start, to]), list(between)
        if last and i == len(given) - 1:
            piece += _CLOSE + "".join(_OPEN.format(ROLES[r]) + _CLOSE for r in _ENDING[to])
            cost, added = cost + int(_END_COST[to]), [*added, *_ENDING[to]]
        out.append((action, ROLES[to], ",".join(ROLES[r] for r in added), cost, piece))
    return out


#: The order of a conversation's turns; the last key parts repeated rows, which are interchangeable, so that a hot turn is split as well.
ORDER = ["turn", "role", "opening", "like", "apart"]


def _keyed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, given and the other keys of ``ORDER``."""
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), symbol(F.col("role").cast("string")).alias("given"))
    rows = rows.withColumn("like", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("apart", F.xxhash64(F.monotonically_increasing_id()))
    return rows.withColumn("opening", F.substring("text", 1, 64))


def _ordered(turns: DataFrame, chunk: int) -> DataFrame:
    """conv_id, turn, role, text, given, position in the conversation, its turns, chunk; dealt by ranges of the order, so
    that a conversation of any length is spread over tasks."""
    parts, order = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), ORDER
    rows = _keyed(turns)
    dealt = rows.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id())
    dealt = stage(dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))), "turns")
    runs = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("turns"))
    placed = dealt.join(runs, dealt["conv_id"].eqNullSafe(runs["c"]) & (dealt["part"] == runs["p"]))
    placed = placed.withColumn("position", F.col("before") + F.col("nth") - 1)
    return placed.select("conv_id", "turn", "role", "text", "given", "position", "turns", F.floor(F.col("position") / chunk).alias("chunk"))


def _by_chunk(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each`` applied to the table of every (conv_id, chunk), in order of position; a task holds one chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[pa.RecordBatch] = []
        for batch in batches:
            keep.append(batch)
            table = pa.Table.from_batches(keep).combine_chunks()
            position, size = table.column("position").to_numpy(), table.num_rows
            chunk = table.column("chunk").to_numpy()
            conv = table.column("conv_id").to_pylist()
            cut = [0, *(i for i in range(1, size) if conv[i] != conv[i - 1] or chunk[i] != chunk[i - 1] or position[i] <= position[i - 1]), size]
            done = [each(table.slice(s, e - s)) for s, e in zip(cut[:-2], cut[1:-1])]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
            keep = table.slice(cut[-2]).to_batches() if size else []
        if keep:
            yield from each(pa.Table.from_batches(keep)).combine_chunks().to_batches()

    return rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "position").mapInArrow(run, schema)


def _contexts(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, costs at its start, state at its end, of conversations of several chunks."""
    kind = dict(rows.dtypes)["conv_id"]

    def matrix(t: pa.Table) -> pa.Table:
        m = chunk_matrix(t.column("given").to_numpy())
        return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "chunk": t.column("chunk").slice(0, 1), "matrix": pa.array([m.ravel().tolist()], pa.list_(pa.int64()))})

    def starts(frame: pd.DataFrame) -> pd.DataFrame:
        frame, costs, out = frame.sort_values("chunk").reset_index(drop=True), _BEGIN, []
        for m in frame["matrix"]:
            out.append(costs.tolist())
            costs = np.minimum((costs[:, None] + np.array(m).reshape(4, 4)).min(axis=0), _BIG)
        return frame[["conv_id", "chunk"]].assign(costs=out)

    def backward(t: pa.Table) -> pa.Table:
        after, before = walk(t.column("given").to_numpy(), np.array(t.column("costs")[0].as_py()))
        came = [states_from(s, before)[0] for s in range(4)]
        return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "chunk": t.column("chunk").slice(0, 1), "came": pa.array([came], pa.list_(pa.int64())), "best": pa.array([int((after + _END_COST).argmin())], pa.int64())})

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk").reset_index(drop=True)
        state, out = int(frame["best"].iloc[-1]), []
        for came in reversed(frame["came"].tolist()):
            out.append(state)
            state = int(came[state])
        return frame[["conv_id", "chunk"]].assign(state=out[::-1])

    matrices = _by_chunk(rows, matrix, f"conv_id {kind}, chunk long, matrix array<long>")
    costs = stage(matrices.groupBy("conv_id").applyInPandas(starts, f"conv_id {kind}, chunk long, costs array<long>"), "starts")
    with_costs = rows.join(costs.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "costs"), rows["conv_id"].eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).drop("c", "k")
    back = _by_chunk(with_costs, backward, f"conv_id {kind}, chunk long, came array<long>, best long")
    final = back.groupBy("conv_id").applyInPandas(ends, f"conv_id {kind}, chunk long, state long")
    return stage(costs.join(final.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "state"), costs["conv_id"].eqNullSafe(F.col("c")) & (costs["chunk"] == F.col("k"))).select("conv_id", "chunk", "costs", "state"), "contexts")


def _by_conversation(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each`` applied to the table of every conversation, in order; a task holds one conversation at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[pa.RecordBatch] = []
        for batch in batches:
            conv = batch.column("conv_id").to_pylist()
            if keep and conv and conv[0] != keep[-1].column("conv_id")[-1].as_py():
                yield from each(pa.Table.from_batches(keep)).combine_chunks().to_batches()
                keep = []
            cut = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1])]
            for s, e in zip(cut[:-1], cut[1:]):
                yield from each(pa.Table.from_batches([*keep, batch.slice(s, e - s)])).combine_chunks().to_batches()
                keep = []
            if conv:
                keep.append(batch.slice(cut[-1]))
        if keep:
            yield from each(pa.Table.from_batches(keep)).combine_chunks().to_batches()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", "text", "given").mapInArrow(run, schema)


def formatted(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, turn, position, action, role, inserted, cost, rendered of each row of ``turns`` (conv_id, turn, role, text):
    a conversation's rendered text is that of its rows in order of position."""
    bounded_batches(turns.sparkSession)
    turns = turns.select("conv_id", "turn", "role", "text")
    kind, when = dict(turns.dtypes)["conv_id"], dict(turns.dtypes)["turn"]
    schema = f"conv_id {kind}, turn {when}, position long, action string, role string, inserted string, cost long, rendered string"
    # at most one conversation in ``chunk`` rows is long
    long = stage(turns.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select(F.col("conv_id").alias("c")), "long")
    count = long.count()

    def repaired(t: pa.Table, first: int, costs: np.ndarray, state: int | None, last: bool) -> pa.Table:
        out = pieces(t.column("given").to_numpy(), t.column("text").to_pylist(), costs, state, last)
        action, role, inserted, cost, rendered = zip(*out)
        position = pa.array(np.arange(first, first + len(out)))
        return pa.table(
            {
                "conv_id": t.column("conv_id"), "turn": t.column("turn"), "position": position, "action": pa.array(action), "role": pa.array(role),
                "inserted": pa.array(inserted), "cost": pa.array(cost, pa.int64()), "rendered": pa.array(rendered),
            }
        )

    def whole(t: pa.Table) -> pa.Table:
        return repaired(t, 0, _BEGIN, None, True)

    if not count:
        return _by_conversation(_keyed(turns), whole, schema)
    few = F.broadcast(long) if count <= BROADCAST_ROWS else long
    short = turns.join(few, turns["conv_id"].eqNullSafe(few["c"]), "left_anti")
    rows = stage(_ordered(turns.join(few, turns["conv_id"].eqNullSafe(few["c"]), "left_semi"), chunk), "placed")
    held = _contexts(rows.select("conv_id", "chunk", "position", "given")).select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "costs", "state")
    told = rows.join(held, rows["conv_id"].eqNullSafe(held["c"]) & (rows["chunk"] == held["k"])).drop("c", "k")

    def part(t: pa.Table) -> pa.Table:
        first, turns = t.column("position")[0].as_py(), t.column("turns")[0].as_py()
        return repaired(t, first, np.array(t.column("costs")[0].as_py()), t.column("state")[0].as_py(), first + t.num_rows == turns)

    return _by_conversation(_keyed(short), whole, schema).unionByName(_by_chunk(told, part, schema))
