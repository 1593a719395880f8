"""Near-duplicate groups by circulant MinHash: two permutations, one of them shifted circularly, give all signature
coordinates; bands of them give candidates; links are confirmed by exact Jaccard similarity of whole shingle sets.

How it stays linear in the size of a group:

* equal shingle sets are folded into one node first;
* in each bucket every member is compared with one hub, that whose buckets are largest altogether (in a group of edited copies
  this is their origin), so a group of m near copies gives about m pairs;
* what is then still in different components of a bucket is compared in blocks of at most ``2 * BLOCK`` members with a bitmap
  of each set, whose Hamming distance never exceeds the sets' true difference. Pairs that the bound cannot exclude,
  all of them, are confirmed like the others. No candidate is capped or dropped.

Joins by bucket meet staged tables, whose size is known when they are planned: a small one is broadcast and nothing is dealt by
bucket; with a larger one both sides are plain exchanges, in which adaptive execution splits a bucket of many members.

Defined cases: null or blank text has an empty set, links with nothing and is its own component; equal rows and equal
sets are linked (similarity 1); a document of fewer than five words has one shingle, the whole sequence; very long texts are
hashed in blocks; a null ``doc_id`` takes part in linking but is never a component's id, and is never kept unless its whole
component has none; an empty table gives no rows; columns other than doc_id and text are ignored by ``near_duplicates`` and
returned as they are, whatever their names, by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.circulant import BANDS, ROWS, Circulant
from sparkloom.llm.common import TEXTS, bounded_batches, free_name, key_bitmap, maybe_among, release, slices, stage, utf8, without
from sparkloom.llm.shingles import mix, shingle_sets

PERCENT = 85
BITS = 1024
BLOCK = 1024
_SIGNED = "doc_id long, row long, n_shingles long, node binary, origin long, bitmap binary, buckets array<long>"


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles >> np.uint64(40)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).tobytes()


def signatures(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, row: Column | None = None) -> DataFrame:
    """doc_id, row (null, if no column of row numbers is given), n_shingles, node (digest of the set; null if empty), origin
    (key of the text), bitmap, buckets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Circulant(rows, bands)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
        for batch in slices(batches, "text"):
            count, node, bitmap, buckets = [], [], [], []
            for found in shingle_sets(utf8(batch.column("text"))):
                some = len(found) > 0
                count.append(len(found))
                node.append(_node(found) if some else None)
                bitmap.append(_bitmap(found) if some else None)
                buckets.append(maker.band_keys(found) ^ salt if some else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row"), pa.array(count, pa.int64()), pa.array(node, pa.binary()), batch.column("origin"),
                    pa.array(bitmap, pa.binary()), pa.array(buckets, pa.list_(pa.int64())),
                ],
                names=["doc_id", "row", "n_shingles", "node", "origin", "bitmap", "buckets"],
            )

    bounded_batches(docs.sparkSession)
    row = F.lit(None) if row is None else row
    return docs.select(F.col("doc_id").cast("long"), row.cast("long").alias("row"), "text", _text_key().alias("origin")).mapInArrow(sign, _SIGNED)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles: the whole sets of the wanted nodes, each once, from a second pass over the texts."""
    held = key_bitmap(wanted, "origin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = held.value, set()
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(maybe_among(table, batch.column("origin").to_numpy())))
            node, found = [], []
            for x in shingle_sets(utf8(batch.column("text"))):
                if len(x) and (k := _node(x)) not in done:
                    if len(done) < 100_000:
                        done.add(k)
                    node.append(k)
                    found.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    every = docs.select("text", _text_key().alias("origin")).mapInArrow(read, "node binary, shingles array<long>")
    return every.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are at least ``percent`` % alike."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for the ends of ``links`` (a, b): smallest labels spread along links and are
    then followed one step further, until nothing changes; each round is a staged table. Labels only ever fall, so it ends."""
    held: list[str] = []
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges", held)
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), f"{name}-0", held)
    for i in numbers(1):
        before = held[1:]
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        ahead = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = moved.join(ahead, "component").select("node", "old", F.least("component", "further").alias("component"))
        moved = stage(moved, f"{name}-{i}", held)
        del held[1:-1]
        release(before)
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            release(held[:1])
            return labels


def _unsettled(members: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """The pairs (a, b) of a bucket in different components that the bitmaps' bound leaves possible."""
    held = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).filter("low <> high")
    mixed = stage(mixed.select("bucket", "members"), "mixed")
    held = held.drop("members").join(mixed, "bucket").join(nodes.select("node", "n", "bitmap"), "node")
    blocks = F.ceil(F.col("members") / block)
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    held = held.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("side"), "node", "component", "n", "bitmap")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def within(t: pa.Table) -> tuple[list, list]:
            node = t.column("node").to_pylist()
            part = np.unique(np.array(t.column("component").to_pylist(), object), return_inverse=True)[1]
            n, side = t.column("n").to_numpy(), t.column("side").to_numpy()
            bits = np.frombuffer(b"".join(t.column("bitmap").to_pylist()), np.uint64).reshape(len(node), -1)
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            a, b = [], []
            for i in range(len(node)):
                if lo != hi and side[i] != lo:
                    continue
                rest = np.flatnonzero(part != part[i]) if lo != hi else i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
                rest = rest[side[rest] == hi]
                total = n[rest] + n[i]
                rest = rest[np.minimum(n[rest], n[i]) * 100 >= percent * np.maximum(n[rest], n[i])]
                total = n[rest] + n[i]
                apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
                # 100 I >= p U and U = total - I mean that the sets differ in at most total (100 - p) / (100 + p) places
                for j in rest[apart * (100 + percent) <= total * (100 - percent)].tolist():
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
            return a, b

        keep: list[pa.RecordBatch] = []

        def out(a: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        def runs(t: pa.Table) -> list[int]:
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("bucket", "lo", "hi")])
            return [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]

        for batch in batches:
            keep.append(batch)
            table = pa.Table.from_batches(keep)
            cut = runs(table)
            for s, e in zip(cut[:-2], cut[1:-1]):
                a, b = within(table.slice(s, e - s))
                if a:
                    yield out(a, b)
            keep = table.slice(cut[-2]).combine_chunks().to_batches() if table.num_rows else []
        if keep:
            a, b = within(pa.Table.from_batches(keep))
            if a:
                yield out(a, b)

    dealt = held.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def grouped(docs: DataFrame, percent: int, rows: int, bands: int, block: int, row: Column | None = None) -> DataFrame:
    """doc_id, row, n_shingles, component_id, first of each row of ``docs``; ``first``, which needs row numbers, is true for one
    row of each component, that of the smallest doc_id (nulls last), then row."""
    held: list[str] = []
    wide: list[str] = []
    signed = stage(signatures(docs, rows, bands, row), "signatures", wide)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = signed.filter("node is not null").groupBy("node").agg(
        F.min(place).alias("least"), F.first("n_shingles").alias("n"), F.first("origin").alias("origin"), F.first("bitmap").alias("bitmap"), F.first("buckets").alias("buckets")
    )
    nodes = stage(nodes, "nodes", held)
    # bitmaps and buckets go on by node alone
    signed = stage(signed.select("doc_id", "row", "n_shingles", "node"), "signed")
    release(wide)
    every = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = stage(every.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "shared", held)
    members = stage(every.join(shared, "bucket"), "members", held)
    score = members.groupBy("node").agg(F.sum("members").alias("score"))
    ranked = stage(members.join(score, "node").select("bucket", "node", "score"), "ranked", held)
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("top")).select("bucket", F.col("top.node").alias("hub"))
    hubs = stage(hubs, "hubs", held)
    spokes = ranked.join(hubs, "bucket").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    wanted = nodes.join(score.select("node"), "node", "left_semi").select("node", "origin")
    sets = stage(_sets(docs, wanted), "sets", held)
    links = stage(_confirmed(spokes, sets, percent), "links", held)
    labels = components(links, "first")
    rest = stage(_unsettled(members, nodes, labels, percent, block), "unsettled", held)
    more = stage(_confirmed(rest, sets, percent), "links-rest", held)
    if not more.isEmpty():
        labels = components(links.union(more), "all")
    labels = labels.join(nodes.select("node", "least"), "node")
    lowest = labels.groupBy("component").agg(F.min("least").alias("lowest"))
    known = nodes.select("node", "least").join(labels.join(lowest, "component").select("node", "lowest"), "node", "left")
    # many rows may have one node: staged, so that the join of the rows can be split
    known = stage(known.select("node", F.coalesce("lowest", "least").alias("lowest")), "known")
    release(held)
    found = signed.select("doc_id", "row", "n_shingles", "node").join(known, "node", "left")
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("lowest.doc_id"))
    return found.select("doc_id", "row", "n_shingles", component.alias("component_id"), (alone | (F.col("lowest") == place)).alias("first"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    A link of similarity s becomes a candidate with probability ``1 - (1 - s ** rows) ** bands``; with 5 and 26 that is
    all but 3 in 10 million at 0.85 and all but 3 in 100,000 at 0.8.
    """
    found = grouped(docs, percent, rows, bands, block)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """One row of each component of ``docs``, all columns: that of the smallest doc_id (nulls last), of repeated rows the
    first. Rows are told by a number given once, in a staged table, so repeated and null ids part nothing and join nothing."""
    row = free_name(docs, "row_number")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression=TEXTS)
    gone = grouped(numbered, percent, rows, bands, block, F.col(row)).filter("NOT first").select("row")
    return without(numbered, row, gone)


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM w),
d AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n f ON f.doc_id = x JOIN n t ON t.doc_id = y WHERE 100 * c >= {PERCENT} * (f.n + t.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
