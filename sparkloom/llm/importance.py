"""Target-distribution importance resampling with hashed n-grams: documents drawn as if from the distribution of a target text.

Each task has a DuckDB of its own, in memory and with one thread. It takes the words of some texts at a time by SQL, unnests them,
forms the runs of one to three words by windows over a text's words, hashes them by zlib's CRC-32, registered as a vectorised function,
and counts the buckets of each text. These counts are written as Parquet to the shared folder, so the texts are read once and
a lost executor costs the tasks it ran. Spark merges them: a sum by bucket for the corpus and one for the target give each
bucket's gain, a table of as many rows as there are buckets; a document's weight is the sum of its features' gains.

The draw adds a Gumbel variable made of each document's hash to its weight, and takes the highest sums without replacement. Ranks are those
of a global order without a global sort: rows are dealt by ranges of it, numbered inside their range, and moved by the rows
of the ranges before.

Very long texts are cut between words into pieces; a piece knows the two words after it, which end runs that begin in it.

Defined cases: null or empty text has no words, no features and weight 0; repeated rows are drawn one by one, next to each other; a
null doc_id hashes as the empty string and comes before others in ties; an empty corpus gives no rows; with an empty target, or a
corpus without words, gains compare with evenly spread buckets; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, slices, stage

BUCKETS = 10_000
#: Documents with so many words may be drawn, and so many in a hundred of them are.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: Text bytes that a task's DuckDB takes at a time, and characters of a piece of a text.
TAKEN = 1 << 20
#: Fixed value: the characters that words are made of, once A to Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same before, and what is between
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_NEXT_TWO = re.compile(rf"(?:{_BETWEEN.pattern}+{_ANY_CASE}){{0,2}}")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_COUNTS = f"""
WITH cut AS (
  SELECT piece, regexp_extract_all(translate(own, '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS own,
    regexp_extract_all(translate(beyond, '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS beyond
  FROM taken),
words AS (SELECT piece, len(own) AS n, unnest(list_concat(own, beyond)) AS word, generate_subscripts(list_concat(own, beyond), 1) AS place FROM cut),
runs AS (
  SELECT piece, n, place, word, lead(word, 1) OVER later AS second, lead(word, 2) OVER later AS third
  FROM words WINDOW later AS (PARTITION BY piece ORDER BY place)),
features AS (SELECT piece, unnest([word, word || ' ' || second, word || ' ' || second || ' ' || third]) AS feature FROM runs WHERE place <= n),
counts AS (SELECT piece, crc32(feature) % $buckets AS bucket, count(*) AS n FROM features WHERE feature IS NOT NULL GROUP BY ALL),
told AS (SELECT piece, list({{'bucket': bucket::INTEGER, 'n': n}}) AS counts, sum(n)::BIGINT AS n_features FROM counts GROUP BY piece)
SELECT piece, len(own)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, counts FROM cut LEFT JOIN told USING (piece) ORDER BY piece
"""
_SCHEMA = "row long, doc_id long, n_words long, n_features long, counts array<struct<bucket: int, n: long>>"


def _crc32(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter(map(zlib.crc32, texts.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint32, len(texts)))


def pieces(text: str, most: int = TAKEN) -> Iterator[tuple[str, str]]:
    """A text cut between words into pieces of about ``most`` characters, each with the text of the two words after it."""
    at = 0
    while len(text) - at > most:
        end = _BETWEEN.search(text, at + most)
        if end is None:
            break
        yield text[at : end.start()], _NEXT_TWO.match(text, end.start()).group()
        at = end.start()
    yield text[at:], ""


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, taken: int = TAKEN) -> DataFrame:
    """row, doc_id, n_words, n_features, counts of each row of ``docs`` (doc_id, text), written to the shared folder; a very long
    text has a row for each of its pieces, all of one number ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}) as base:
            base.create_function("crc32", _crc32, ["VARCHAR"], "UINTEGER", type="arrow")
            for batch in slices(batches, "text", taken, owner="importance"):
                held = [(i, piece, beyond) for i, text in enumerate(batch.column("text").to_pylist()) for piece, beyond in pieces(text or "", taken)]
                # more than one slice's worth only where a single text is longer
                for some in _portions(held, taken):
                    which = pa.array([i for i, _, _ in some], pa.int32())
                    base.register("taken", pa.table({"piece": pa.array(range(len(some)), pa.int32()), "own": [p for _, p, _ in some], "beyond": [b for _, _, b in some]}))
                    told = base.sql(_COUNTS, params={"buckets": buckets}).to_arrow_table().combine_chunks()
                    base.unregister("taken")
                    columns = [batch.column("row").take(which), batch.column("doc_id").take(which)]
                    columns += [told.column(c).combine_chunks() for c in ("n_words", "n_features", "counts")]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "n_features", "counts"])

    bounded_batches(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(numbered.mapInArrow(run, _SCHEMA), "bucket-counts")


def _portions(held: list[tuple[int, str, str]], most: int) -> Iterator[list[tuple[int, str, str]]]:
    at = size = 0
    for i, (_, piece, _) in enumerate(held):
        if i > at and size + len(piece) > most:
            yield held[at:i]
            at, size = i, 0
        size += len(piece)
    if at < len(held):
        yield held[at:]


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: a thousand times the logarithm of how much likelier a feature of the bucket is in the target than in the
    corpus, both smoothed by one of each bucket, rounded down. A row for each bucket."""

    def merged(counts: DataFrame, name: str) -> DataFrame:
        return counts.select(F.inline("counts")).groupBy("bucket").agg(F.sum("n").alias(name))

    both = corpus.sparkSession.range(buckets).selectExpr("int(id) AS bucket").join(merged(corpus, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    # as many rows as there are buckets, whatever the corpus
    both = stage(both, "gains")
    whole = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T"))
    ratio = "((double(t) + 1) * (double(S_) + {0})) / ((double(s) + 1) * (double(T_) + {0}))".format(float(buckets))
    return both.join(F.broadcast(whole.selectExpr("S AS S_", "T AS T_")), how="cross").select("bucket", F.expr(f"floor(1000 * ln({ratio}))").alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times the Gumbel variable made of a document's hash, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long").cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs`` (doc_id, text), drawn towards the texts of ``target``
    (text): ``percent`` of the documents with ``least_words`` words have a rank, the others null."""
    counts = bucket_counts(docs, buckets)
    gain = gains(counts, bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets), buckets)
    parts = counts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("n_features").alias("n_features"))
    # a row for each bucket: a bound of the method, not of the data
    weights = counts.select("row", F.inline("counts")).join(F.broadcast(gain), "bucket").groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("weight"))
    scored = parts.join(weights, "row", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    scored = stage(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    return _ranked(scored, F.col("n_words") >= least_words, percent)


def _ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("row")]
    dealt = scored.filter(eligible).repartitionByRange(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    # one row for each range
    totals = dealt.groupBy("part").agg(F.count("*").alias("rows"))
    offsets = totals.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    drawn = totals.agg(F.expr(f"coalesce(sum(rows), 0) * {int(percent)} div 100").alias("drawn"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = dealt.join(F.broadcast(offsets.join(drawn, how="cross")), "part").withColumn("place", place)
    out = ["doc_id", "n_features", "weight", "score"]
    chosen = placed.select(*out, F.when(F.col("place") <= F.col("drawn"), F.col("place")).cast("long").alias("rank"))
    return chosen.unionAll(scored.filter(~eligible).select(*out, F.lit(None).cast("long").alias("rank")))


#: CRC-32 bit by bit, over a table of 256 entries made by its rule.
ORACLE = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: if(c % 2 = 1, xor(c // 2, 3988292384), c // 2), b)) AS crc),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
cut AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
features AS (
  SELECT side, row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: concat_ws(' ', words[i], words[i + 1])),
    list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2])))) AS feature
  FROM cut),
hashed AS (
  SELECT feature, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || substr(hex(feature), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM features), steps),
counts AS (SELECT side, row, bucket, count(*) AS n FROM features JOIN hashed USING (feature) GROUP BY ALL),
buckets AS (SELECT bucket, sum(if(side = 'd', n, 0))::DOUBLE AS s, sum(if(side = 't', n, 0))::DOUBLE AS t FROM counts GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM buckets) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000))))::BIGINT AS gain FROM buckets),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counts JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT row, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weights USING (row) WHERE side = 'd'),
placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, if(place <= 5 * n // 100, place, NULL) AS rank FROM scored LEFT JOIN placed USING (row)
"""
