"""JSON dumps keyed by entry, ledgers, and the side inputs of preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkloom.sources import objects


def entries(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, entry (VARIANT) of a dump: files of one JSON object each, or (``path`` ends with .jsonl) JSON lines of
    {"entry_id": ..., "entry": ...}. Both are split into ranges of bytes."""
    if path.rstrip("/").endswith(".jsonl"):
        lines = spark.read.text(path).select(F.parse_json("value").alias("v"))
        return lines.select(F.try_variant_get("v", "$.entry_id", "string").alias("entry_id"), F.try_variant_get("v", "$.entry", "variant").alias("entry"))
    return objects.entries(spark, path)


def raw_posts(dump: DataFrame) -> DataFrame:
    """entry_id, label, ent_type, verband, platform, ordinal, raw: every post of every entry."""
    head = [F.coalesce(F.try_variant_get("entry", f"$.{n}", "string"), F.try_variant_get("entry", f"$.{n.capitalize()}", "string")).alias(n) for n in ("label", "ent_type", "verband")]
    media = F.try_variant_get("entry", "$.social_media", "map<string,array<variant>>")
    return dump.select("entry_id", *head, F.explode(media).alias("platform", "posts")).select("entry_id", "label", "ent_type", "verband", "platform", F.posexplode("posts").alias("ordinal", "raw"))


def labels_of(dump: DataFrame, ent_type: str) -> DataFrame:
    """The distinct labels of people ('p') or organisations ('o')."""
    label = F.coalesce(F.try_variant_get("entry", "$.label", "string"), F.try_variant_get("entry", "$.Label", "string"))
    return dump.filter(F.try_variant_get("entry", "$.ent_type", "string") == ent_type).select(label.alias("label")).filter("label IS NOT NULL AND label <> ''").distinct()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """key, reviewed_at, edited; an absent file is an empty ledger."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "key string, reviewed_at string, edited string")
    m = whole.select(F.explode(F.from_json("value", "map<string,struct<reviewed_at:string,alt_text_edited:string>>")).alias("key", "r"))
    return m.select("key", "r.reviewed_at", F.col("r.alt_text_edited").alias("edited"))


def alt_texts(spark: SparkSession, path: str) -> DataFrame:
    """stem, alt_text of usable generated texts; of several with one id the last."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<id:string,status:string,alt_text:string>>")).alias("nth", "r"))
    good = rows.filter("r.status = 'OK'").filter(F.trim(F.coalesce("r.alt_text", F.lit(""))) != "")
    return good.groupBy(F.col("r.id").alias("stem")).agg(F.max_by("r.alt_text", "nth").alias("alt_text"))


def report_addresses(spark: SparkSession, path: str) -> DataFrame:
    """fds_link, single, by_path: one address for all chapters, or chapters (as JSON) and addresses zipped to the shorter list."""
    kind = "array<struct<FdS_links:string,capitle_structur:array<array<string>>,urls_zur_webseite:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("r")).select("r.*")
    c, u = F.coalesce("capitle_structur", F.array()), F.coalesce("urls_zur_webseite", F.array())
    n = F.least(F.size(c), F.size(u))
    pairs = F.map_from_entries(F.transform(F.arrays_zip(F.slice(c, F.lit(1), n).alias("c"), F.slice(u, F.lit(1), n).alias("u")), lambda p: F.struct(F.to_json(p["c"]), p["u"])))
    return rows.select(F.col("FdS_links").alias("fds_link"), F.when(F.size(u) == 1, F.get(u, 0)).alias("single"), F.when(F.size(u) != 1, pairs).alias("by_path"))


def media_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path relative to ``root``, length, modified: a listing only, contents are not read until they are asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    relative = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace("file://", "") + "/", "")
    return found.select(relative.alias("path"), "length", F.col("modificationTime").alias("modified"))
