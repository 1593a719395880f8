import time

from sparkloom.llm import common, near_dedup, secrets
from sparkloom.llm.common import stage


def test_nothing_shuffled_outlives_a_stage(spark):
    files = lambda: {f for f in (str(x) for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())) if "shuffle_" in f}
    before = files()
    rows = spark.range(200_000).selectExpr("id", "id % 1000 AS k").repartition(4, "k")
    held = stage(rows.groupBy("k").count(), "shuffled")
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and held.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_what_stays_staged_is_narrow_or_compressed_well(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('alpha beta gamma delta epsilon zeta ', id div 2) AS text", "'s' AS source")
    before = set(common._made)
    left = near_dedup.deduplicated(docs)
    assert left.count() == 30
    assert secrets.redact(docs).count() == 60
    stay = [spark.read.parquet(path) for path in set(common._made) - before if "-gone-" not in path]
    assert stay and not any({"bitmap", "buckets"} & set(t.columns) for t in stay)
    texts = [t for t in stay if "text" in t.columns]
    assert len(texts) == 2 and all(f.endswith(".zstd.parquet") for t in texts for f in t.inputFiles())
