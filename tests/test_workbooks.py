import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evidence
from sparkloom.sources import sheets, workbooks


def test_written_and_read_by_executors(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "IF(id % 7 = 0, NULL, concat('<ü&\"', id, '\\n')) AS text")
    path = str(tmp_path / "sheets")
    workbooks.write_shards(evidence.shards(rows, ["id"], 6), ["id"], path, "review")
    assert sorted(p.name for p in (tmp_path / "sheets").iterdir()) == [f"review-{i}.xlsx" for i in range(1, 7)]
    got = workbooks.read_shards(spark, path, ["text", "id"])
    want = [(s.shard, s.text or "", str(s.id)) for s in evidence.shards(rows, ["id"], 6).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # in order inside a workbook, readable without Spark
    assert [int(r["id"]) for r in sheets.read(f"{path}/review-1.xlsx", ["id"])] == list(range(17))
    workbooks.write_shards(evidence.shards(rows.limit(10), ["id"], 2), ["id"], path, "review")
    assert sorted(p.name for p in (tmp_path / "sheets").iterdir()) == ["review-1.xlsx", "review-2.xlsx"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 4).cast("int").alias("shard"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        workbooks.write_shards(rows, [], str(tmp_path / "sheets"))
    assert not (tmp_path / "sheets").exists() or list((tmp_path / "sheets").iterdir()) == []


def test_a_shard_in_two_tasks_is_refused(spark, tmp_path):
    spark.dataSource.register(workbooks.Workbooks)
    rows = spark.range(0, 10, 1, 2).select(F.lit(1).alias("shard"), F.col("id").cast("string").alias("id"))
    with pytest.raises(Exception, match="shard"):
        rows.write.format("workbooks").option("path", str(tmp_path / "sheets")).mode("append").save()
    assert list((tmp_path / "sheets").iterdir()) == []
