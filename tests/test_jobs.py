import pytest
from pyspark.sql import functions as F

from sparkloom.operators import jobs, media
from sparkloom.sources import sinks


def test_jobs(spark, tmp_path):
    made = lambda n: {"t": spark.createDataFrame([(n,)], "n int")}
    root = str(tmp_path)
    assert jobs.run(spark, [jobs.Job("a", lambda: made(1))], root, dry_run=True)["t"].first().n == 1
    assert list(tmp_path.iterdir()) == []
    jobs.run(spark, [jobs.Job("a", lambda: made(1)), jobs.Job("b", lambda: {})], root)

    def fails():
        raise RuntimeError("no answer")

    with pytest.raises(RuntimeError):
        jobs.run(spark, [jobs.Job("a", fails), jobs.Job("b", lambda: made(3))], root)
    assert sinks.current(spark, root, "t").first().n == 1
    assert sorted((r.operation, r.success, r.notes) for r in spark.read.parquet(f"{root}/runs").collect()) == [("a", False, "no answer"), ("a", True, "")]
    with pytest.raises(ValueError, match="party"):
        jobs.run(spark, [jobs.Job("c", lambda: made(4), [lambda: "party is not set"])], root)
    assert [j.name for j in jobs.in_order({n: jobs.Job(n, dict) for n in ("mandates", "elections", "parliaments")}, only_setup=True)] == ["parliaments", "elections"]


def test_a_failure_between_two_tables_publishes_neither(spark, tmp_path):
    root = str(tmp_path)
    good = lambda n: spark.createDataFrame([(n,)], "n int")
    bad = spark.createDataFrame([(1,)], "n int").select(F.raise_error(F.lit("broken")).alias("n"))
    jobs.run(spark, [jobs.Job("a", lambda: {"one": good(1), "two": good(1)})], root)
    with pytest.raises(Exception, match="broken"):
        jobs.run(spark, [jobs.Job("b", lambda: {"one": good(2), "two": bad})], root)
    assert sinks.current(spark, root, "one").first().n == 1 and sinks.current(spark, root, "two").first().n == 1
    # what was written before the failure is gone
    assert len(list((tmp_path / "one").iterdir())) == 1 and len(list((tmp_path / "two").iterdir())) == 1
    jobs.run(spark, [jobs.Job("c", lambda: {"two": good(3)})], root)
    assert sinks.current(spark, root, "one").first().n == 1 and sinks.current(spark, root, "two").first().n == 3
    assert sinks.current(spark, root, "three") is None and sinks.versions(spark, f"{root}/none") == (0, {})


def test_media(spark):
    posts = spark.createDataFrame([(1, "a.png"), (2, "gone.png"), (3, None)], "id int, screenshot_file string")
    files = spark.createDataFrame([("a.png",), ("old.png",)], "path string")
    assert {(r.id, r.found) for r in media.attached(posts, files).collect()} == {(1, True), (2, False), (3, False)}
    assert [r.path for r in media.unreferenced(files, posts).collect()] == ["old.png"]
