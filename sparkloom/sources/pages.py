"""A paged REST source for ``spark.read.format("paged")``: one partition for each page, id filters pushed to the server."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, In, InputPartition, Not

from sparkloom.scratch import written

PAGE = 500


def _fetch(url: str) -> dict:
    with urlopen(url, timeout=60) as f:  # an HTTP error raises
        return json.load(f)


class Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class PagedSource(DataSource):
    """Options: url; page_size; any ``param.<name>`` is sent along; ``file://`` addresses read canned pages named <offset>.json."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id bigint, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.size = options["url"], int(options.get("page_size", PAGE))
        self.params = {k.removeprefix("param."): v for k, v in options.items() if k.startswith("param.")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, In) and f.attribute == ("id",):
                self.params["id[in]"] = f"[{','.join(map(str, f.value))}]"
            elif isinstance(f, Not) and isinstance(f.child, In) and f.child.attribute == ("id",):
                self.params["id[notin]"] = f"[{','.join(map(str, f.child.value))}]"
            # the server may ignore it: Spark checks again
            yield f

    def _page(self, offset: int) -> str:
        if self.url.startswith("file://"):
            return f"{self.url.rstrip('/')}/{offset}.json"
        return f"{self.url}?{urlencode({**self.params, 'sort_by': 'id', 'sort_direction': 'asc', 'range_start': offset, 'range_end': self.size})}"

    def partitions(self) -> list[Page]:
        total = _fetch(self._page(0))["meta"]["result"]["total"]
        return [Page(self._page(at)) for at in range(0, max(1, total), self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in _fetch(partition.url)["data"]:
            yield int(row["id"]), json.dumps(row, ensure_ascii=False)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def batches(ids, key: str, size: int):
    """batch, key: the distinct ids in order, ``size`` to a batch, numbered from 0. Ranges of ids are numbered each in its task, from the
    number of ids in the ranges before it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(parts, key).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range: a bound of the plan, not of the data
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return dealt.withColumn("nth", nth).join(F.broadcast(starts), "part").select(F.floor((F.col("start") + F.col("nth")) / size).alias("batch"), key)


def qid(uri):
    """The last part of an entity's address."""
    from pyspark.sql import functions as F

    return F.element_at(F.split(uri, "/"), -1)
