"""A Python data source for paged provider answers: spark.read.format("provider").

Options: pages (how many), and a reader registered under a name with register(); a page reader takes a page
number and returns (items, next page or None). One partition a page, so pages load in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Reader = Callable[[int], tuple[list[dict], int | None]]


class _Page(InputPartition):
    pass


def register(spark: SparkSession, name: str, read: Reader) -> None:
    """Makes format(name) read from a page reader."""

    class PageReader(DataSourceReader):
        def __init__(self, pages: int) -> None:
            self.pages = pages

        def partitions(self) -> list[InputPartition]:
            return [_Page(k) for k in range(self.pages)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            items, after = read(partition.value)
            for i, item in enumerate(items):
                yield partition.value, i, json.dumps(item), after is None

    class Provider(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, ordinal int, item string, complete boolean"

        def reader(self, schema) -> DataSourceReader:
            return PageReader(int(self.options.get("pages", "1")))

    spark.dataSource.register(Provider)
