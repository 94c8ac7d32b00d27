"""A paged catalogue as a Spark data source: each page is a partition.

Pages come from JSON files ``page-<offset>.json`` (items, total) below a path,
or from an address with ``{offset}`` and ``{size}``; both go through the same
checks: a page with no items before the total is an error.
"""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIZE = 1000


def fetch(address: str, offset: int, size: int) -> dict:
    if "{offset}" in address:
        request = urllib.request.Request(address.format(offset=offset, size=size), headers={"User-Agent": "palimpsest"})
        with urllib.request.urlopen(request, timeout=60) as r:  # noqa: S310
            return json.load(r)
    with open(f"{address}/page-{offset}.json") as f:
        return json.load(f)


class PagedCatalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("size", SIZE)))


class _Reader(DataSourceReader):
    def __init__(self, address: str, size: int):
        self.address, self.size = address, size

    def partitions(self) -> list[InputPartition]:
        total = int(fetch(self.address, 0, self.size)["total"])
        return [InputPartition(k) for k in range(0, max(total, 1), self.size)]

    def read(self, partition: InputPartition):
        page = fetch(self.address, partition.value, self.size)
        if not isinstance(page.get("items"), list) or (not page["items"] and page["total"] > partition.value):
            raise ValueError(f"page at {partition.value} ended early")
        for item in page["items"]:
            yield (json.dumps(item, sort_keys=True),)
