"""Landed pages of services that page by a token or an offset, as a Spark data source.

A landing has one folder for each query, and in it one JSON file for each page: the first is first.json, the next is named by the token
of the page before (nextPageToken) or, where pages carry none, by the page's number (1.json, 2.json ...). Each query is one
partition, as its pages name one another; queries are read side by side. A chain ends with a page that names no successor, that holds no
rows or an error, that names a page seen before, or whose successor did not land. The folder is on a file system that executors
mount.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "landed_pages"
#: How a chain ended: what the last page's `ended` says; null on the others.
ENDS = ("last", "empty", "error", "loop", "missing")


class QueryFolder(InputPartition):
    def __init__(self, folder: str, query: str):
        self.folder, self.query = folder, query


def rows_in(page: dict) -> int:
    """The rows of a page: studies, results or patents, or an association page's rows."""
    for name in ("studies", "results", "patents"):
        if name in page:
            return len(page[name] or ())
    try:
        return len(page["data"]["disease"]["associatedTargets"]["rows"] or ())
    except (KeyError, TypeError):
        return 0


def chain(folder: str) -> Iterator[tuple[int, str, str | None]]:
    """(place, page as it landed, how the chain ended, if here) along a query's pages. A page that is no JSON is an error's."""
    name, seen, place = "first", set(), 0
    while True:
        path = os.path.join(folder, f"{name}.json")
        seen.add(name)
        with open(path, encoding="utf-8") as file:
            body = file.read()
        try:
            page = json.loads(body)
            fine = isinstance(page, dict)
        except ValueError:
            page, fine = {}, False
        ended = None
        if not fine or page.get("errors"):
            ended = "error"
        elif not rows_in(page):
            ended = "empty"
        else:
            token = page.get("nextPageToken")
            by_number = "nextPageToken" not in page and os.path.exists(os.path.join(folder, f"{place + 1}.json"))
            name = str(token) if token else str(place + 1) if by_number else None
            if name is None:
                ended = "last"
            elif name in seen:
                ended = "loop"
            elif os.sep in name or not os.path.exists(os.path.join(folder, f"{name}.json")):
                ended = "missing"
        yield place, body, ended
        if ended:
            return
        place += 1


class PagesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        found = sorted(e.name for e in os.scandir(self.path) if e.is_dir() and os.path.exists(os.path.join(e.path, "first.json")))
        return [QueryFolder(os.path.join(self.path, name), name) for name in found]

    def read(self, partition):
        if partition is not None:  # an empty landing has one partition, None
            for place, body, ended in chain(partition.folder):
                yield partition.query, place, body, ended


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "query string, page int, body string, ended string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options["path"])


def pages(spark: SparkSession, path: str) -> DataFrame:
    """query, page (from 0), body (JSON) and, on a chain's last page, how it ended."""
    spark.dataSource.register(LandedPages)
    return spark.read.format(FORMAT).option("path", path).load()
