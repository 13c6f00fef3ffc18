"""A paged REST collection as a batch source: spark.read.format("paged_rest").

The service answers GET url?page=P&size=S&... with a JSON object that holds a list of items and the number of pages. One
request at planning time asks for the number of pages; each task then reads a range of pages of its own, so no page is read
by two tasks. A request that fails is repeated, and a task that fails is run again by Spark as a whole, so its pages appear
once. Filters of equality and of lower and upper bounds go to the service as parameters, as far as `pushed` names their
columns; Spark checks all of them again on the rows.

Options: url; schema of the items (DDL, given to the reader); size (rows a page, 100); partitions (8); param.X (a fixed
parameter X); pushed (columns, by comma; a bound asks for column__gte and so on); items and pages (names in the answer);
retries (3) and timeout (seconds, 30). A page that is missing or not an object with items fails the query: no row is left
out silently.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql import types as T

#: How the service spells comparisons.
SPELLING = {EqualTo: "", GreaterThan: "__gt", GreaterThanOrEqual: "__gte", LessThan: "__lt", LessThanOrEqual: "__lte"}


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def _value(x, kind: T.DataType):
    """An item's value as Spark takes it; what is missing is null."""
    if x is None:
        return None
    if isinstance(kind, T.DoubleType | T.FloatType):
        return float(x)
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(x[:10])
    if isinstance(kind, T.TimestampType):
        return dt.datetime.fromisoformat(x)
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x)
    if isinstance(kind, T.StructType):
        return tuple(_value(x.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_value(y, kind.elementType) for y in x]
    return x


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        get = lambda name, default: options.get(name, default)
        self.url, self.size, self.parts = options["url"], int(get("size", "100")), int(get("partitions", "8"))
        self.items, self.pages, self.retries, self.timeout = get("items", "items"), get("pages", "pages"), int(get("retries", "3")), float(get("timeout", "30"))
        self.may_push = {x.strip() for x in get("pushed", "").split(",")} - {""}
        self.params = {k.removeprefix("param."): v for k, v in options.items() if k.startswith("param.")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            ends = SPELLING.get(type(f))
            if ends is not None and f.attribute[0] in self.may_push and len(f.attribute) == 1:
                # Of two filters with one name the service sees the first; Spark checks both.
                self.params.setdefault(f.attribute[0] + ends, str(f.value))
            yield f

    def page(self, number: int) -> dict:
        query = urllib.parse.urlencode({**self.params, "page": number, "size": self.size})
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(f"{self.url}?{query}", timeout=self.timeout) as answer:
                    body = json.load(answer)
                if not isinstance(body.get(self.items), list):
                    raise ValueError(f"page {number} has no list {self.items}")
                return body
            except (OSError, ValueError) as e:
                if not left or isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429:
                    raise
                time.sleep(0.2 * 2 ** (self.retries - left))
        raise AssertionError

    def partitions(self) -> list[Pages]:
        pages = int(self.page(1).get(self.pages) or 1)
        each = -(-pages // max(1, self.parts))
        return [Pages(a, min(a + each - 1, pages)) for a in range(1, pages + 1, each)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for number in range(partition.first, partition.last + 1):
            for item in self.page(number)[self.items]:
                yield tuple(_value(item.get(f.name), f.dataType) for f in self.schema.fields)


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach sources of this kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRest)
