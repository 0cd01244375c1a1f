"""Source documents, fetched once and kept: one where it is called, or many by the executors, as a data source."""

from __future__ import annotations

import hashlib
import os
import uuid
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds before a request is given up.
TIMEOUT = 90


def fetch(url: str, path: str, force: bool = False) -> str:
    """The text at url, in UTF-8: from the local copy under path, else fetched and put there. An error status is an error and leaves the copy as it is."""
    if os.path.exists(path) and not force:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    with urlopen(Request(url, headers={"User-Agent": "lexgrove"}), timeout=TIMEOUT) as answer:
        text = answer.read().decode("utf-8")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"  # two tasks may fetch one address
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(part, path)
    return text


class Pages(DataSource):
    """url, text of the comma-separated addresses of the option urls, as a source of Spark's: one task fetches one address.

    The option cache names a folder that all executors share; a page that is there is not fetched again, unless the option force is true.
    An address whose fetch fails is an error of the read. A name in the cache follows from the address.
    """

    @classmethod
    def name(cls) -> str:
        return "lexgrove_pages"

    def schema(self) -> str:
        return "url string, text string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u.strip() for u in options.get("urls", "").split(",") if u.strip()]
        self.cache, self.force = options.get("cache"), options.get("force", "false").lower() == "true"
        if not self.cache:
            raise ValueError("the option cache names no folder")

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        url = partition.value
        if url is not None:
            yield url, fetch(url, os.path.join(self.cache, hashlib.sha256(url.encode()).hexdigest()), self.force)


def pages(spark: SparkSession, urls: list[str], cache: str, force: bool = False) -> DataFrame:
    """url, text of addresses without commas, fetched by the executors."""
    if any("," in u for u in urls):
        raise ValueError("an address with a comma must have it written as %2C")
    if not urls:
        return spark.createDataFrame([], "url string, text string")
    spark.dataSource.register(Pages)
    return spark.read.format(Pages.name()).option("urls", ",".join(urls)).option("cache", cache).option("force", str(force).lower()).load()
