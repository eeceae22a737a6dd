"""Literature as a data source: spark.read.format("literature") searches a service and gives its articles as rows.

The service is a transport that the caller registers by name: a function from a search text to an XML answer. A partition is some of the searches; one that fails, or takes longer
than its time limit, gives no rows, and the others go on. Options: searches (a JSON list of search texts), transport, partitions, timeout (seconds).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "search string, position int, xml string"
#: Seconds that a search may take.
TIMEOUT = 8.0


class Searches(InputPartition):
    def __init__(self, texts: list[tuple[int, str]]):
        super().__init__(None)
        self.texts = texts


class LiteratureReader(DataSourceReader):
    def __init__(self, options: dict[str, str], transports: dict[str, Callable[[str], str]]):
        name = options.get("transport", "default")
        if name not in transports:
            raise ValueError(f"no transport is registered as {name}")
        self.transport, self.timeout = transports[name], float(options.get("timeout", TIMEOUT))
        self.searches, self.n = json.loads(options.get("searches", "[]")), int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        numbered = list(enumerate(self.searches))
        return [Searches(part) for k in range(self.n) if (part := numbered[k :: self.n])] or [Searches([])]

    def read(self, partition: Searches) -> Iterator[tuple]:
        for _, text in partition.texts:
            pool = ThreadPoolExecutor(1)
            try:
                answer = pool.submit(self.transport, text).result(self.timeout)
                found = [ElementTree.tostring(x, encoding="unicode") for x in ElementTree.fromstring(answer).iter("PubmedArticle")]
            except Exception:  # noqa: BLE001 (a search without an answer has no articles)
                found = []
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
            yield from ((text, k, xml.strip()) for k, xml in enumerate(found))


def register(spark: SparkSession, transports: dict[str, Callable[[str], str]], name: str = "literature") -> None:
    """Makes the format known to a session, with the transports that its readers may name."""

    class Literature(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return LiteratureReader(dict(self.options), transports)

    spark.dataSource.register(Literature)


def search(spark: SparkSession, texts: list[str], transport: str = "default", timeout: float = TIMEOUT, partitions: int = 8, name: str = "literature"):
    """The articles of a stated list of searches, each search once: search, position and the article's XML."""
    options = {"searches": json.dumps(list(dict.fromkeys(texts))), "transport": transport, "timeout": str(timeout), "partitions": str(partitions)}
    return spark.read.format(name).options(**options).load()
