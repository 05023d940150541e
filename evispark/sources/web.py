"""Pages over HTTP as a Spark data source: ``spark.read.format("web_pages")``.

Options: ``urls`` (separated by white space), ``retries``, ``backoff`` and ``timeout`` (seconds),
``throttle`` (seconds between requests to one host), ``robots`` (true: ask robots.txt). A partition holds
the addresses of whole hosts, so requests to a host follow one another with the pause between them. A page that
can't be had is a row with its error; nothing is fetched before the table is read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "requested_url string, url string, status int, content_type string, html string, error string, attempts int"
#: Answers that are asked for again.
TRANSIENT = (429, 503)


@dataclass
class Hosts(InputPartition):
    urls: list[str]


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = options.get("urls", "").split()
        self.retries, self.backoff = int(options.get("retries", 2)), float(options.get("backoff", 0.6))
        self.timeout, self.pause = float(options.get("timeout", 15)), float(options.get("throttle", 0.15))
        self.robots, self.tasks = options.get("robots", "false").lower() == "true", int(options.get("tasks", 8))

    def partitions(self) -> list[Hosts]:
        import zlib
        from urllib.parse import urlparse

        parts: dict[int, list[str]] = {}
        for url in dict.fromkeys(self.urls):
            parts.setdefault(zlib.crc32(urlparse(url).netloc.lower().encode()) % self.tasks, []).append(url)
        return [Hosts(sorted(urls)) for _, urls in sorted(parts.items())] or [Hosts([])]

    def _allowed(self, url: str) -> bool:
        from urllib.parse import urlparse
        from urllib.robotparser import RobotFileParser

        if not self.robots:
            return True
        rules = RobotFileParser("{0.scheme}://{0.netloc}/robots.txt".format(urlparse(url)))
        try:
            rules.read()
        except OSError:
            return True
        return rules.can_fetch("evispark", url)

    def _fetch(self, url: str) -> tuple:
        import time
        from urllib.error import HTTPError
        from urllib.request import urlopen

        if not self._allowed(url):
            return url, None, None, None, None, "blocked by robots.txt", 0
        status, error = None, None
        for attempt in range(self.retries + 1):
            if attempt:
                time.sleep(self.backoff * 2 ** (attempt - 1))
            try:
                with urlopen(url, timeout=self.timeout) as got:  # noqa: S310
                    body = got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")
                    return url, got.geturl(), got.status, got.headers.get_content_type(), body, None, attempt + 1
            except HTTPError as e:
                status, error = e.code, str(e)
                if e.code not in TRANSIENT:
                    break
            except (OSError, ValueError) as e:
                status, error = None, str(e)
        return url, None, status, None, None, error, attempt + 1

    def read(self, partition: Hosts) -> Iterator[tuple]:
        import time
        from urllib.parse import urlparse

        last: dict[str, float] = {}
        for url in partition.urls:
            host = urlparse(url).netloc.lower()
            time.sleep(max(0.0, last.get(host, 0.0) + self.pause - time.monotonic()))
            yield self._fetch(url)
            last[host] = time.monotonic()


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
