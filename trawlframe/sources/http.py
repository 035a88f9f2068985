"""Live fetching: a reader for a list of URLs, and a fetcher for a frontier. Python, since Spark has no HTTP client."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.retry import RetryConfig, retry

#: Fixed defaults of the client.
TIMEOUT, USER_AGENT = 30.0, "Mozilla/5.0 (Linux; Android 8.0.0; SM-G955U Build/R16NW)"
MAX_FILE_SIZE = 64 << 20
SCHEMA = "url string, status int, content binary, skipped_on string, error string"


class TooLarge(Exception):
    pass


class Client:
    """GET and HEAD with a time limit and a user agent; one opener serves a whole partition."""

    def __init__(self, timeout: float = TIMEOUT, user_agent: str = USER_AGENT, max_file_size: int = MAX_FILE_SIZE):
        self.timeout, self.agent, self.limit = timeout, user_agent, max_file_size
        self.opener = urllib.request.build_opener()

    def _open(self, url: str, method: str):
        return self.opener.open(urllib.request.Request(url, method=method, headers={"User-Agent": self.agent}), timeout=self.timeout)

    def head(self, url: str) -> dict[str, str]:
        """Headers in lower case; the status is not looked at."""
        try:
            with self._open(url, "HEAD") as answer:
                return {k.lower(): v for k, v in answer.headers.items()}
        except urllib.error.HTTPError as e:
            return {k.lower(): v for k, v in e.headers.items()}

    def get(self, url: str) -> bytes:
        """The body of an answer with status 200, at most the size limit; anything else is an error."""
        with self._open(url, "GET") as answer:
            if answer.status != 200:
                raise urllib.error.HTTPError(url, answer.status, "status", answer.headers, None)
            body = answer.read(self.limit + 1)
        if len(body) > self.limit:
            raise TooLarge(f"{url}: more than {self.limit} bytes")
        return body

    def download(self, url: str) -> bytes:
        """HEAD, the size guard (an unreadable length passes), then GET."""
        length = self.head(url).get("content-length", "")
        if length.isdigit() and int(length) > self.limit:
            raise TooLarge(f"{url}: {length} bytes")
        return self.get(url)


def fetch_one(client: Client, url: str, config: RetryConfig) -> tuple:
    """A row of SCHEMA; a failure is a row too, skipped at 'download'."""
    try:
        return url, 200, retry(lambda: client.download(url), config), None, None
    except Exception as e:
        return url, getattr(e, "code", None), None, "download", f"{type(e).__name__}: {e}"


def fetch_live(frontier: DataFrame, workers: int = 10, timeout: float = TIMEOUT, user_agent: str = USER_AGENT, max_file_size: int = MAX_FILE_SIZE, config: RetryConfig | None = None) -> DataFrame:
    """Fetch the URLs of a frontier in `workers` partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(timeout, user_agent, max_file_size)
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string()]
        for batch in batches:
            for url in batch.column(0).to_pylist():  # one body at a time
                row = fetch_one(client, url, config or RetryConfig())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["url", "status", "content", "skipped_on", "error"])

    return frontier.select("url").repartition(workers, "url").mapInArrow(run, SCHEMA)


class UrlPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class SiteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", options.get("path", "")).split("\n") if u]
        self.workers = int(options.get("workers", "10"))
        self.client = (float(options.get("timeout", TIMEOUT)), options.get("userAgent", USER_AGENT), int(options.get("maxFileSize", MAX_FILE_SIZE)))
        self.config = RetryConfig(max_attempts=int(options.get("attempts", "3")), delay=float(options.get("delay", "1")))

    def partitions(self):
        return [UrlPartition(self.urls[i :: self.workers]) for i in range(min(self.workers, len(self.urls)))] or [UrlPartition([])]

    def read(self, partition):
        client = Client(*self.client)
        for url in partition.urls:
            yield fetch_one(client, url, self.config)


class SiteSource(DataSource):
    """spark.read.format('site').option('urls', newline-separated).load(); options timeout, userAgent, maxFileSize, workers, attempts, delay."""

    @classmethod
    def name(cls):
        return "site"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SiteReader(self.options)
