"""Fetching: a data source whose partitions are requests, for batches and for streams.

The transport is a seam: anything that takes (url, headers, body, timeout) and returns (status, text). An answer
is null where the call failed in any way or its status isn't 200; the connectors read nothing from it. A stream
asks all requests once in each time slot; its offsets are the numbers of the slots.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siftwire.config import PipelineConfig

Transport = Callable[[str, dict[str, str], str | None, float], tuple[int, str]]
#: (source, seq, name, part, url, headers, body).
Request = tuple[str, int, str, str, str, dict[str, str], str | None]
ANSWER = "slot long, source string, seq long, name string, part string, answer string"
TIMEOUT = 15.0
AGENT = "siftwire"
#: Seconds of a stream's time slots.
INTERVAL = 30.0
# Addresses and the query that the services understand.
CODE_HOST = "https://api.github.com"
PARTS = {
    "releases": "/repos/{repo}/releases?per_page=10",
    "pulls": "/repos/{repo}/pulls?state=closed&sort=updated&direction=desc&per_page=10",
    "issues": "/repos/{repo}/issues?state=all&sort=updated&direction=desc&per_page=10",
}
TRACKER = "https://api.linear.app/graphql"
TRACKER_QUERY = "{ issues(first: 30, orderBy: updatedAt) { nodes { identifier title url description updatedAt } } }"


def http(url: str, headers: dict[str, str], body: str | None, timeout: float) -> tuple[int, str]:
    """GET, or POST with a body."""
    request = urllib.request.Request(url, body.encode() if body is not None else None, headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, ""


def code_host_requests(repos: Sequence[str], token: str = "") -> list[Request]:
    """Three for each repository with a name. A token is sent if there is one."""
    headers = {"Accept": "application/vnd.github+json", "User-Agent": AGENT} | ({"Authorization": f"Bearer {token}"} if token else {})
    path = lambda text, repo: CODE_HOST + text.format(repo=urllib.parse.quote(repo, safe="/"))
    return [("github", i, repo, part, path(text, repo), headers, None) for i, repo in enumerate(repos) if repo for part, text in PARTS.items()]


def tracker_requests(token: str) -> list[Request]:
    """One; without a token nothing is called."""
    headers = {"Authorization": token, "Content-Type": "application/json"}
    return [("linear", 0, "", "", TRACKER, headers, json.dumps({"query": TRACKER_QUERY}))] if token else []


def feed_requests(feeds: Sequence[str]) -> list[Request]:
    """One for each address that isn't empty."""
    return [("feed", i, "", "", url, {"User-Agent": AGENT}, None) for i, url in enumerate(feeds) if url]


def requests(config: PipelineConfig) -> list[Request]:
    """All that one collection asks."""
    return [*code_host_requests(config.repos, config.code_host_token), *tracker_requests(config.tracker_token), *feed_requests(config.feeds)]


class _Asked(InputPartition):
    def __init__(self, slot: int, request: Request):
        self.slot, self.request = slot, request


def _read(transport: Transport, asked: _Asked | None) -> Iterator[tuple]:
    if asked is None:  # a read without partitions
        return
    source, seq, name, part, url, headers, body = asked.request
    try:
        status, text = transport(url, dict(headers), body, TIMEOUT)
    except Exception:  # noqa: BLE001  whatever a service or an address does, it costs only its own answer
        status, text = 0, ""
    yield (asked.slot, source, seq, name, part, text if status == 200 else None)


class _Reader(DataSourceReader):
    def __init__(self, asked: list[Request], transport: Transport):
        self.asked, self.transport = asked, transport

    def partitions(self) -> list[InputPartition]:
        return [_Asked(0, r) for r in self.asked]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.transport, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, asked: list[Request], transport: Transport, clock: Callable[[], float], interval: float):
        self.asked, self.transport, self.clock, self.interval = asked, transport, clock, interval

    def initialOffset(self) -> dict:
        return {"slot": 0}

    def latestOffset(self) -> dict:
        return {"slot": int(self.clock() // self.interval)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Slots that went by without a read aren't made up for: the newest answers hold what they would have."""
        return [_Asked(end["slot"], r) for r in self.asked] if end["slot"] > start["slot"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.transport, partition)


def data_source(asked: list[Request], transport: Transport = http, clock: Callable[[], float] = time.time, interval: float = INTERVAL) -> type[DataSource]:
    """A source of ANSWER rows, each request a partition of its own, so that slow services don't wait for each other."""

    class Requests(DataSource):
        @classmethod
        def name(cls) -> str:
            return "siftwire_requests"

        def schema(self) -> str:
            return ANSWER

        def reader(self, schema) -> DataSourceReader:
            return _Reader(asked, transport)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(asked, transport, clock, interval)

    return Requests


def answers(spark: SparkSession, asked: list[Request], transport: Transport = http) -> DataFrame:
    """ANSWER rows of each request; failures are null, never an error."""
    if not asked:
        return spark.createDataFrame([], ANSWER)
    spark.dataSource.register(data_source(asked, transport))
    return spark.read.format("siftwire_requests").load()


def answer_stream(spark: SparkSession, asked: list[Request], transport: Transport = http, clock: Callable[[], float] = time.time, interval: float = INTERVAL) -> DataFrame:
    """ANSWER rows of every slot."""
    spark.dataSource.register(data_source(asked, transport, clock, interval))
    return spark.readStream.format("siftwire_requests").load()


def by_repository(rows: DataFrame) -> DataFrame:
    """(seq, repo, releases, pulls, issues) of the code host's answers."""
    own = rows.where("source = 'github'")
    return own.groupBy("seq", F.col("name").alias("repo")).agg(*(F.max(F.when(F.col("part") == p, F.col("answer"))).alias(p) for p in PARTS))


def code_host_answers(spark: SparkSession, repos: Sequence[str], token: str = "", transport: Transport = http) -> DataFrame:
    return by_repository(answers(spark, code_host_requests(repos, token), transport))


def tracker_answers(spark: SparkSession, token: str, transport: Transport = http) -> DataFrame:
    return answers(spark, tracker_requests(token), transport).select("seq", "answer")


def feed_answers(spark: SparkSession, feeds: Sequence[str], transport: Transport = http) -> DataFrame:
    return answers(spark, feed_requests(feeds), transport).select("seq", "answer")
