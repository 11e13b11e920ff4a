"""Fetching at a rate that every host can bear, with sessions, cookies, kept connections and growing pauses.

Rows are dealt to tasks by host, so all requests of a host come from one task, and no number of tasks makes them more frequent. In a task rows
come in turns, the first of each host, then the second, so a host that is waited for holds up no other. Each host has a token bucket: it fills at
`rate` requests a second up to `burst`, and a request takes one token. Requests wait in a heap by the time at which they are due; what failed for now (a
network error, 429, 500, 502, 503, 504) goes back with a pause that doubles, or the one that the server asks for by Retry-After. Any other answer is final, 401
and 403 among them. WAITING requests at most are held at a time.

A task that is repeated after a lost executor starts with empty buckets. It asks again for what the lost attempt had fetched, so keep the result
(checkpoint or a written table) before using it twice.
"""

from __future__ import annotations

import heapq
import http.client
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from email.message import Message
from email.utils import parsedate_to_datetime
from http.cookiejar import CookieJar
from itertools import count
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AGENT = "corpusflow"
#: Answers after which a request is worth another try.
FOR_NOW = (429, 500, 502, 503, 504)
WAITING, CONNECTIONS, REDIRECTS = 1000, 32, 5


@dataclass(frozen=True)
class Politeness:
    """What a host can bear, and how long a request is tried."""

    rate: float = 1.0  #: requests a second and host
    burst: int = 1  #: requests at once after a pause
    attempts: int = 4
    pause: float = 1.0  #: seconds after the first failure, doubled after each further one
    longest: float = 120.0  #: seconds that a pause, or a Retry-After, counts for at most
    timeout: float = 20.0
    most: int = 60_000_000  #: bytes of a body
    warm: str | None = None  #: a path that is asked for once a host before anything else, for its cookies


@dataclass
class Answer:
    status: int | None
    content_type: str | None
    body: bytes | None
    error: str | None = None
    after: float | None = None  #: seconds, from Retry-After

    @property
    def for_now(self) -> bool:
        return self.status in FOR_NOW or self.status is None and self.error is not None and not self.error.startswith("final: ")


def host_of(url: Column) -> Column:
    """Host and port in lower case; an address without one is a host of its own."""
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1), F.lit(""))), F.lit(""))


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or a date."""
    if not value:
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


class Bucket:
    """Tokens of one host."""

    __slots__ = ("rate", "burst", "tokens", "at")

    def __init__(self, rate: float, burst: int, now: float, full: bool = True):
        self.rate, self.burst, self.tokens, self.at = rate, burst, float(burst if full else 0), now

    def take(self, now: float) -> float:
        """0 if a token was taken, else seconds until there is one."""
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens >= 1 - 1e-9:
            self.tokens -= 1
            return 0.0
        return (1 - self.tokens) / self.rate


class Session:
    """Cookies of all hosts, and open connections to those asked last."""

    def __init__(self, limits: Politeness):
        self.limits, self.jar = limits, CookieJar()
        self.open: OrderedDict[tuple[str, str], http.client.HTTPConnection] = OrderedDict()

    def _connection(self, scheme: str, netloc: str) -> http.client.HTTPConnection:
        key = (scheme, netloc)
        if key in self.open:
            self.open.move_to_end(key)
            return self.open[key]
        if scheme not in ("http", "https"):
            raise ValueError(f"final: no address for http: {scheme}")
        kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
        self.open[key] = kind(netloc, timeout=self.limits.timeout)
        if len(self.open) > CONNECTIONS:
            self.open.popitem(last=False)[1].close()
        return self.open[key]

    def _once(self, url: str) -> tuple[http.client.HTTPResponse, bytes]:
        parts = urlsplit(url)
        request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": "*/*"})
        self.jar.add_cookie_header(request)
        connection = self._connection(parts.scheme, parts.netloc.rpartition("@")[2])
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        fresh = connection.sock is None
        try:
            connection.request("GET", path, headers=dict(request.header_items()))
            response = connection.getresponse()
        except (http.client.HTTPException, OSError):
            connection.close()
            if fresh:
                raise
            connection.request("GET", path, headers=dict(request.header_items()))  # the server had closed a kept connection
            response = connection.getresponse()
        try:
            if int(response.headers.get("Content-Length") or 0) > self.limits.most:
                raise ValueError("final: too large")
            body = response.read(self.limits.most + 1)
            if len(body) > self.limits.most:
                raise ValueError("final: too large")
        except BaseException:
            connection.close()
            raise
        self.jar.extract_cookies(_Headers(response.headers), request)
        return response, body

    def get(self, url: str) -> Answer:
        try:
            for _ in range(REDIRECTS + 1):
                response, body = self._once(url)
                if response.status not in (301, 302, 303, 307, 308) or not response.headers.get("Location"):
                    good = response.status < 400
                    return Answer(response.status, response.headers.get("Content-Type", ""), body if good else b"", None, retry_after(response.headers.get("Retry-After")))
                url = urljoin(url, response.headers["Location"])
            return Answer(None, None, None, "final: too many redirects")
        except Exception as e:
            return Answer(None, None, None, str(e) or type(e).__name__)

    def close(self) -> None:
        for connection in self.open.values():
            connection.close()


class _Headers:
    """What a cookie jar needs of a response."""

    def __init__(self, headers: Message):
        self.headers = headers

    def info(self) -> Message:
        return self.headers


def paced(
    requests: Iterable[tuple[str, str, object]], ask: Callable[[str], Answer], limits: Politeness, full: bool = True, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep
) -> Iterator[tuple[object, Answer, int]]:
    """(item, answer, attempts) of requests (host, url, item), each when its host can bear it; WAITING of them are held at most."""
    source, heap, buckets, order, warmed = iter(requests), [], {}, count(), set()
    more = True
    while True:
        while more and len(heap) < WAITING:
            try:
                host, url, item = next(source)
            except StopIteration:
                more = False
                break
            heapq.heappush(heap, (clock(), next(order), host, url, item, 0))
        if not heap:
            return
        due, _, host, url, item, tried = heapq.heappop(heap)
        now = clock()
        if due > now:
            sleep(due - now)
            now = clock()
        if host not in buckets:
            if len(buckets) > 4 * WAITING:  # a bucket that is full again is like a new one
                buckets = {h: b for h, b in buckets.items() if b.tokens + (now - b.at) * b.rate < b.burst}
            buckets[host] = Bucket(limits.rate, limits.burst, now, full)
        wait = buckets[host].take(now)
        if wait > 0:
            heapq.heappush(heap, (now + wait, next(order), host, url, item, tried))
            continue
        if limits.warm is not None and host not in warmed:
            warmed.add(host)
            ask(urljoin(url, limits.warm))
            heapq.heappush(heap, (clock(), next(order), host, url, item, tried))
            continue
        answer = ask(url)
        tried += 1
        if answer.for_now and tried < limits.attempts:
            pause = answer.after if answer.after is not None else limits.pause * 2 ** (tried - 1)
            heapq.heappush(heap, (clock() + min(pause, limits.longest), next(order), host, url, item, tried))
            continue
        yield item, answer, tried


def fetch_politely(urls: DataFrame, url: str = "url", limits: Politeness = Politeness(), parallel: int | None = None, session: Callable[[Politeness], Session] = Session) -> DataFrame:
    """urls with (status, content_type, body, error, attempts), a row for a row; a failure is a row with a null body.

    Null and repeated addresses are asked for as they stand: null gives an error, a repeated one is fetched as often. `parallel` is the number of tasks, and so of hosts asked at
    a time at least; by default that of shuffle partitions.
    """
    schema = StructType([*urls.schema.fields]).add("status", "integer").add("content_type", "string").add("body", "binary").add("error", "string").add("attempts", "integer")
    turn = Window.partitionBy("__host").orderBy(F.xxhash64(url))
    named = urls.withColumn("__host", host_of(F.col(url)))
    named = named.repartition(parallel, "__host") if parallel else named.repartition("__host")
    laid = named.withColumn("__turn", F.row_number().over(turn)).sortWithinPartitions("__turn", "__host").drop("__turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple[str, str, object]]:
            for batch in batches:
                for i in range(len(batch)):
                    row = batch.iloc[i : i + 1]
                    yield row["__host"].iloc[0], row[url].iloc[0] or "", row.drop(columns="__host")

        own = session(limits)
        try:
            for row, a, tried in paced(rows(), own.get, limits, TaskContext.get().attemptNumber() == 0):
                error = a.error.removeprefix("final: ") if a.error else None
                got = pd.DataFrame([(a.status, a.content_type, a.body if a.status is not None else None, error, tried)], columns=["status", "content_type", "body", "error", "attempts"], index=row.index)
                yield pd.concat([row, got.astype(object)], axis=1)
        finally:
            own.close()

    return laid.mapInPandas(run, schema)
