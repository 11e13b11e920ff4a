"""Sources and sinks for web pages, search services and document stores, as Python data sources.

What talks to the network is a callable that the caller registers; nothing here needs a network to be tested. Fetching names itself plainly,
treats 401 and 403 as final, and keeps to limits of size and time.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.acquire import SNIFF_BYTES
from .polite import AGENT, Politeness, Session, paced


def get(url: str, timeout: float = 20, attempts: int = 3, pause: float = 1.0, most: int = 60_000_000, cut: bool = False) -> tuple[int, str, bytes]:
    """(status, content type, body) of a URL; network errors are tried again, answers of the server are final.

    A body beyond `most` bytes is an error, before it is read if its length is declared; with `cut` its first `most` bytes are the body.
    """
    for i in range(attempts):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
                declared = r.headers.get("Content-Length") or ""
                if not cut and declared.isdigit() and int(declared) > most:
                    raise ValueError("too large")
                body = r.read(most if cut else most + 1)
                if len(body) > most:
                    raise ValueError("too large")
                return r.status, r.headers.get("Content-Type", ""), body
        except urllib.error.HTTPError as e:
            return e.code, "", b""
        except OSError:
            if i + 1 == attempts:
                raise
            time.sleep(pause)
    raise OSError("no attempt")


class Store(Protocol):
    """What open_store() needs of a document store's client."""

    def ping(self) -> object: ...

    def unique_index(self, key: str) -> object: ...


def peek(url: str) -> tuple[int, str, bytes]:
    """As get(), but reading stops after the part in which links to documents are looked for."""
    return get(url, most=SNIFF_BYTES, cut=True)


def _post(url: str, payload: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", "User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


def completer(url: str, model: str, timeout: float = 240, attempts: int = 3, pause: float = 3, options: dict | None = None, post: Callable[[str, dict, float], dict] = _post) -> Callable[[Iterable[str]], list[str]]:
    """A completer for operators.generate that posts each prompt to a local model service and takes `response` of its answer.

    An error is tried again after `pause` seconds, an empty reply is not; what fails `attempts` times is ''.
    """
    options = {"temperature": 0.7, "num_predict": 1500} if options is None else options

    def one(prompt: str) -> str:
        for i in range(attempts):
            try:
                return (post(url, {"model": model, "prompt": prompt, "stream": False, "options": options}, timeout).get("response") or "").strip()
            except Exception:
                if i + 1 < attempts:
                    time.sleep(pause)
        return ""

    return lambda prompts: [one(p) for p in prompts]


def fetch_pages(urls: DataFrame, url: str = "url", fetch: Callable[[str], tuple[int, str, bytes]] = get, parallel: int | None = None) -> DataFrame:
    """urls with (status, content_type, body, error); a failure is a row with a null body."""
    schema = StructType([*urls.schema.fields]).add("status", "integer").add("content_type", "string").add("body", "binary").add("error", "string")

    def one(u: str) -> tuple:
        try:
            return (*fetch(u), None)
        except Exception as e:
            return None, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):  # a body can be large: it is handed over before the next is fetched
                row = batch.iloc[i : i + 1]
                got = pd.DataFrame([one(row[url].iloc[0])], columns=["status", "content_type", "body", "error"], index=row.index)
                yield pd.concat([row, got.astype(object)], axis=1)

    laid = urls.repartition(parallel, F.col(url)) if parallel else urls
    return laid.mapInPandas(run, schema)


def search(names: DataFrame, name: str, ask: Callable[[str], list[dict]], most: int = 15, pause: float = 0.0, parallel: int = 1) -> DataFrame:
    """(name, rank, url) of an injected search service; an error gives no results.

    With a `pause` the service, which is one host, is asked once in so many seconds at most: by `parallel` tasks, each of which waits so many times as long.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = time.monotonic() + (pause * TaskContext.get().partitionId() if pause else 0)
        for batch in batches:
            for n in batch[name]:
                if pause:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + pause * parallel
                try:
                    found = ask(n)[:most]
                except Exception:
                    found = []
                rows = [(n, i, x.get("href") or x.get("url") or "") for i, x in enumerate(found)]
                yield pd.DataFrame(rows, columns=[name, "rank", "url"])

    laid = names.select(name).repartition(parallel) if pause else names.select(name)
    return laid.mapInPandas(run, f"{name} string, rank int, url string")


class PageSource(DataSource):
    """spark.read.format("pages").option("urls", "<one a line>"): (url, status, body).

    Addresses are grouped by host into `tasks` partitions (8), each with one session, and a host is asked `rate` times a second (1) at most.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, status int, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u.strip() for u in options.get("urls", "").split("\n") if u.strip()]
        self.tasks = int(options.get("tasks", 8))
        self.limits = Politeness(rate=float(options.get("rate", 1)), timeout=float(options.get("timeout", 20)), attempts=int(options.get("attempts", 4)))

    def partitions(self):
        groups: dict[int, list[tuple[str, str]]] = {}
        for u in self.urls:
            host = urlsplit(u).netloc.lower()
            groups.setdefault(zlib.crc32(host.encode()) % self.tasks, []).append((host, u))
        return [InputPartition(g) for _, g in sorted(groups.items())]

    def read(self, partition):
        session = Session(self.limits)
        try:
            for url, a, _ in paced(((host, u, u) for host, u in partition.value), session.get, self.limits):
                yield url, a.status, a.body if a.status is not None else None
        finally:
            session.close()


def open_store(uri: str, connect: Callable[[str], Store], key: str) -> Store | None:
    """A connected document store with a unique index on `key`; None without an address or if the store can't be reached."""
    if not uri:
        return None
    try:
        store = connect(uri)
        store.ping()
        store.unique_index(key)
    except Exception:
        return None
    return store


def store_sink(upsert: Callable[[list[dict]], int], key: str, label: str = "store") -> type[DataSource]:
    """A sink class to register: upsert() gets rows as dicts, in batches, and must be idempotent for a key."""

    class Writer(DataSourceWriter):
        def write(self, rows) -> WriterCommitMessage:
            held: list[dict] = []
            for row in rows:
                held.append(row.asDict(recursive=True))
                if len(held) == 500:
                    upsert(held)
                    held = []
            if held:
                upsert(held)
            return WriterCommitMessage()

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def writer(self, schema, overwrite) -> DataSourceWriter:
            if key not in schema.names:
                raise ValueError(f"no column {key}")
            return Writer()

    return Sink
