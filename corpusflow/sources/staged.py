"""A document-store sink that commits: rows are staged by tasks and made visible once, by the driver.

Each attempt of a task stages its rows under a token of its own and hands the token to the driver when it has ended. The driver promotes the tokens of the attempts
that count, all at once, under the epoch: the query's and the batch's number of a stream, or the option `epoch` of a batch write. A promoted epoch is remembered, so a batch that is repeated after a
failure leaves the store as it is. What a failed attempt has staged is never promoted; when a job fails the tokens that are known are discarded, and sweep() of the store
may drop what is left of lost executors. A document replaces that of its key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

BATCH = 500


class Staging(Protocol):
    """What the sink needs of a store's client, in tasks and on the driver."""

    def stage(self, token: str, rows: list[dict]) -> None:
        """Keep rows under a token, unseen by readers."""

    def promote(self, epoch: str, tokens: list[str], key: str) -> None:
        """In one step: nothing if the epoch was promoted before, else upsert the tokens' rows by key and remember the epoch; drop the tokens."""

    def discard(self, tokens: list[str]) -> None: ...


@dataclass
class Staged(WriterCommitMessage):
    token: str
    rows: int


def _stage(connect: Callable[[], Staging], rows: Iterator) -> Staged:
    store, token, held, n = connect(), uuid.uuid4().hex, [], 0
    try:
        for row in rows:
            held.append(row.asDict(recursive=True))
            n += 1
            if len(held) == BATCH:
                store.stage(token, held)
                held = []
        if held:
            store.stage(token, held)
    except BaseException:
        store.discard([token])
        raise
    return Staged(token, n)


def _tokens(messages: list) -> list[str]:
    return [m.token for m in messages if m is not None]


class _Batch(DataSourceWriter):
    def __init__(self, connect: Callable[[], Staging], key: str, epoch: str):
        self.connect, self.key, self.epoch = connect, key, epoch

    def write(self, iterator) -> Staged:
        return _stage(self.connect, iterator)

    def commit(self, messages) -> None:
        self.connect().promote(self.epoch, _tokens(messages), self.key)

    def abort(self, messages) -> None:
        self.connect().discard(_tokens(messages))


class _Stream(DataSourceStreamWriter):
    def __init__(self, connect: Callable[[], Staging], key: str, query: str):
        self.connect, self.key, self.query = connect, key, query

    def write(self, iterator) -> Staged:
        return _stage(self.connect, iterator)

    def commit(self, messages, batchId: int) -> None:
        self.connect().promote(f"{self.query}:{batchId}", _tokens(messages), self.key)

    def abort(self, messages, batchId: int) -> None:
        self.connect().discard(_tokens(messages))


def staged_sink(connect: Callable[[], Staging], key: str, label: str = "staged") -> type[DataSource]:
    """A sink class to register. Options: `epoch` of a batch write (else each write is one of its own), `query`, the name of a stream whose batches are numbered (else its checkpoint's folder)."""

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def _checked(self, schema) -> None:
            if key not in schema.names:
                raise ValueError(f"no column {key}")

        def writer(self, schema, overwrite) -> DataSourceWriter:
            self._checked(schema)
            return _Batch(connect, key, self.options.get("epoch") or uuid.uuid4().hex)

        def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:
            self._checked(schema)
            query = self.options.get("query") or self.options.get("checkpointLocation")
            if not query:
                raise ValueError("a stream needs the option query or checkpointLocation")
            return _Stream(connect, key, query)

    return Sink
