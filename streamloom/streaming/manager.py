"""Demand-driven queries: the first subscriber of an expression starts its query, the last one stops it."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans.compiler import Compiler, canonical
from ..sinks import render
from ..sources.readers import in_range

Listener = Callable[[DataFrame, int], None]
Token = tuple[str, int]


class Disconnected(Exception):
    """Raised by a listener that wants no more batches."""


class LateRecord(Exception):
    """A record came behind the watermark of a strict query."""


@dataclass
class _Running:
    query: StreamingQuery
    listeners: dict[int, Listener] = field(default_factory=dict)


class Manager:
    """Runs one query for each canonical expression and start over a live source.

    With ``strict`` a late record ends its query, and an alarm's input that is no
    number too; ``failures`` has the errors.  Without it late records are dropped
    and counted by ``Metrics``.
    """

    def __init__(
        self, source: DataFrame, checkpoints: str, watermark: str = "0 seconds", strict: bool = False, **trigger
    ) -> None:
        self.source, self.checkpoints, self.watermark, self.trigger = source, checkpoints, watermark, trigger
        self.strict = strict
        self.failures: dict[str, Exception] = {}
        self._running: dict[str, _Running] = {}
        self._lock = threading.Lock()
        self._next = 0
        self._guard = _Guard(self) if strict else None
        if self._guard:
            source.sparkSession.streams.addListener(self._guard)

    def subscribe(self, expression: str, listener: Listener, start_ns: int | None = None) -> Token:
        """Hand each batch of the expression's records to ``listener``; returns the token for ``unsubscribe``.

        ``start_ns`` leaves out source records before that time; over a log that
        is read from its beginning this is a rewind to it.
        """
        text = canonical(expression)
        name = text if start_ns is None else f"{text} from {start_ns}"
        with self._lock:
            self._next += 1
            token = (name, self._next)
            running = self._running.get(name)
            if running is None:
                listeners = {self._next: listener}
                self._running[name] = _Running(self._start(text, name, listeners, start_ns), listeners)
            else:
                running.listeners[self._next] = listener
            return token

    def listen(self, expression: str, out: TextIO, data_only: bool = False, start_ns: int | None = None) -> Token:
        """Write each record as a line to ``out``, flushed after every batch, until ``out`` is closed or broken."""
        if not expression.strip():
            raise ValueError("a listener needs a stream id")

        def write(batch: DataFrame, number: int) -> None:
            try:
                for row in render(batch, data_only).toLocalIterator():
                    out.write(f"{row[0]}\n")
                out.flush()
            except (OSError, ValueError) as e:  # a pipe that broke, a file that was closed
                raise Disconnected from e

        return self.subscribe(expression, write, start_ns)

    def unsubscribe(self, token: Token) -> None:
        name, number = token
        with self._lock:
            running = self._running.get(name)
            if running is None or running.listeners.pop(number, None) is None or running.listeners:
                return
            del self._running[name]
        running.query.stop()

    def fail(self, query_id: str, error: Exception) -> None:
        """End the query with this id and note the error."""
        with self._lock:
            names = [n for n, r in self._running.items() if str(r.query.id) == query_id]
            ended = [self._running.pop(n).query for n in names]
            self.failures.update(dict.fromkeys(names, error))
        for query in ended:
            query.stop()

    def active(self) -> dict[str, int]:
        """Subscribers of each running expression."""
        with self._lock:
            return {name: len(r.listeners) for name, r in self._running.items()}

    def await_batches(self) -> None:
        """Until all that is available now has been handled."""
        for running in list(self._running.values()):
            running.query.processAllAvailable()

    def stop(self) -> None:
        with self._lock:
            queries, self._running = [r.query for r in self._running.values()], {}
        for query in queries:
            query.stop()
        if self._guard:
            self.source.sparkSession.streams.removeListener(self._guard)
            self._guard = None

    def _start(self, text: str, name: str, listeners: dict[int, Listener], start_ns: int | None) -> StreamingQuery:
        source = in_range(self.source, start_ns)
        records = Compiler(source, strict=self.strict, watermark=self.watermark).compile(text)

        def each(batch: DataFrame, number: int) -> None:
            batch.persist()
            try:
                for who, listener in list(listeners.items()):
                    try:
                        listener(batch, number)
                    except Disconnected:
                        # a query cannot stop itself from inside a batch
                        threading.Thread(target=self.unsubscribe, args=((name, who),), daemon=True).start()
            finally:
                batch.unpersist()

        # the same expression finds its position and state again after a restart
        folder = f"{self.checkpoints}/{hashlib.sha256(name.encode()).hexdigest()[:32]}"
        writer = records.writeStream.foreachBatch(each).option("checkpointLocation", folder)
        return (writer.trigger(**self.trigger) if self.trigger else writer).start()


def _late_rows(event) -> int:
    return sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)


class _Guard(StreamingQueryListener):
    """Ends a strict manager's query that has dropped a late record."""

    def __init__(self, manager: Manager) -> None:
        self.manager = manager

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if n := _late_rows(event):
            error = LateRecord(f"{n} records came behind the watermark")
            threading.Thread(target=self.manager.fail, args=(str(event.progress.id), error), daemon=True).start()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Metrics(StreamingQueryListener):
    """Counts rows and late rows of all queries of a session."""

    def __init__(self) -> None:
        self.processed, self.late = 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.processed += event.progress.numInputRows
        self.late += _late_rows(event)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
