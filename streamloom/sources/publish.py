"""Publishing into a folder that ``json_line_stream`` reads: records, raw payloads and lines of an input.

A file appears under its name when it is whole, so a reader never sees part of
one.  ``python -m streamloom.sources.publish STREAM FOLDER`` publishes the lines
of the standard input.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from collections.abc import Iterable
from itertools import islice


class Publisher:
    """Checks records and writes them to ``folder``, a file for each call of ``flush`` or ``batch`` records."""

    def __init__(self, folder: str, batch: int = 1000) -> None:
        self.folder, self.batch = folder, batch
        self._lines: list[str] = []
        os.makedirs(folder, exist_ok=True)

    def __enter__(self) -> Publisher:
        return self

    def __exit__(self, *_: object) -> None:
        self.flush()

    def submit(self, record: str | dict) -> str:
        """Publish a record; it gets a new id, which is returned, and a low watermark of now.

        One without stream id or time, or of a computation, is a ValueError.
        """
        record = json.loads(record) if isinstance(record, str) else dict(record)
        stream_id = record.get("stream_id")
        if not isinstance(stream_id, str) or not stream_id:
            raise ValueError("a record needs a stream id")
        if "(" in stream_id or ")" in stream_id:
            raise ValueError(f"not a raw stream: {stream_id!r}")
        if not record.get("timestamp"):
            raise ValueError("a record needs a timestamp")
        return self._add(stream_id, record["timestamp"], record.get("data"))

    def submit_raw(self, stream_id: str, data: str) -> str:
        """Publish a payload as a record of now."""
        if not stream_id:
            raise ValueError("a record needs a stream id")
        return self._add(stream_id, time.time_ns(), data)

    def lines(self, stream_id: str, lines: Iterable[str]) -> int:
        """Publish each trimmed line as a payload; returns how many there were."""
        n = 0
        lines = iter(lines)
        while part := list(islice(lines, self.batch)):
            for line in part:
                self.submit_raw(stream_id, line.strip())
            self.flush()
            n += len(part)
        return n

    def flush(self) -> None:
        if self._lines:
            name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
            hidden = os.path.join(self.folder, f".{name}.tmp")
            with open(hidden, "w", encoding="utf-8") as f:
                f.write("\n".join(self._lines) + "\n")
            os.rename(hidden, os.path.join(self.folder, name))
            self._lines = []

    def _add(self, stream_id: str, timestamp: int, data: object) -> str:
        record_id = str(uuid.uuid4())
        record = {"id": record_id, "stream_id": stream_id, "lwm": time.time_ns(), "timestamp": timestamp, "data": data}
        self._lines.append(json.dumps(record))
        if len(self._lines) >= self.batch:
            self.flush()
        return record_id


if __name__ == "__main__":
    _, stream, into = sys.argv
    # one line a file, as they are typed
    Publisher(into, batch=1).lines(stream, sys.stdin)
