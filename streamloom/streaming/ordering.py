"""Rows of a task in order, in bounded memory: sorted runs in temporary files, merged piece by piece."""

from __future__ import annotations

import tempfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes that are sorted in memory at a time, and that the merge reads of each run at a time.
RUN_BYTES = 64 << 20
PIECE_BYTES = 1 << 20


def in_order(tables: Iterable[pa.Table], by: list[str], run_bytes: int = RUN_BYTES, piece_bytes: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """The rows of all ``tables`` by the columns ``by``, nulls last, as tables in that order."""
    order = [(c, "ascending") for c in by]
    parts, size, paths = [], 0, []
    with tempfile.TemporaryDirectory(prefix="runs-") as folder:

        def keep() -> None:
            run = pa.concat_tables(parts).sort_by(order)
            paths.append(f"{folder}/{len(paths)}")
            with pa.OSFile(paths[-1], "wb") as file, pa.ipc.new_stream(file, run.schema) as out:
                out.write_table(run.combine_chunks(), max_chunksize=max(1, len(run) * piece_bytes // max(1, size)))

        for table in tables:
            parts.append(table)
            size += table.nbytes
            if size >= run_bytes:
                keep()
                parts, size = [], 0
        if parts and not paths:
            yield pa.concat_tables(parts).sort_by(order)
        elif paths:
            if parts:
                keep()
                parts = []
            yield from _merged([_pieces(x) for x in paths], by)


def _pieces(path: str) -> Iterator[pa.Table]:
    with pa.OSFile(path) as file:
        for batch in pa.ipc.open_stream(file):
            if batch.num_rows:
                yield pa.Table.from_batches([batch])


def _merged(runs: list[Iterator[pa.Table]], by: list[str]) -> Iterator[pa.Table]:
    """Rows up to the least of the runs' last known rows cannot be preceded by any still unread."""
    heads = [(head, run) for run in runs if (head := next(run, None)) is not None]
    while heads:
        bound = min(_place(head, len(head) - 1, by) for head, _ in heads)
        ready, left = [], []
        for head, run in heads:
            cut = bisect_right(range(len(head)), bound, key=lambda i, head=head: _place(head, i, by))
            ready.append(head.slice(0, cut))
            rest = head.slice(cut) if cut < len(head) else next(run, None)
            if rest is not None:
                left.append((rest, run))
        heads = left
        yield pa.concat_tables(ready).sort_by([(c, "ascending") for c in by])


def _place(table: pa.Table, row: int, by: list[str]) -> tuple:
    values = [table.column(c)[row].as_py() for c in by]
    return tuple((v is None, v) for v in values)
