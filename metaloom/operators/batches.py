"""Rows of Arrow batches in small pieces, for Python steps that make many rows of one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text that a piece has at most; a longer text is a piece of its own.
ROWS, BYTES = 256, 1 << 21


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut where a piece is full: what is made of a piece at once stays small, however many rows
    Spark puts into a batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start == ROWS or held + size > BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
