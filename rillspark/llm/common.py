"""What several text operators share: words, Arrow batches and sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lowered, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is just that rule.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most_bytes`` at most.

    Bounds the memory of a step that makes many values of each text; one text is never cut.
    """
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        n, size = b.num_rows, col.nbytes
        if size <= most_bytes or n < 2:
            if n:
                yield b
            continue
        import pyarrow.compute as pc

        lens = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i in range(n):
            if total and total + lens[i] > most_bytes:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += lens[i]
        yield b.slice(at, n - at)
