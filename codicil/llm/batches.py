"""Cutting Arrow batches by the size of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_size(batch: pa.RecordBatch, column: str, max_bytes: int = 4_000_000, max_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``max_rows`` rows and about ``max_bytes`` of text; a larger text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total, start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
    while start < batch.num_rows:
        end = int(np.searchsorted(total, total[start] + max_bytes, "right")) - 1
        end = min(max(end, start + 1), start + max_rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
