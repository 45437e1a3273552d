"""Arrow batches in pieces of bounded size, so that long texts don't become Python strings all at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a piece, about.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, text_at: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``size`` bytes of text (or values of lists) in a column, one row at least."""
    column = batch.column(text_at)
    lengths = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
