"""Reading vectors in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None where it is null, empty, zero or holds null or non-finite parts."""
    out: list[np.ndarray | None] = []
    for x in column:
        values = None if not x.is_valid or not len(x.values) or x.values.null_count else x.values
        v = None if values is None else values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v if v is not None and np.isfinite(v).all() and v.any() else None)
    return out
