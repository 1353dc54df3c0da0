"""Arrow batches in slices of bounded size, so that what a task makes of them does not grow with its input."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text and rows of a slice.
SLICE_BYTES, SLICE_ROWS = 1 << 21, 2048


def slices(batches, text: str, most: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """The batches cut into slices of at most `rows` rows and about `most` bytes of the column `text`; a longer text is a slice of its own.

    Nothing is copied. At the end the task gives its memory back to the system, as its process lives on.
    """
    for b in batches:
        column = b.column(b.schema.get_field_index(text))
        sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if i > first and (held + n > most or i - first >= rows):
                yield b.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < b.num_rows:
            yield b.slice(first)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
