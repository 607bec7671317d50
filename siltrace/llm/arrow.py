"""Small helpers for ``mapInArrow`` functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from siltrace.llm.words import text_parts

SMALL = 1 << 19  # bytes of text, for functions whose arrays are many times their text


def in_text_parts(make: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, done: Callable[[], None] | None = None, most: int = 1 << 21) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``make`` over row ranges of about ``most`` bytes of text, so memory follows the text, not the row count.

    ``done`` is called at the end of a partition, to let go of what the worker has kept.
    """

    def run(batches):
        try:
            for batch in batches:
                for i, j in text_parts(batch.column(batch.schema.get_field_index(column)), most):
                    yield make(batch.slice(i, j - i))
        finally:
            if done:
                done()
            pa.default_memory_pool().release_unused()

    return run
