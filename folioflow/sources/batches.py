"""Row helpers on Arrow batches: a task's Python holds a row at a time and a few MB of what it made, however large Spark's batches are."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Rows, and characters or bytes, after which a batch is handed on.
ROWS, SIZE = 10_000, 4 << 20
TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def by_row(make: Callable[..., Iterable[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: the rows, of a schema of "name type, ...", that `make` gives for the columns of each row."""
    fields = pa.schema([(name, TYPES[kind]) for name, kind in (field.split() for field in schema.split(","))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    def run(batches):
        held, size = [], 0
        for taken in batches:
            for at in range(taken.num_rows):
                for row in make(*(column[at].as_py() for column in taken.columns)):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
                    if len(held) >= ROWS or size >= SIZE:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return run
