"""Arrow record batches cut, read and extended inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Code points of text that a task works on at a time (a longer text makes a slice of its own).
SLICE_CHARS = 2_000_000


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple]:
    """``(part of the batch, its texts)``, each with at most ``chars`` code points or one row.

    A null text reads as an empty one.
    """
    values = batch.column(batch.schema.names.index(column))
    start, size = 0, 0
    texts: list[str] = []
    for i in range(batch.num_rows):
        text = values[i].as_py() or ""
        if texts and size + len(text) > chars:
            yield batch.slice(start, i - start), texts
            start, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield batch.slice(start), texts


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(
    docs: DataFrame,
    columns: dict[str, T.DataType],
    compute: Callable[[], Callable[[list[str], pa.RecordBatch], list]],
    text: str = "text",
    chars: int = SLICE_CHARS,
) -> DataFrame:
    """``docs`` with ``columns`` added, or put in the place of columns of the same names.

    ``compute()`` runs once in each task and gives a function from the texts of a slice (and the
    slice itself) to one list or Arrow array of values per column. Other columns pass unchanged.
    A slice has at most ``chars`` code points of text, or one row.
    """
    fields = [f for f in docs.schema.fields if f.name not in columns]
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in columns.items()])
    kinds = [to_arrow_type(t) for t in columns.values()]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in batches:
            for part, texts in slices(batch, text, chars):
                added = [
                    v if isinstance(v, pa.Array) else pa.array(v, kind)
                    for v, kind in zip(work(texts, part), kinds, strict=True)
                ]
                own = [part.column(part.schema.names.index(n)) for n in names]
                yield pa.RecordBatch.from_arrays(own + added, names=names + list(columns))

    return docs.mapInArrow(run, schema)
