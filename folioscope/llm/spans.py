"""Arrow helpers for operators that find spans in texts, row by row, in one pass over the documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .bytewords import sha_hex

Span = tuple[int, int, str]


def listed(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def base_digest(spans: list[Span], kinds: list[str]) -> str:
    return sha_hex(listed(spans, kinds).encode())


def add_columns(docs: DataFrame, added: str, start: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """docs(text, ...) with columns computed from each whole text (null: empty); replaces input columns of these names.

    start gives the function of a text; each task calls it once, so what it builds is never shipped."""
    new = StructType.fromDDL(added)
    kept = [c for c in docs.columns if c not in new.names]
    source = docs.select(*[f"`{c}`" for c in kept]) if kept != docs.columns else docs
    names = new.names

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, row = to_arrow_schema(new), start()
        for batch in batches:
            rows = [row(t or "") for t in batch.column("text").to_pylist()]
            made = [pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*kept, *names])

    return source.mapInArrow(over, StructType(source.schema.fields + new.fields))
