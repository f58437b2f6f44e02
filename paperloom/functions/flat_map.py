"""One-to-many decoding of rows in Arrow batches: the way into formats that Catalyst can't read."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that are Python objects at a time.
SLICE = 32


def flat_map(df: DataFrame, decode: Callable[[dict], Iterable[dict]], schema: str | StructType, flush: int = 4096) -> DataFrame:
    """decode(row) of each row; missing keys are null. Output goes on every `flush` rows, so a large part doesn't pile up."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        out = []
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for row in batch.slice(k, SLICE).to_pylist():
                    out.extend(decode(row))
                    if len(out) >= flush:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, kind)
