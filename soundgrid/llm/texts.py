"""Shared helpers: Arrow passes over texts, byte-level words, scratch tables."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A pass over texts works on so many bytes at a time, whatever the batch size.
SLICE_BYTES = 4 << 20

#: ASCII lower case; every ASCII byte that is neither letter nor digit becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, names) -> list[str]:
    """The columns of df whose name is none of these, whatever the case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def slices(lengths, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, count) of runs of rows that hold about `limit` bytes each."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + (n or 0) > limit:
            yield start, i - start
            start, size = i, 0
        size += n or 0
    if len(lengths) > start:
        yield start, len(lengths) - start


def append(df: DataFrame, make: Callable, fields: list[T.StructField], text: str = "text") -> DataFrame:
    """df with columns computed from its text column by Arrow batches.

    `make()` runs once per task and returns a function from a list of texts (None:
    null) to one Arrow array or list per field. A column of df that is named like
    a new one is replaced.
    """
    kept = without(df, [f.name for f in fields])
    source = df.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text)).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    width = len(kept)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        step, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(width)
            for start, count in slices(pc.binary_length(texts).to_pylist()):
                made = step(texts.slice(start, count).to_pylist())
                made = [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(width + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(start, count) for i in range(width)] + made, names=arrow.names)

    return source.mapInArrow(run, schema)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
