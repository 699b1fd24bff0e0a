"""Row functions over Arrow batches, and the tables the operators exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time; long texts make small slices.
ROWS = 256
CHARS = 4_000_000

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<float>": pa.list_(pa.float32()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow's schema of ``name type, name type``."""
    return pa.schema([(n, ARROW[t]) for n, t in (part.split() for part in ddl.split(", "))])


def slices(batch: pa.RecordBatch, rows: int = ROWS, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``rows`` rows and about ``chars`` bytes, one row at least."""
    step = max(1, min(rows, int(batch.num_rows * chars / max(1, batch.nbytes))))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def map_rows(df: DataFrame, make: Callable[[], Callable], ddl: str) -> DataFrame:
    """A row-by-row Python function over Arrow batches.

    ``make()`` runs once in a task and returns the function, which gets the
    columns of some rows as lists and returns the columns of ``ddl`` as lists,
    of any one length.
    """

    def run(batches):
        fn, schema = make(), arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch):
                columns = fn(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    return df.mapInArrow(run, ddl)


def filter_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable]) -> DataFrame:
    """The rows of ``df``, all columns, for which the Python function gives true.

    The function gets the named columns of some rows as lists and returns a
    list of booleans.
    """

    def run(batches):
        fn = make()
        for batch in batches:
            for part in slices(batch):
                mask = fn(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in columns])
                yield part.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a documents table, whatever else it carries."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
