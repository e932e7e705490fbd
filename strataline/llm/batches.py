"""Helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, types as T

#: Bytes that separate words: space and tab to carriage return, as ``bytes.split`` takes them.
WORD_SPACE = " \t\n\x0b\x0c\r"


def map_columns(df: DataFrame, fn: Callable, schema: T.StructType, rows: int = 512) -> DataFrame:
    """Run ``fn`` on column slices: a dict of lists (or arrays) in, a dict of equally long lists out.

    Slices of ``rows`` rows bound the memory of a task however large the Arrow batches are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                columns = {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
                out = fn(columns)
                arrays = [pa.array(out[f.name], type=f.type) for f in out_schema]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    return df.mapInArrow(run, schema)


def struct(ddl: str) -> T.StructType:
    """``"a long, b string"`` as a struct type, without asking a session."""
    names = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
             "boolean": T.BooleanType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType()),
             "ints": T.ArrayType(T.IntegerType()), "floats": T.ArrayType(T.FloatType())}
    fields = [part.split() for part in ddl.split(",")]
    return T.StructType([T.StructField(name, names[kind]) for name, kind in fields])
