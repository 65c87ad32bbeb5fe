"""Vector expressions on ``array<float>`` or ``array<double>`` columns, built-in and JVM-side, and normalization of whole tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

NORM_FLOOR = 1e-10  #: squared lengths up to this leave a vector as it is


def vector_literal(values: Sequence[float]) -> Column:
    """A constant ``array<double>``, folded once whatever its length."""
    return F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in values) + "]"), "array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product, summed left to right in doubles; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_length(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def magnitude(v: Column) -> Column:
    return F.sqrt(squared_length(v))


def normalize(v: Column) -> Column:
    """``v`` over its length, in doubles; unchanged if the squared length is at most NORM_FLOOR."""
    s = squared_length(v)
    scale = F.when(s > NORM_FLOOR, F.lit(1.0) / F.sqrt(s)).otherwise(F.lit(1.0))
    # the scale is bound by a one-element array, so that it isn't computed anew for each element
    return F.flatten(F.transform(F.array(scale), lambda k: F.transform(v, lambda x: x.cast("double") * k)))


def normalized_rows(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """``df`` with its vectors, all of ``dim`` numbers, over their lengths as 32-bit floats; as ``normalize``, a batch at a time.

    Lambdas over arrays aren't compiled; for whole tables one pass over Arrow batches is several times quicker.
    """
    at = df.columns.index(vector)
    schema = StructType([StructField(f.name, ArrayType(FloatType()) if f.name == vector else f.dataType) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            squared = np.einsum("ij,ij->i", x, x)
            scale = np.where(squared > NORM_FLOOR, 1.0 / np.sqrt(np.maximum(squared, NORM_FLOOR)), 1.0)
            flat = (x * scale[:, None]).astype(np.float32).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([lists if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, schema)


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


def all_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def is_finite(v: Column) -> Column:
    """No NaN, no infinity, and nothing that a 32-bit float would turn into one."""
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) <= 3.4028234663852886e38))
