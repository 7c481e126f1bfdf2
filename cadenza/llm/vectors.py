"""Vectors as bytes: checked, packed and unpacked with numpy inside tasks, so no row is a list of boxed numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def packed(x: np.ndarray) -> pa.Array:
    """A matrix's rows as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary())


def unpacked(values, dtype: str) -> np.ndarray:
    """A float64 matrix from binary values of one length."""
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1).astype(float)


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str | None = None, all_rows: bool = False) -> tuple[DataFrame, str]:
    """(vec_id, label, dims, v) of the rows that have an id, a label and a vector that is neither zero nor has null or non-finite
    components, and the type of v's numbers; v holds the vector's own numbers, with 0 for -0. Without a label_col the label is 0.
    With `all_rows` the other rows are there too, without dims and v."""
    single = isinstance(rows.schema[vec_col].dataType.elementType, FloatType)
    dtype = "<f4" if single else "<f8"
    label = F.col(label_col) if label_col else F.lit(0)
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))
    names = ["vec_id", "label", "dims", "v"]
    kind = given.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().copy()
            sizes[pc.or_(pc.is_null(batch.column(0)), pc.is_null(batch.column(1))).to_numpy(zero_copy_only=False)] = 0
            unfit = [np.flatnonzero(sizes == 0)]
            for dims in np.unique(sizes[sizes > 0]).tolist():
                pick = np.flatnonzero(sizes == dims)
                part = batch.take(pa.array(pick))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(pick), dims)
                fine = pa.array(np.isfinite(x).all(1) & (x != 0).any(1))  # a null component is NaN here
                unfit.append(pick[~fine.to_numpy(zero_copy_only=False)])
                x = x[fine.to_numpy(zero_copy_only=False)].astype(dtype) + np.dtype(dtype).type(0)
                columns = [part.column(k).filter(fine) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(x), dims, np.int32)), packed(x)], names)
            rest = np.concatenate(unfit)
            if all_rows and len(rest):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rest)), batch.column(1).take(pa.array(rest)), pa.nulls(len(rest), pa.int32()), pa.nulls(len(rest), pa.binary())], names)

    return given.mapInArrow(run, f"vec_id long, label {kind}, dims int, v binary"), dtype
