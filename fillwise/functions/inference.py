"""Batched model inference by ONNX, one session for each Python worker."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def onnx_columns(df: DataFrame, model: str | bytes, inputs: Sequence[str], outputs: dict[str, str], shapes: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """``df`` with the model's outputs as flattened row-major arrays of doubles.

    ``inputs`` are columns in the order of the model's inputs (numbers, or arrays flattened row by row; ``shapes`` gives
    an array's shape without the batch dimension); a row with a null input has null outputs; ``outputs`` maps new columns to the model's output names.  The
    model's bytes are broadcast.  A batch of rows is one run of the session."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    clash = set(outputs) & set(df.columns)
    if clash:
        raise ValueError(f"columns would be overwritten: {sorted(clash)}")
    sent = df.sparkSession.sparkContext.broadcast(model)
    names, at = list(df.columns), [df.columns.index(c) for c in inputs]
    shapes = {k: tuple(v) for k, v in (shapes or {}).items()}
    columns = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        session = ort.InferenceSession(sent.value, options, providers=["CPUExecutionProvider"])
        kinds = {"tensor(float)": np.float32, "tensor(double)": np.float64, "tensor(int64)": np.int64, "tensor(int32)": np.int32}
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.ones(batch.num_rows, bool)
            for i in at:
                whole &= batch.column(i).is_valid().to_numpy(zero_copy_only=False)
            rows = int(whole.sum())
            if not rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(batch.num_rows, pa.list_(pa.float64())) for _ in outputs)], [*names, *outputs])
                continue
            # each row's place among those that are whole
            place = pa.array(np.cumsum(whole) - 1, mask=~whole)
            feed = {}
            for want, i, c in zip(session.get_inputs(), at, columns):
                a = batch.column(i).filter(pa.array(whole))
                flat = a.flatten() if pa.types.is_list(a.type) else a
                x = flat.to_numpy(zero_copy_only=False).astype(kinds[want.type])
                feed[want.name] = x.reshape((rows, *shapes[c])) if c in shapes else x.reshape(rows, -1)
            got = session.run(list(outputs.values()), feed)
            arrays = []
            for y in got:
                y = np.asarray(y, float).reshape(rows, -1)
                offsets = pa.array(np.arange(rows + 1) * y.shape[1], pa.int32())
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(y.reshape(-1))).take(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*names, *outputs])

    schema = T.StructType([*df.schema, *(T.StructField(name, T.ArrayType(T.DoubleType())) for name in outputs)])
    return df.mapInArrow(run, schema)


def tflite_columns(*_args, **_options) -> DataFrame:
    """Needs a runtime that is not part of the requirements."""
    raise NotImplementedError("no TFLite runtime is installed; convert the model to ONNX")
