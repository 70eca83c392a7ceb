"""Scoring of rows with several models in one pass (MOD12, UDF1, FN2, FN11), and models' vectors by item (SIM5)."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of all models' states together, which every executor holds once.
MOST_STATE = 512_000_000


@dataclass
class BatchModel:
    """A model over a batch of rows.

    predict(state, column, column, ...) gets the inputs as numpy arrays of a batch, numbers with NaN for null, and
    gives an array, or a tuple of arrays if there are several outputs. The state, weights for example,
    is sent to each executor once. Any number of outputs gets one column of seconds a row, named by the first.
    """

    inputs: list[str]
    outputs: list[str]
    predict: Callable[..., Any]
    state: Any = None


def _as_array(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) or pa.types.is_decimal(column.type):
        column = column.cast(pa.float64())
    return column.to_numpy(zero_copy_only=False)


def _outputs(model: BatchModel, columns: list[np.ndarray]) -> np.ndarray:
    """A row for each output. A batch that fails is halved until the rows that fail stand alone; they are null."""
    n = len(columns[0])
    try:
        found = model.predict(model.state, *columns)
        found = found if isinstance(found, tuple) else (found,)
        if len(found) != len(model.outputs):
            raise TypeError("a model gives as many arrays as it has outputs")
        return np.stack([np.broadcast_to(np.asarray(x, np.float64), (n,)) for x in found])
    except Exception:
        if n == 1:
            return np.full((len(model.outputs), 1), np.nan)
    half = n // 2
    return np.concatenate([_outputs(model, [c[:half] for c in columns]), _outputs(model, [c[half:] for c in columns])], axis=1)


def with_models(rows: DataFrame, models: dict[str, BatchModel], timed: bool = False) -> DataFrame:
    """rows with a double column for each output of each model, all made in one pass over Arrow batches.

    What a model can't make for a row, an error as well as NaN, is null there and leaves other rows
    alone. timed adds <first output>_time, a batch's seconds a row. Columns of rows called like the new
    ones are replaced; an empty table stays empty. States of more than MOST_STATE bytes together are refused.
    """
    outputs = [o for m in models.values() for o in m.outputs]
    if len(set(outputs)) < len(outputs):
        raise ValueError("outputs need names of their own")
    if wrong := [n for n, m in models.items() if not m.outputs or not m.inputs]:
        raise ValueError(f"models without inputs or outputs: {wrong}")
    made = [n for m in models.values() for n in [*m.outputs, *([f"{m.outputs[0]}_time"] if timed else [])]]
    if not made:
        return rows
    states = {n: m.state for n, m in models.items()}
    if (size := len(pickle.dumps(states))) > MOST_STATE:
        raise ValueError(f"the models' states have {size} bytes, more than {MOST_STATE}")
    shared = rows.sparkSession.sparkContext.broadcast(states)
    bare = {n: BatchModel(m.inputs, m.outputs, m.predict) for n, m in models.items()}
    kept = [c for c in rows.columns if c not in made]
    # inputs stand beside the columns to keep, so that one that is replaced can still be read
    given = sorted({c for m in models.values() for c in m.inputs})
    source = rows.select(*[rows[c] for c in kept], *[rows[c].alias(f"_in{i}") for i, c in enumerate(given)])
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = [BatchModel(m.inputs, m.outputs, m.predict, shared.value[n]) for n, m in bare.items()]
        for batch in batches:
            inputs = {c: _as_array(batch.column(len(kept) + i)) for i, c in enumerate(given)} if batch.num_rows else {}
            arrays = list(batch.columns[: len(kept)])
            for model in registry:
                began = time.perf_counter()
                found = _outputs(model, [inputs[c] for c in model.inputs]) if batch.num_rows else np.zeros((len(model.outputs), 0))
                arrays += [pa.array(x, pa.float64(), from_pandas=True) for x in found]
                if timed:
                    arrays.append(pa.array(np.full(batch.num_rows, (time.perf_counter() - began) / max(batch.num_rows, 1))))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *made])

    return source.mapInArrow(run, schema)


def with_embedding(rows: DataFrame, model: BatchModel, size: int = 256) -> DataFrame:
    """rows with an array of doubles, model.outputs[0]: the vector that the model gives each row (SIM5).

    predict gets batches of exactly size rows, as models with a fixed batch need them, and gives a matrix of
    as many; a last batch is filled up with its last row and what it gives for these is cut off. A
    row that the model fails on has a null vector and leaves the others alone. A column called like the output is
    replaced; an empty table stays empty.
    """
    if len(model.outputs) != 1 or not model.inputs:
        raise ValueError("an embedding has inputs and one output")
    name = model.outputs[0]
    if (held := len(pickle.dumps(model.state))) > MOST_STATE:
        raise ValueError(f"the model's state has {held} bytes, more than {MOST_STATE}")
    shared, inputs, predict = rows.sparkSession.sparkContext.broadcast(model.state), model.inputs, model.predict
    kept = [c for c in rows.columns if c != name]
    source = rows.select(*[rows[c] for c in kept], *[rows[c].alias(f"_in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def vectors(columns: list[np.ndarray]) -> list[np.ndarray | None]:
        n = len(columns[0])
        try:
            found = np.asarray(predict(shared.value, *[np.concatenate([c, np.repeat(c[-1:], size - n, axis=0)]) for c in columns]), np.float64)
            if found.shape[:1] != (size,) or found.ndim != 2:
                raise TypeError("a model gives a vector a row")
            return list(found[:n])
        except Exception:
            if n == 1:
                return [None]
        half = n // 2
        return vectors([c[:half] for c in columns]) + vectors([c[half:] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, made = [_as_array(batch.column(len(kept) + i)) for i in range(len(inputs))], []
            for lo in range(0, batch.num_rows, size):
                made += vectors([c[lo : lo + size] for c in columns])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(made, pa.list_(pa.float64()))], names=[*kept, name])

    return source.mapInArrow(run, schema)
