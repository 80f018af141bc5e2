"""Static embeddings: a mean of token rows, scaled to unit length."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

UNKNOWN = 1


def read_weights(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    """The one F32 tensor of a safetensors file, which must have the given shape."""
    size = int.from_bytes(data[:8], "little")
    head = {k: v for k, v in json.loads(data[8 : 8 + size]).items() if k != "__metadata__"}
    if len(head) != 1 or (only := next(iter(head.values())))["dtype"] != "F32" or tuple(only["shape"]) != shape:
        raise ValueError("not the expected tensor")
    a, b = only["data_offsets"]
    return np.frombuffer(data[8 + size + a : 8 + size + b], "<f4").reshape(shape)


def encode(ids: list[int], weights: np.ndarray) -> np.ndarray:
    """Zero where no id counts: unknown ids and those beyond the table don't. In the
    weights' own precision."""
    known = [i for i in ids if i != UNKNOWN and 0 <= i < len(weights)]
    if not known:
        return np.zeros(weights.shape[1], weights.dtype)
    mean = weights[known].mean(0, dtype=weights.dtype)
    length = np.sqrt((mean * mean).sum(dtype=weights.dtype))
    return mean / length if length else mean


def encode_texts(df: DataFrame, tokenize: Callable[[str], list[int]], weights: np.ndarray, key: str = "id", text: str = "text") -> DataFrame:
    """key, vector; the weights (a fixed model) are broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "vector": [encode(tokenize(t), shared.value).tolist() for t in f[text]]})

    number = "double" if weights.dtype == np.float64 else "float"
    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, vector array<{number}>")
