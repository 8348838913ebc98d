"""A deterministic embedder for tests and offline use: hashed bag of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

DIM = 512
WORD = re.compile(r"[^\W_]+")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def bag(text: str | None, dim: int = DIM) -> list[float] | None:
    """Counts of words of more than two bytes, by hash; NULL stays NULL."""
    if text is None:
        return None
    out = [0.0] * dim
    for w in WORD.findall(text.lower()):
        data = w.encode()
        if len(data) > 2:
            out[fnv1a(data) % dim] += 1.0
    return out


def _embed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bag(t, dim) for t in batch.column(1).to_pylist()], pa.list_(pa.float32()))], names=["id", "embedding"])

    return run


def embed(texts: DataFrame, key: str, column: str, dim: int = DIM, embedder=None) -> DataFrame:
    """key, embedding. `embedder` may be any function from batches of (id, text) to batches of (id, embedding), for a model service; it must give a row for every row, in order, else the task fails."""
    kind = texts.schema[key].dataType.simpleString()
    run = _checked(embedder) if embedder else _embed(dim)
    return texts.select(texts[key].alias("id"), texts[column].alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", key)


def _checked(embedder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(embedder(iter([batch])))
            ids = [i for b in out for i in b.column(0).to_pylist()]
            if ids != batch.column(0).to_pylist():
                raise ValueError(f"the embedder gave {len(ids)} rows for {batch.num_rows}, or in another order")
            yield from out

    return run
