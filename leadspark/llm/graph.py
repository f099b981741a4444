"""Connected components of an edge table, without the edges leaving the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from .textnum import ensure_checkpoint_dir, lean

#: Edges up to which one task finds the components, at some 100 bytes an edge; larger tables are exchanged.
ONE_TASK = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of the edges between a and b; a label is the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low < high
        if not open_.any():
            return nodes, nodes[label]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for b in batches:
        for side, column in zip(sides, b.columns, strict=True):
            side.append(column.to_numpy())
    yield pa.record_batch([pa.array(x) for x in least_labels(*map(np.concatenate, sides))], ["node", "label"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, label) for every node of edges(a long, b long); label is the smallest node of its component.

    Large tables are turned into stars around the least nodes, which shrinks them while it converges; see operators/components.py.
    A table of at most `one_task` edges, which a count has shown, takes its rounds inside one task.
    Edges with a null end are ignored; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).checkpoint()
    if e.count() <= one_task:
        return e.coalesce(1).mapInArrow(lean(_solved), "node long, label long").checkpoint()
    found, _ = stars(e)
    return found.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
