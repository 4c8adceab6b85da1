"""Sums of arrays that tasks hold, by a tree: no task and not the driver gets more than WIDTH arrays of a key at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import rows_of

WIDTH = 64
PARTIAL = "key long, part long, blob binary"


def partials(held: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> DataFrame:
    """What run makes of each partition: an array for each key."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for key, array in run(batches).items():
            yield rows_of(PARTIAL, [(key, part, array.tobytes())])

    return held.mapInArrow(whole, PARTIAL)


def summed(partial: DataFrame, parts: int, kind: type = np.float64) -> dict[int, np.ndarray]:
    """The sum of a key's arrays, flat. partial: rows of PARTIAL whose parts are below ``parts``, one for each key and part."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, kind) for b in table.column("blob").to_pylist())
        return pa.Table.from_batches([rows_of(PARTIAL, [(table.column("key")[0].as_py(), table.column("part")[0].as_py() // WIDTH, total.tobytes())])])

    while parts > WIDTH:
        partial = partial.groupBy("key", F.expr(f"part div {WIDTH}")).applyInArrow(add, PARTIAL)
        parts = -(-parts // WIDTH)
    out: dict[int, np.ndarray] = {}
    for r in sorted(partial.collect(), key=lambda r: (r["key"], r["part"])):
        out[r["key"]] = out.get(r["key"], 0) + np.frombuffer(r["blob"], kind)
    return out
