"""Running sums over a sorted table, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import stored


def running(rows: DataFrame, keys: list[str], amount: str | None = None) -> DataFrame:
    """rows with `before`: the sum of `amount` (1 without it) over all rows before it in the order of keys, nulls first.

    Rows are dealt by ranges of the keys; only each range's total, a row a partition, passes the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.ones(batch.num_rows, np.int64) if amount is None else batch.column(amount).to_numpy()
            upto = at + np.cumsum(n)
            extra = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(upto - n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_part", "_at"])
            at = int(upto[-1])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema + ", _part int, _at long"), "running")
    each = F.lit(1) if amount is None else F.col(amount)
    starts, upto = [], 0
    for part, last in sorted(tuple(r) for r in dealt.groupBy("_part").agg(F.max(F.col("_at") + each)).collect()):  # a row a partition
        starts.append((part, upto))
        upto += last
    starts = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    return dealt.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + F.col("_at")).alias("before"))
