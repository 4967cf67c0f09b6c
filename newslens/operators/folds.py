"""Groups of sorted rows folded inside a task, one after the other.

`applyInPandas` builds frames for every group, which costs milliseconds however few rows a group has. Here a task reads its sorted rows as one
stream and hands each group to a plain function, so the work grows with the rows and not with the groups, and no group is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in a batch of results.
BATCH_ROWS = 1 << 14


def fold_groups(rows: DataFrame, keys: list[str], order: list[Column | str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `fold` makes of each group of equal `keys`, which it gets as an iterator over tuples in the order of `order`."""
    key = itemgetter(*[rows.columns.index(k) for k in keys])
    types = to_arrow_schema(StructType.fromDDL(schema))

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), types, strict=True)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made: list[tuple] = []
        for _, group in groupby(stream, key):
            for row in fold(group):
                made.append(row)
                if len(made) == BATCH_ROWS:
                    yield batch(made)
                    made = []
        if made:
            yield batch(made)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
