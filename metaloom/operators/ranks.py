"""Running sums and row numbers over a whole table without a one-task window.

Rows are dealt out by ranges of the order, each task sums its own sorted rows as a stream, and the sums of the tasks before
(one number a task, on the driver) are added at the end. Nothing is gathered: a table of any size takes one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaloom.sources.scratch import cut


def running_sums(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df with, for each name, the sum of its value over all rows up to and including this one (longs; null counts as 0).

    The order should tell any two rows apart; rows that it does not are summed in an order of their own. An empty table
    stays empty."""
    names, part = list(values), "_part"
    dealt = df.withColumns({f"_{n}": F.coalesce(v.cast("long"), F.lit(0)) for n, v in values.items()})
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(names, 0)
        for batch in batches:
            own = [batch.column(f"_{n}") for n in names]
            sums = []
            for n, column in zip(names, own):
                s = np.cumsum(column.to_numpy(zero_copy_only=False)) + so_far[n]
                so_far[n] = int(s[-1]) if len(s) else so_far[n]
                sums.append(pa.array(s, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own, *sums, batch.column(part)], [*kept, *(f"_{n}" for n in names), *names, part])

    schema = StructType(list(df.schema.fields))
    for n in [*(f"_{n}" for n in names), *names]:
        schema = schema.add(n, "long")
    local = cut(dealt.mapInArrow(run, schema.add(part, "integer")))
    totals = local.groupBy(part).agg(*[F.sum(f"_{n}").alias(n) for n in names]).orderBy(part).collect()  # a row per task
    before, so_far = [], dict.fromkeys(names, 0)
    for r in totals:
        before.append((r[part], *(so_far[n] for n in names)))
        so_far = {n: so_far[n] + r[n] for n in names}
    offsets = df.sparkSession.createDataFrame(before, ", ".join([f"{part} int", *(f"_before_{n} long" for n in names)]))
    joined = local.join(F.broadcast(offsets), part)
    return joined.select(*kept, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in names])


def numbered(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """df with each row's place in the order, from 0."""
    return running_sums(df, order, **{name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def first_per_group(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group. A sort of n rows at most is kept for each group and task before the shuffle, so that a
    group with very many rows never meets in one task."""
    from pyspark.sql import Window

    by = Window.partitionBy(*group, "_task").orderBy(*order)
    local = df.withColumn("_task", F.spark_partition_id()).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n)
    return local.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_task", "_n")
