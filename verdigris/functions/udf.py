"""Pandas UDFs that are made when first applied, so that modules can be imported without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vectorized(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def applied(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return applied

    return wrap


#: Bytes of an Arrow batch at most, where the session has no value of its own: a batch of 10,000 long texts and what is found in them would fill a worker.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """See that Arrow batches of long texts stay small; a session's own setting is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") in ("1", "1b"):  # the given default comes back where nothing is set
        spark.conf.set(key, str(BATCH_BYTES))


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """A table just read, dealt by its keys over as many tasks as it has splits, and at least one a core, for Python work ahead.

    The splits of a scan don't tell: a split without the start of a row group is empty, so a file of one row group is one task, whatever its size.
    """
    bounded(table.sparkSession)
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions()), *keys)
