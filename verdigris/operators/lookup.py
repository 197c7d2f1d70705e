"""Point and foreign-key lookups: tables written so that a lookup reads the files of its keys alone."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(rows: DataFrame, key: str, buckets: int = 64, name: str | None = None) -> DataFrame:
    """rows as a table of the warehouse, dealt over buckets by the hash of the key and sorted by it, with a Bloom filter on it in each file.

    A lookup by key reads one bucket, and in it only row groups whose filter and range admit the key; a join on the key with a table of as many buckets moves nothing.  One
    file a bucket: rows are dealt the way the buckets are.
    """
    name = name or f"keyed_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, key)
    writer = dealt.write.format("parquet").option(f"parquet.bloom.filter.enabled#{key}", "true").bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)
    return rows.sparkSession.table(name)


def found(table: DataFrame, key: str, values: Iterable) -> DataFrame:
    """The rows of a few keys, by a predicate that prunes buckets; for as many keys as a table has, ``referenced`` is the way."""
    values = list(values)
    return table.where(F.col(key) == values[0]) if len(values) == 1 else table.where(F.col(key).isin(values))


def referenced(rows: DataFrame, key: str, table: DataFrame, table_key: str, columns: list[str], prefix: str = "") -> DataFrame:
    """rows with the columns of the row that their key refers to, null where there is none; rows are kept."""
    other = table.select(F.col(table_key).alias("__key"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return rows.join(other, F.col(key) == F.col("__key"), "left").drop("__key")


def dangling(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Rows whose key refers to nothing: what a foreign-key constraint would refuse."""
    return rows.where(F.col(key).isNotNull()).join(table.select(F.col(table_key).alias(key)), key, "left_anti")
