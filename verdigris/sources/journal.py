"""A table with a log: batches of rows that are there in whole or not at all, with the progress that belongs to them.

A batch is written first, as files of a folder of its own that nothing refers to; then one entry of the log names the folder, the batch and its progress.  The entry is
a file that is created only if it doesn't exist, so rows and progress become visible in one step.  What a writer leaves that dies between the two is never read, and a batch that is
written again, by a restart or by a second writer, finds its entry and changes nothing.

The log is as long as there are batches.  Stores must refuse to create a file that exists, as HDFS and POSIX folders do.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='verdigris-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(table: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: what follows reads it as often as it needs without making it anew."""
    path = f"{shared_dir(table.sparkSession)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


class Taken(Exception):
    """Another writer has made this entry of the log."""


class Journal:
    """The table at a path, of rows of one schema."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def entries(self) -> list[dict]:
        """All entries in order; each has version, batch, folder, schema and what the writer added."""
        folder = f"{self.path}/log"
        if not self._fs.exists(self._at(folder)):
            return []
        # an entry is created empty and then filled: one that is still empty isn't there yet
        found = self.spark.read.text(folder, wholetext=True).where("value <> ''").collect()
        return sorted((json.loads(r["value"]) for r in found), key=lambda e: e["version"])

    def _commit(self, entry: dict) -> None:
        name = self._at(f"{self.path}/log/{entry['version']:012d}.json")
        try:
            out = self._fs.create(name, False)
        except Exception as e:
            if self._fs.exists(name):
                raise Taken(entry["version"]) from e
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def append(self, rows: DataFrame, batch: str, describe: Callable[[DataFrame], dict] | None = None, **more: object) -> dict:
        """The entry of a batch: what the log has under its name, or else rows and a new entry, with what ``describe`` says of the rows as written."""
        before = self.entries()
        if own := [e for e in before if e["batch"] == batch]:
            return own[0]
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        if describe:
            more |= describe(self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}"))
        while True:
            entry = {"version": len(before) + 1, "batch": batch, "folder": folder, "schema": rows.schema.jsonValue(), **more}
            try:
                self._commit(entry)
                return entry
            except Taken:
                before = self.entries()
                if own := [e for e in before if e["batch"] == batch]:
                    return own[0]

    def rows(self, entries: list[dict] | None = None) -> DataFrame:
        """The rows of all batches, or of the given entries."""
        entries = self.entries() if entries is None else entries
        if not entries:
            raise ValueError(f"no batch at {self.path}")
        schema = StructType.fromJson(entries[0]["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{e['folder']}" for e in entries])


def resumed(journal: Journal, source: DataFrame, key: str, work, batch_rows: int, after: object = None) -> int:  # noqa: ANN001
    """Work through ``source`` in ascending order of ``key``, a batch at a time, from where the log ends; how many batches were written.

    ``work`` makes the rows of a batch from the source's.  The end of a batch comes from the keys alone and is the batch's name, so a restart makes the same batch again.
    Keys must be distinct; rows without a key are left out.
    """
    from pyspark.sql import functions as F

    done = journal.entries()
    last = done[-1]["upto"] if done else after
    made = 0
    while True:
        rest = source.where(F.col(key).isNotNull() if last is None else F.col(key) > F.lit(last))
        upto = rest.select(key).orderBy(key).limit(batch_rows).agg(F.max(key).alias("k")).first()["k"]
        if upto is None:
            return made
        journal.append(work(rest.where(F.col(key) <= F.lit(upto))), f"{key}<={upto}", upto=upto)
        last, made = upto, made + 1
