"""A cache as a stateful operator: values that expire, and that the least recently used of which make room.

Keys are dealt over shards by hash.  A shard is a group of the stream with a map of at most ``most`` entries as state, so its state has a bound however many keys pass; within it the
order of use is exact.  An entry ends when it is read after its time, when a timer of the watermark finds it, or when the shard is full.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps maps and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed: entries and seconds of the cache of replies; seconds of the cache of links.
MOST, REPLY_TTL, LINK_TTL = 500, 3600.0, 24 * 3600.0
#: A number of entries that no shard reaches: nothing ever makes room, so keys don't depend on one another.
ROOM_FOR_ALL = 1 << 40
RESULT = "shard int, key string, ts timestamp, hit boolean, value string, evicted int"


class Shard(StatefulProcessor):
    """Entries of one shard: key -> value, when it expires, and its place in the order of use."""

    def __init__(self, most: int, ttl: float, read_through: bool) -> None:
        self.most, self.ttl, self.read_through = most, ttl, read_through

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value string, expires double, used long")
        self.clock = handle.getValueState("clock", "used long")

    def _held(self) -> OrderedDict[str, tuple[str | None, float, int]]:
        """The entries in order of use; at most ``most``."""
        return OrderedDict(sorted(((k[0], (v[0], v[1], v[2])) for k, v in self.entries.iterator()), key=lambda e: e[1][2]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self._held()
        before = dict(held)
        used = self.clock.get()[0] if self.clock.exists() else 0
        # arrival order inside a batch is no order: time, then key, reads before writes
        for r in sorted(rows, key=lambda r: (r["ts"], r["key"], r["value"] is not None, r["value"] or "")):
            now, name, evicted = r["ts"].timestamp(), r["key"], 0
            entry = held.get(name)
            if entry is not None and now >= entry[1]:
                del held[name]
                entry = None
            used += 1
            if entry is not None:
                held[name] = (entry[0], entry[1], used)
                held.move_to_end(name)
            reads = r["value"] is None or self.read_through
            if r["value"] is not None:
                held[name] = (r["value"], now + self.ttl, used)
                held.move_to_end(name)
                while len(held) > self.most:
                    held.popitem(last=False)
                    evicted += 1
            if reads or evicted:
                yield Row(shard=key[0], key=name, ts=r["ts"], hit=entry is not None if reads else None, value=entry[0] if entry is not None and reads else None, evicted=evicted)
        for name in before.keys() - held.keys():
            self.entries.removeKey((name,))
        for name, entry in held.items():
            if before.get(name) != entry:
                self.entries.updateValue((name,), entry)
                if name not in before or before[name][1] != entry[1]:
                    self.handle.registerTimer(int(entry[1] * 1000))
        self.clock.update((used,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for name, entry in self._held().items():
            if entry[1] <= at:
                self.entries.removeKey((name,))
        return iter(())

    def close(self) -> None:
        pass


def configured(spark: SparkSession) -> None:
    """Set the state store that maps and timers need, where the session has Spark's default, and see that its coordinator is there, for tables too."""
    spark.streams.active  # noqa: B018
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, PROVIDER)


def cached(requests: DataFrame, shards: int = 64, most: int = MOST, ttl: float = REPLY_TTL, late: str = "10 minutes", read_through: bool = False) -> DataFrame:
    """requests (key, ts, value; a null value reads, another writes) -> a row for each read, with what the cache had, and for each write that made others go.

    ``read_through``: a request with a value reads first, then writes it.  Rows without key or time are left out.  Works on streams and on tables; a task sorts a shard's rows of one
    micro-batch, or of the whole table, so a large table should pass as a stream of its files.  On a table with ``most`` at ROOM_FOR_ALL there is no such sort: see ``_roomy``.
    """
    known = requests.where("key IS NOT NULL AND ts IS NOT NULL").select("key", "ts", "value")
    if known.isStreaming:
        known = known.withWatermark("ts", late)
    dealt = known.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    if not known.isStreaming and most >= ROOM_FOR_ALL:
        return _roomy(dealt, ttl, read_through)
    configured(requests.sparkSession)
    return dealt.groupBy("shard").transformWithState(Shard(most, ttl, read_through), RESULT, "Append", "EventTime" if requests.isStreaming else "ProcessingTime")


def _roomy(requests: DataFrame, ttl: float, read_through: bool) -> DataFrame:
    """The cache on a table (shard, key, ts, value) where no entry makes room for another: a request finds its key's last write, if that has not expired.

    Keys are dealt over all tasks, not over the shards, and sorted by Spark, so neither time nor memory depends on the number of shards.
    """
    order = Window.partitionBy("key").orderBy("ts", F.col("value").isNotNull(), "value")  # as a shard takes them: reads before writes
    written = F.when(F.col("value").isNotNull(), F.struct("value", "ts"))
    entry = F.last(written, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = requests.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("entry", entry)
    hit = F.coalesce(F.unix_micros("ts") < F.unix_micros(F.col("entry.ts")) + round(ttl * 1e6), F.lit(False))
    asked = found if read_through else found.where("value IS NULL")
    return asked.select("shard", "key", "ts", hit.alias("hit"), F.when(hit, F.col("entry.value")).alias("value"), F.lit(0).alias("evicted"))
