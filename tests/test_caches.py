"""The stateful cache against a plain one: expiry, eviction, restart."""

import datetime as dt
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from verdigris.streaming import caches, streams

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, value string"


def requests(n, seed=3):
    rng, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += rng.randint(1, 40)
        out.append((f"k{min(rng.randint(0, 30), rng.randint(0, 30))}", START + dt.timedelta(seconds=at), f"v{i}" if rng.random() < 0.5 else None))
    return out


def plain(rows, shard_of, most, ttl):
    held, out = {}, []
    for key, ts, value in rows:
        cache = held.setdefault(shard_of[key], OrderedDict())
        if key in cache and ts >= cache[key][1]:
            del cache[key]
        entry, evicted = cache.get(key), 0
        if entry:
            cache.move_to_end(key)
        if value is not None:
            cache[key] = (value, ts + dt.timedelta(seconds=ttl))
            cache.move_to_end(key)
            while len(cache) > most:
                cache.popitem(last=False)
                evicted += 1
        if value is None or evicted:
            out.append((key, ts, entry is not None if value is None else None, entry[0] if entry and value is None else None, evicted))
    return sorted(out, key=repr)


def test_cache_on_a_table(spark):
    rows = requests(400)
    df = spark.createDataFrame(rows, SCHEMA)
    of = {r["key"]: r["s"] for r in df.select("key", F.pmod(F.xxhash64("key"), F.lit(3)).cast("int").alias("s")).distinct().collect()}
    want = plain(rows, of, 4, 300.0)
    assert any(w[4] for w in want) and any(w[2] for w in want) and any(w[2] is False for w in want)
    got = caches.cached(df.unionByName(spark.createDataFrame([(None, START, "x"), ("k1", None, None)], SCHEMA)), shards=3, most=4, ttl=300.0)
    columns = ["key", "ts", "hit", "value", "evicted"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want



@pytest.mark.parametrize(("most", "ttl"), [(4, 1e9), (1000, 300.0)])
def test_cache_on_a_stream_that_restarts(spark, tmp_path, most, ttl):
    """Three files, two runs: the second goes on with the entries of the first.  Timers empty places, so room and time are tried apart."""
    rows, columns, found = requests(400), ["key", "ts", "hit", "value", "evicted"], []
    of = {r["key"]: r["s"] for r in spark.createDataFrame(rows, SCHEMA).select("key", F.pmod(F.xxhash64("key"), F.lit(3)).cast("int").alias("s")).distinct().collect()}
    want = plain(rows, of, most, ttl)
    for first, upto in ((0, 250), (250, 400)):
        for k in range(first, upto, 125):
            spark.createDataFrame(rows[k : min(k + 125, upto)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = caches.cached(streams.source(spark, f"{tmp_path}/in", SCHEMA), shards=3, most=most, ttl=ttl, late="1 second")
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        found.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert 0 < found[0] < found[1]
    assert sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()), key=repr) == want


def test_timers_end_entries_that_nobody_reads(spark, tmp_path):
    """The state, not only the answers: after the watermark has passed, the entry is gone."""
    rows = [("a", START, "1"), ("b", START + dt.timedelta(hours=2), "2"), ("b", START + dt.timedelta(hours=3), "3")]
    for row in rows:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = caches.cached(streams.source(spark, f"{tmp_path}/in", SCHEMA), shards=1, most=10, ttl=60.0, late="1 second")
    q = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    kept = spark.read.format("statestore").option("stateVarName", "entries").load(f"{tmp_path}/cp").collect()
    assert {r["user_map_key"]["key"] for r in kept if "user_map_key" in r} <= {"b"}


@pytest.mark.parametrize("read_through", [False, True])
def test_a_table_with_room_for_all_needs_no_state(spark, read_through):
    """The same rows as shards that never fill, and no Python that holds a shard."""
    df = spark.createDataFrame([*requests(300), ("k1", START, None), ("k1", START, "x"), ("k1", START, "x"), (None, START, "x"), ("k1", None, None)], SCHEMA)
    columns = ["shard", "key", "ts", "hit", "value", "evicted"]
    roomy = caches.cached(df, shards=3, most=caches.ROOM_FOR_ALL, ttl=300.0, read_through=read_through)
    assert "Python" not in roomy._jdf.queryExecution().optimizedPlan().toString() and "TransformWithState" not in roomy._jdf.queryExecution().optimizedPlan().toString()
    held = caches.cached(df, shards=3, most=10_000, ttl=300.0, read_through=read_through)
    assert roomy.schema.simpleString() == held.schema.simpleString()
    assert sorted(map(tuple, roomy.select(*columns).collect()), key=repr) == sorted(map(tuple, held.select(*columns).collect()), key=repr)
