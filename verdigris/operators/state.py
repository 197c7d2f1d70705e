"""Keyed state as tables: counters, lookups with a time to live, latest-wins upserts, full synchronisation, rate windows, redirect chains."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U


def counters(reports: DataFrame, keys: list[str], at: str) -> DataFrame:
    """report_count, first_seen, last_seen of each key."""
    return reports.groupBy(*keys).agg(F.count(F.lit(1)).alias("report_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def merged_counters(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The counters of both: what an upsert that adds leaves."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("report_count").alias("report_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key, by time and then by ``tie``: an aggregate, so a key's rows are never sorted together."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(at, tie)).alias("x"))
    return best.select(*keys, "x.*")


def ttl_lookup(asks: DataFrame, entries: DataFrame, key: str, asked: str, checked: str, ttl: str = "INTERVAL 24 HOURS") -> DataFrame:
    """asks with ``result`` and ``checked`` of the newest entry of the key that is at most ``ttl`` old when asked; null without one."""
    of = entries.select(F.col(key).alias("__key"), F.col(checked).alias("__checked"), F.col("result").alias("__result"))
    inside = (F.col(key) == F.col("__key")) & (F.col("__checked") <= F.col(asked)) & (F.col("__checked") > F.col(asked) - F.expr(ttl))
    found = asks.join(of, inside, "left")
    return found.groupBy(*asks.columns).agg(F.max_by("__result", "__checked").alias("result"), F.max("__checked").alias("checked_at"))


def sync_actions(wanted: DataFrame, stored: DataFrame, key: str, content: str, meta: str) -> DataFrame:
    """key, action: added, deleted, reembedded (content changed), updated (only metadata changed) or unchanged."""
    a = wanted.select(key, F.col(content).alias("c1"), F.col(meta).alias("m1"), F.lit(True).alias("in1"))
    b = stored.select(key, F.col(content).alias("c2"), F.col(meta).alias("m2"), F.lit(True).alias("in2"))
    both = a.join(b, key, "full")
    action = F.when(F.col("in2").isNull(), "added").when(F.col("in1").isNull(), "deleted").when(~F.col("c1").eqNullSafe(F.col("c2")), "reembedded").when(~F.col("m1").eqNullSafe(F.col("m2")), "updated").otherwise("unchanged")
    return both.select(key, action.alias("action"))


def rate_windows(hits: DataFrame, key: str, at: str, limit: int, seconds: int = 60) -> DataFrame:
    """hits with how many the key has had in the window that ends here, itself included, and whether that exceeds the limit."""
    moment = F.col(at).cast("timestamp").cast("double")
    window = Window.partitionBy(key).orderBy(moment).rangeBetween(-seconds, 0)
    return hits.withColumn("in_window", F.count(F.lit(1)).over(window)).withColumn("denied", F.col("in_window") > limit)


def rate_limited(hits: DataFrame, key: str, at: str, limit: int, seconds: int = 60, tie: str | None = None) -> DataFrame:
    """hits with ``allowed`` and ``retry_after`` seconds, by a moving window of each key in which denied hits don't count; equal times are in the order of ``tie``.

    A decision depends on those before it, so rows of a key pass in order through one task, which holds no more than the ``limit`` times of the window.  Rows without time are denied.
    """
    import pyarrow as pa

    names = hits.columns
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = hits.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp"))).repartition(parts, key).sortWithinPartitions(key, "__at", *([tie] if tie else []))

    def run(it):  # noqa: ANN001, ANN202
        now, times = None, deque()
        for batch in it:
            out = []
            for k, t in zip(batch.column(names.index(key)).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if now != (k,):
                    now, times = (k,), deque()
                while t is not None and times and times[0] <= t - seconds * 1_000_000:
                    times.popleft()
                allowed = t is not None and len(times) < limit
                out.append((allowed, 0.0 if allowed or t is None or not times else (times[0] - t) / 1e6 + seconds))
                if allowed:
                    times.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([a for a, _ in out], pa.bool_()), pa.array([r for _, r in out], pa.float64())], [*names, "allowed", "retry_after"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema) + ", allowed boolean, retry_after double"
    return ordered.mapInArrow(run, schema)


#: Fixed: statuses that send elsewhere.
REDIRECTS = [301, 302, 303, 307, 308]


def redirect_chain(starts: DataFrame, redirects: DataFrame, hops: int = 5, hosts: DataFrame | None = None) -> DataFrame:
    """(url, final, hops, status), a row for each row of starts: followed up to ``hops`` times, relative locations resolved.

    A link that is not public is where a chain ends, and it is not asked: ``status`` is null there, as it is after the last hop allowed and where redirects has no row.  Of several
    rows of a url the least (status, location) holds.  ``hosts(host, public)`` tells names that resolve to private addresses.
    """
    known = redirects.groupBy(F.col("url").alias("__from")).agg(F.min(F.struct("status", "location")).alias("__answer"))
    now = starts.select("url").withColumns({"final": F.col("url"), "hops": F.lit(0), "status": F.lit(None).cast("int"), "__done": F.lit(False)})
    private = None if hosts is None else hosts.where("NOT public").select(F.col("host").alias("__host")).distinct().withColumn("__private", F.lit(True))
    for _ in range(hops):
        asked = now.join(known, (F.col("final") == F.col("__from")) & ~F.col("__done") & U.public_http(F.col("final")), "left")
        answer = F.col("__answer")
        if private is not None:
            asked = asked.join(private, U.host(F.col("final")) == F.col("__host"), "left")
            answer = F.when(F.col("__private").isNull(), answer)
        moves = F.coalesce(answer["status"].isin(REDIRECTS) & (F.trim(answer["location"]) != ""), F.lit(False))
        now = asked.select(
            "url",
            F.when(moves, U.joined(F.col("final"), answer["location"])).otherwise(F.col("final")).alias("final"),
            (F.col("hops") + moves.cast("int")).alias("hops"),
            F.when(F.col("__done"), F.col("status")).when(~moves, answer["status"]).alias("status"),
            (F.col("__done") | ~moves).alias("__done"),
        )
    return now.drop("__done")


def with_reputation(entities: DataFrame, reported: DataFrame) -> DataFrame:
    """(msg_id, entity_type, value) with what is known of each, and one row a message: score, floor, the worst entity.

    verified 100; three reports and more 80; two 60; one 40.
    """
    known = entities.distinct().join(reported, ["entity_type", "value"])
    n = F.col("report_count")
    score = F.when(F.col("is_verified_scam"), 100).when(n >= 3, 80).when(n == 2, 60).when(n == 1, 40).otherwise(0)
    worst = known.withColumn("score", score).groupBy("msg_id").agg(F.max(F.struct("score", "report_count", "entity_type", "value")).alias("x"), F.count(F.lit(1)).alias("reported_entities"), F.max("is_verified_scam").alias("verified"))
    floor = F.when(F.col("verified"), 90).when(F.col("x.report_count") >= 3, 50)
    return worst.select("msg_id", F.col("x.score").alias("score"), floor.alias("floor"), F.col("x.entity_type").alias("entity_type"), F.col("x.value").alias("value"), "reported_entities")
