"""MinHash near-duplicates with tensored banding.

A document is the set of its word shingles, as 64-bit hashes.  Instead of a minhash collection for each table, two small groups of collections are
computed, ``SIDES``: 12 of two minhashes and 17 of three, and table (i, j) is keyed by collection i of the first side and j of the second: 204 tables
of five minhashes from 75 minhashes where independent tables would take 1,020.  A pair of likeness 0.8 shares no table with a probability of about 1e-5.

Documents with equal sets form a class, found by the digest of the set, and only one of each class is sketched.  Table rows are sorted by key.  At first each member is
paired with the least and the greatest of its runs' first members only; components of the links so far are then contracted, and only members of runs that still hold several
components go on: short runs (up to ``SMALL``) with their pairs across components, the members of longer ones by a prefix filter (``remaining``), which is exact and meets
in the rarest shingles alone.  So nothing is lost, and no group is expanded into all its pairs.  Candidates pass a signature estimate that a true pair fails with
a probability below 1e-6 (a binomial tail), and are then confirmed on the full sets.  Components follow by star contraction.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; a text with fewer words than a shingle has its whole sequence as the
one shingle; rows without an id are no one's copy (component null, kept true); rows that repeat an id are one document, and stay or go together;
extra columns are ignored by ``classes`` and kept by ``deduplicated``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, by_ids, dropped, hash_runs, mixed, partitions_for, utf8, word_runs, written
from .components import components

#: (collections, minhashes in each) of either side.
SIDES = ((12, 2), (17, 3))
FIRST = SIDES[0][0] * SIDES[0][1]
WIDTH = FIRST + SIDES[1][0] * SIDES[1][1]
TABLES = SIDES[0][0] * SIDES[1][0]
SMALL = 8
#: The least likeness in percent that the tables are made for: there they miss one pair in 7,000, at 80 one in 10 million.
LEAST_PERCENT = 75


def least_matches(percent: int) -> int:
    """Matching minhashes of WIDTH below which a pair is no candidate: 5.5 deviations less than are expected, for a likeness of 0.8 41 instead of 60."""
    p = percent / 100
    return max(0, math.ceil(WIDTH * p - 5.5 * math.sqrt(WIDTH * p * (1 - p))))


#: The same at the likeness of the query.
LEAST_MATCHES = least_matches(80)



_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = _SEEDS | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    body, at = utf8(texts)
    body = _LOWER[body]
    first, end, doc = word_runs(body, at)
    words = hash_runs(body, first, end)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    chained = words.copy()
    for step in range(1, k):
        if len(words) <= step:
            break
        chained[:-step] = mixed(chained[:-step] * np.uint64(0x9E3779B97F4A7C15) + words[step:])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(chained[a : b - k + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                whole = mixed(whole + w)
            out.append(whole)
        else:
            out.append(words[:0])
    return out


def signature(shingles: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The first ``width`` minhashes, of 32 bits."""
    out = np.empty(width, np.uint32)
    for j in range(width):
        x = (shingles ^ _SEEDS[j]) * _ODD[j]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        out[j] = x.min() >> np.uint64(32)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null without shingles), signature."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1024):
            sets = shingle_sets(batch.column(1), k)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sig = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def collections_of(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every collection of either side, from signatures as rows."""
    halves = []
    for part, (groups, rows) in zip((sig[:, :FIRST], sig[:, FIRST:]), SIDES, strict=True):
        part = part.reshape(len(sig), groups, rows).astype(np.uint64)
        half = part[..., 0]
        for r in range(1, rows):
            half = mixed(half * np.uint64(0x9E3779B97F4A7C15) + part[..., r])
        halves.append(half)
    return halves[0], halves[1]


def key_of(first: np.ndarray, second: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Key of a table from the hashes of its two collections."""
    return mixed(first * np.uint64(0xD6E8FEB86659FD93) + second + (table.astype(np.uint64) << np.uint64(1))).view(np.int64)


def table_keys(reps: DataFrame) -> DataFrame:
    """(key, rep) for each of the TABLES tables."""
    table = np.arange(TABLES).reshape(1, SIDES[0][0], SIDES[1][0])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                first, second = collections_of(_signatures(part.column(1)))
                keys = key_of(first[:, :, None], second[:, None, :], table).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.asarray(part.column(0)), TABLES))], ["key", "rep"])

    return reps.select("rep", "signature").mapInArrow(run, "key long, rep long")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(utf8(column)[0].tobytes(), np.uint32).reshape(-1, WIDTH)


def runs(keys: DataFrame) -> DataFrame:
    """(key, rep, leader): the members of every run of two or more, with the run's least member; a row for each member of a run, however long."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_r = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_key, leader = None, None  # a run that has gone out in part

        def emit(k: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal open_key, leader
            if not len(k):
                return
            heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            length = np.diff(np.append(heads, len(k)))
            first = r[heads]
            known = open_key is not None and k[0] == open_key
            if known:
                first[0] = leader
            several = length > 1
            several[0] |= known
            if len(k) - heads[-1] > 65_536 or (known and len(heads) == 1):
                open_key, leader = k[-1], first[-1]
            else:
                open_key = None
            keep = np.repeat(several, length)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(r[keep]), pa.array(np.repeat(first, length)[keep])], ["key", "rep", "leader"])

        for batch in it:
            k = np.concatenate([rest_k, np.asarray(batch.column(0))])
            r = np.concatenate([rest_r, np.asarray(batch.column(1))])
            cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            if len(k) - cut > 65_536:  # a very long run goes out in pieces: the first member stays its leader
                cut = len(k)
            yield from emit(k[:cut], r[:cut])
            rest_k, rest_r = k[cut:], r[cut:]
        yield from emit(rest_k, rest_r)

    dealt = keys.repartition(partitions_for(keys.sparkSession), "key").sortWithinPartitions("key", "rep")
    return dealt.mapInArrow(run, "key long, rep long, leader long")


def crossing(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of different components inside runs of at most SMALL members, from (key, rep, component)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3

        def emit(k: np.ndarray, r: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            for step in range(1, SMALL):  # members step places apart
                at = np.flatnonzero((k[step:] == k[:-step]) & (c[step:] != c[:-step]))
                a.append(r[at]), b.append(r[at + step])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in it:
            k, r, c = (np.concatenate([old, np.asarray(x)]) for old, x in zip(rest, batch.columns, strict=True))
            cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            yield from emit(k[:cut], r[:cut], c[:cut])
            rest = [x[cut:] for x in (k, r, c)]
        yield from emit(*rest)

    dealt = rows.select("key", "rep", "component").repartition(partitions_for(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the likeness and whose signatures agree in as many places as it lets expect."""
    share, least = percent / 100, least_matches(percent)
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b") - 1e-9)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s, t = _signatures(batch.column(2)), _signatures(batch.column(3))
            yield batch.select(["a", "b"]).filter(pa.array((s == t).sum(1) >= least))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (u, v): pairs with 100 * intersection >= percent * union on the full sets, computed again from the candidates' texts."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    texts = by_ids(docs.select(F.col("doc_id").cast("long"), "text"), ids)
    sets = texts.mapInArrow(run, "id long, shingles array<long>").dropDuplicates(["id"])
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), common.alias("common")).where(F.col("common") * 100 >= percent * (F.col("sizes") - F.col("common"))).select(F.col("b").alias("u"), F.col("a").alias("v"))


def placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, rep, component, n) of the members of runs that hold several components, n members in all."""
    with_component = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    active = with_component.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x != y").select("key", "n")
    return with_component.join(active, "key")


def prefixes(active: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(shingle, rep, component, n, place): of each document the rarest shingles, so many that any document it has a link with must have one of them among its own.

    Shingles are in one order for all, by the number of active documents that have them; of n shingles the first n - ceil(n * percent / 100) + 1 count, of which those that
    no other document has are left out.
    """
    ids = written(active.select(F.col("rep").alias("doc_id")).distinct(), "run-ids")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), [len(s) for s in sets])), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], ["rep", "shingle"])

    texts = by_ids(docs.select(F.col("doc_id").cast("long"), "text"), ids).dropDuplicates(["doc_id"])
    each = written(texts.mapInArrow(run, "rep long, shingle long"), "active-shingles")
    counts = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(counts, "shingle").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("all"))  # as long as one document
    n = F.size("all")
    first = ordered.select("rep", n.alias("n"), F.posexplode(F.slice("all", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))).alias("place", "s"))
    named = active.select("rep", "component").distinct()
    return first.where("s.df > 1").select("rep", "n", "place", F.col("s.shingle").alias("shingle")).join(named, "rep")


def remaining(active: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b), a < b: all pairs of different components among the active documents that can have a link: they share one of their rarest shingles, and
    what stands behind it in both is enough for the likeness.  Exact, so that nothing is lost to the estimate, whatever the size of a run."""
    each = written(prefixes(active, docs, k, percent), "prefixes")
    mixed = each.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("shingle")
    each = written(each.join(mixed, "shingle", "left_semi"), "mixed-prefixes")
    x, y = each.alias("x"), each.alias("y")
    common = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    fits = common * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & fits)
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept; ValueError for a likeness under LEAST_PERCENT, which the tables would partly miss."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"the tables are made for {LEAST_PERCENT} to 100 percent, not {percent}")
    sketched = written(sketches(docs, k), "sketches")
    linked = sketched.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(linked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "reps")
    found = written(runs(table_keys(reps)), "runs")
    # first a pair or two for each member: with the least and the greatest of its leaders
    leaders = found.where("leader != rep").groupBy("rep").agg(F.min("leader").alias("x"), F.max("leader").alias("y"))
    pairs = written(likely(leaders.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), F.col("rep").alias("b")), reps, percent), "pairs")
    edges = written(confirmed(pairs, docs, k, percent), "links")
    component = written(components(edges), "components")
    # then only what is still in different components: all pairs of short runs, and blocks of long ones
    active = written(placed(found, component), "mixed-runs")
    dropped(found)
    for short in (True, False):
        if short:
            more = likely(crossing(active.where(F.col("n") <= SMALL)).join(pairs, ["a", "b"], "left_anti"), reps, percent)
        else:
            long = written(placed(active.where(F.col("n") > SMALL).select("key", "rep"), component).select("rep", "component").distinct(), "long-runs")
            if long.isEmpty():
                break
            more = remaining(long, docs, k, percent).join(pairs, ["a", "b"], "left_anti")
        more = written(more, "more-pairs")
        if more.isEmpty():
            continue
        links = written(confirmed(more, docs, k, percent), "more-links")
        pairs = pairs.union(more)
        if not links.isEmpty():
            edges = edges.union(links)
            component = written(components(edges), "components")
    of_class = reps.select("digest", "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that have a kept document in their component."""
    gone = written(classes(docs, k, percent).where("!kept").select("doc_id").distinct(), "near-copies")
    return by_ids(docs, gone, "left_anti")
