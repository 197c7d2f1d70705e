"""Ranked lexical search: an index of compressed postings by shard, document-at-a-time merging inside shards, one merge of the shards' best.

``index`` cuts the documents as they are scanned into shards of at most ``SHARD_DOCS`` documents or ``SHARD_BYTES`` bytes, so no text is shuffled.  A shard holds a row for each
of its terms, with the documents in ascending order of their ids as gaps and the occurrences, both as variable-length bytes, and a row without term for the documents' ids and
lengths.  ``search`` reads only the rows of the items' terms.  In a shard each item's postings are merged document at a time by a k-way heap of cursors; a bounded heap keyed by
score, then doc_id, keeps the best.  Once it is full, terms whose greatest contributions together cannot lift a document into it leave the merge and are only looked up for the
documents that the other terms bring: an exact bound, which drops nothing.  Each task reduces its shards to the best of each item before the global merge by window.

Items come in blocks of at most ``BLOCK`` (item, term) pairs, so what the driver and the tasks hold has a bound whatever the number of items; every block meets all shards.

Edge cases: doc_id is a 64-bit integer; repeated ids are documents of their own, rows without id count too and come last among equal scores; a null or termless text counts in
nothing; rows that repeat an item_id are one item with the terms of all; items without known terms have no rows; an empty table on either side gives no rows; texts are taken whole,
and one longer than a shard is a shard of its own; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, bounded, partitions_for, utf8, written

#: What stands between terms; all of it is ASCII, so bytes can be dealt with as they are.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_DOCS, SHARD_BYTES = 16_384, 32 << 20
#: (item, term) pairs that one search holds in the driver and in each task.
BLOCK = 200_000
SCHEMA = "shard long, term string, n int, total long, docs binary, counts binary"


def _table() -> bytes:
    """Terms' bytes lower-cased, all others as blanks."""
    kept = [c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)]
    return bytes(c + 32 if 65 <= c <= 90 else c for c in kept)


FOLDED = _table()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each value): seven bits a byte, the lowest first, the top bit on all but the last."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >> np.uint64(7 * k)
        if not more.any():
            break
        size += more > 0
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        here = size > k
        out[at[here] + k] = ((v[here] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (size[here] > k + 1).astype(np.uint8) << 7
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    """The values that ``packed`` made bytes of."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


class Shard:
    """Postings of the documents added so far."""

    def __init__(self) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.of, self.count, self.held = array("I"), array("Q"), array("I")
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, doc: int | None, text: bytes) -> None:
        found = Counter(text.translate(FOLDED).split())
        self.bytes += len(text)
        if not found:
            return
        self.of.extend(map(self.terms.__getitem__, found))
        self.count.extend(found.values())
        self.held.append(len(found))
        self.ids.append(doc)
        self.sizes.append(found.total())

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's rows, that of the documents first; doc_id ascending, rows without id last."""
        if not self.ids:
            return
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        known = [self.ids[i] for i in order if self.ids[i] is not None]
        sizes = np.array(self.sizes, np.int64)[order]
        names = ["shard", "term", "n", "total", "docs", "counts"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        head = [[shard], [None], [len(order)], [int(sizes.sum())], [np.array(known, np.int64).tobytes()], [packed(sizes)[0].tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(head, kinds, strict=True)], names)
        term, doc, count = np.frombuffer(self.of, np.uint32).astype(np.int64), np.repeat(place, np.frombuffer(self.held, np.uint32)), np.frombuffer(self.count, np.uint64)
        sort = np.argsort(term << 32 | doc)
        term, doc, count = term[sort], doc[sort], count[sort]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        gap = np.diff(doc, prepend=0)
        gap[first] = doc[first]
        columns = []
        for values in (gap, count):
            data, size = packed(values)
            at = np.concatenate([[0], np.cumsum(np.add.reduceat(size, first))])
            columns.append((data, at))
        n = np.diff(np.append(first, len(term)))
        words = list(self.terms)
        for low in range(0, len(words), 50_000):
            high = min(len(words), low + 50_000)
            binary = [pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((at[low : high + 1] - at[low]).astype(np.int32).tobytes()), pa.py_buffer(data[at[low] : at[high]].tobytes())]) for data, at in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(high - low, shard)), pa.array(words[low:high], pa.binary()).cast(pa.string()), pa.array(n[low:high], pa.int32()), pa.array(n[low:high], pa.int64()), *binary], names
            )


def index(docs: DataFrame) -> DataFrame:
    """Rows of the index over docs (doc_id, text): to be written, as two plans of a search read them."""
    bounded(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, now = TaskContext.get().partitionId(), 0, Shard()
        for batch in batches(it):
            body, at = utf8(batch.column(1))
            data = body.tobytes()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                now.add(doc, data[at[i] : at[i + 1]])
                if len(now.ids) >= SHARD_DOCS or now.bytes >= SHARD_BYTES:
                    yield from now.rows(part << 20 | made)
                    made, now = made + 1, Shard()
        yield from now.rows(part << 20 | made)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, term), once each."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[^{BETWEEN}]+"), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


Postings = tuple[int, list[int], list[int], dict[int, int]]


def best(postings: list[Postings], most: int) -> list[tuple[int, int]]:
    """(score, -document) of the ``most`` best documents of one item in one shard, as a heap; postings: greatest contribution, documents ascending, contributions, both as a dict."""
    postings = sorted(postings, key=lambda p: p[0])
    width = len(postings)
    bounds = [0]
    for p in postings:
        bounds.append(bounds[-1] + p[0])
    docs, gains, tables = [p[1] for p in postings], [p[2] for p in postings], [p[3] for p in postings]
    at = [0] * width
    cursors = [d[0] * width + i for i, d in enumerate(docs)]
    heapq.heapify(cursors)
    kept: list[tuple[int, int]] = []
    # postings below ``first`` are looked up only; a document needs more than ``least`` (later ones lose ties, as ids ascend)
    first, least = 0, 0
    replace, pop = heapq.heapreplace, heapq.heappop
    while cursors:
        doc, score = cursors[0] // width, 0
        limit = (doc + 1) * width
        while cursors and cursors[0] < limit:
            i = cursors[0] % width
            a = at[i]
            score += gains[i][a]
            at[i] = a = a + 1
            if a < len(docs[i]):
                replace(cursors, docs[i][a] * width + i)
            else:
                pop(cursors)
        rest = first
        while rest and score + bounds[rest] > least:
            rest -= 1
            score += tables[rest].get(doc, 0)
        if rest or score <= least:
            continue
        if len(kept) < most:
            heapq.heappush(kept, (score, -doc))
        else:
            replace(kept, (score, -doc))
        if len(kept) == most:
            least = kept[0][0]
            was = first
            while first < width and bounds[first + 1] <= least:
                first += 1
            if first > was:
                cursors = [c for c in cursors if c % width >= first]
                heapq.heapify(cursors)
    return kept


def _block(rows: DataFrame, wanted: dict, weights: dict[str, int], n: int, total: int, most: int, items: DataFrame) -> DataFrame:
    """The best of each shard for the items of a block; wanted: place of the item -> terms."""

    def of_shard(head: tuple[bytes, bytes], found: dict[str, tuple[bytes, bytes]]) -> Iterator[tuple[int, int | None, int]]:
        ids, sizes = np.frombuffer(head[0], np.int64), unpacked(head[1])
        length = 50 + (50 * sizes * n) // total
        postings: dict[str, Postings] = {}
        for term, (gaps, counts) in found.items():
            docs, tf = np.cumsum(unpacked(gaps)), unpacked(counts)
            gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[docs]))
            d, g = docs.tolist(), gain.tolist()
            postings[term] = (max(g), d, g, dict(zip(d, g, strict=True)))
        for item, terms in wanted.items():
            if held := [postings[t] for t in terms if t in postings]:
                for score, doc in best(held, most):
                    yield item, int(ids[-doc]) if -doc < len(ids) else None, score

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(head, found) -> pa.RecordBatch:
            some = list(of_shard(head, found)) if found else []
            item, doc, score = zip(*some, strict=True) if some else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

        now, head, found = None, (b"", b""), {}
        for batch in it:
            for shard, term, docs, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if term is None:  # a shard begins
                    if now is not None:
                        yield out(head, found)
                    now, head, found = shard, (docs, counts), {}
                else:
                    found[term] = (docs, counts)
        if now is not None:
            yield out(head, found)

    parts = partitions_for(rows.sparkSession)
    dealt = rows.select("shard", "term", "docs", "counts").repartition(parts, "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return dealt.mapInArrow(run, "item int, doc_id long, score long").join(F.broadcast(items), "item").select("item_id", "doc_id", "score")


def search(made: DataFrame, items: DataFrame, most: int = 50, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the ``most`` best documents of each item; made: a written index."""
    spark = made.sparkSession
    stats = made.where(F.col("term").isNull()).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = stats["n"] or 0, stats["total"] or 0
    pairs = terms_of(items)
    empty = spark.createDataFrame([], pairs.select("item_id").schema).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    if not n:
        return empty
    # items are dealt to as many blocks as hold their pairs; all terms of an item are in one block
    pairs = written(pairs, "search-items")
    blocks = -(-pairs.count() // block)
    found = []
    for k in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else pairs
        of_item: dict = {}
        for r in own.collect():  # a block holds about ``block`` pairs
            of_item.setdefault(r["item_id"], []).append(r["term"])
        if not of_item:
            continue
        names = sorted(set().union(*of_item.values()))
        terms = spark.createDataFrame([(t,) for t in names], "term string")
        rows = made.join(F.broadcast(terms), "term", "left_semi")
        frequency = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in frequency.items()}
        places = list(of_item)
        numbers = spark.createDataFrame(list(enumerate(places)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        wanted = {i: sorted(t for t in of_item[item] if weights.get(t, 0) > 0) for i, item in enumerate(places)}
        heads = made.where(F.col("term").isNull())
        found.append(_block(heads.unionByName(rows.select(*made.columns)), {i: t for i, t in wanted.items() if t}, weights, n, total, most, numbers))
    if not found:
        return empty
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = 50) -> DataFrame:
    """Index docs (doc_id, text) in the shared folder and search it for every item (item_id, text)."""
    return search(written(index(docs), "search-index", "zstd"), items, most)


#: The same ranking in DuckDB's SQL.
SQL = f"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^{BETWEEN}]+')) AS term FROM documents
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id
), g AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d
), m AS (
  SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM d, g
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^{BETWEEN}]+')) AS term FROM benchmark
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM g) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term
), s AS (
  SELECT item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN p ON p.term = i.term JOIN w ON w.term = i.term JOIN m ON m.doc_id = p.doc_id GROUP BY ALL
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
