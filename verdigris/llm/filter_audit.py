"""How filters interact: each document's failures as a mask, copies found by one sort, and counters that add up to every order of the filters.

The sort: documents are dealt into ranges of (fingerprint of the text, doc_id) and sorted inside a range by fingerprint, full text and doc_id, so copies are neighbours and a document
is a copy if its predecessor has the same text and a smaller id.  A group of copies of any size may run over many ranges, as the id is part of the range.  What is at a border is
settled by a small table: a range hands on its first row of each text that has the fingerprint of its first or last row, and such a row is a copy if an earlier range
has the text too.  The same pass counts words, capitals and characters, so texts are shuffled once and never again.

The counters: (part, mask) -> documents, good ones, toxic ones.  From them, ``kept`` of a set of filters is the sum over the masks that fail none of it, and everything a step of an
order reports, Shapley sums included, is a difference of these sums.  They grow with the number of parts alone.

Edge cases: a null text is empty; a null source is the part of the empty string; of rows that share an id and a text none is a copy of the other; rows without id are no copies and make
none; several labels of an id count as the greatest; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, bounded, partitions_for, utf8, written

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(128, 192))
_MARKS = re.compile(rb"[#$%&*|]")
COPY = 1 << FILTERS.index("E")
SCHEMA = "piece int, run long, part string, doc_id long, mask int, first boolean, fingerprint long, edge string"


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails, from its UTF-8 bytes."""
    words = text.split()  # of bytes: at ASCII white space alone
    points = len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _CONTINUED))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * points[0] > CAPITALS_PERCENT * points[1]) << 2
        | (_MARKS.search(text) is not None) << 3
    )


def judged(docs: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """part, doc_id and mask of every row of docs (doc_id, text, source); fingerprint: for tests, a column that is equal for equal texts."""
    spark = docs.sparkSession
    bounded(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("fingerprint") if fingerprint is None else fingerprint.cast("long").alias("fingerprint"))
    sorted_ = keyed.repartitionByRange(2 * partitions_for(spark), "fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, runs = TaskContext.get().partitionId(), 0
        opening: int | None = None  # fingerprint of the range's first row
        before: tuple[int, bytes] | None = None  # of the row before
        least: int | None = None  # smallest id of the text so far
        texts: list[tuple[int, bytes]] = []  # number and text of the runs of the latest fingerprint

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["piece", "run", "part", "doc_id", "mask", "first", "fingerprint", "edge"])

        def borders(mark: int) -> list[tuple]:
            return [(piece, n, None, None, None, None, mark, own.decode()) for n, own in texts]

        for batch in batches(it):
            body, at = utf8(batch.column(2))
            data, rows = body.tobytes(), []
            ids, parts, prints = (batch.column(c).to_pylist() for c in (0, 1, 3))
            for i, (doc, part, mark) in enumerate(zip(ids, parts, prints, strict=True)):
                own = data[at[i] : at[i + 1]]
                if before != (mark, own):
                    if before and before[0] != mark:
                        rows += borders(before[0]) if before[0] == opening else []
                        texts = []
                    before, least, runs = (mark, own), None, runs + 1
                    opening = mark if opening is None else opening
                if doc is not None and least is None:
                    least = doc
                    texts.append((runs, own))
                first = doc is not None and doc == least
                rows.append((piece, runs, part, doc, failures(own) | (0 if first or doc is None else COPY), first, None, None))
            yield batch_of(rows)
        if before:
            yield batch_of(borders(before[0]))

    return _settled(written(sorted_.mapInArrow(run, SCHEMA), "filter-masks", "zstd"))


#: Rows up to which the table of runs at borders is broadcast; it has about two a range.
BROADCAST_RUNS = 200_000


def _settled(rows: DataFrame) -> DataFrame:
    """Rows with the copies at borders marked: first rows of a text that an earlier range has too."""
    earlier = F.min("piece").over(Window.partitionBy("fingerprint", "edge"))
    late = written(rows.where(F.col("edge").isNotNull()).withColumn("earlier", earlier).where(F.col("piece") > F.col("earlier")).select("piece", "run", F.lit(COPY).alias("late")), "filter-borders")
    small = late.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    joined = rows.where(F.col("edge").isNull()).join(F.broadcast(late) if small else late, ["piece", "run"], "left")
    return joined.select("part", "doc_id", F.when(F.col("first") & F.col("late").isNotNull(), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: one row for each mask that a part has."""
    judgement = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    number = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long")).alias(c)
    return masks.join(judgement, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), number("good"), number("toxic"))


def report(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    n = len(FILTERS)
    # the sums over the masks that fail none of a set of filters, for all sets, one row a part
    sets = F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))
    passed = counted.withColumn("set", sets).where(F.col("set").bitwiseAND(F.col("mask")) == 0).groupBy("part", "set").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    whole = passed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct("n", "good", "toxic")))).alias("sums"))
    orders = F.split(F.lit(" ".join("".join(o) for o in itertools.permutations(FILTERS))), " ")
    steps = (
        whole.withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("filter", F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1)) - 1"))
        .withColumn("before", F.expr(f"aggregate(sequence(0, step - 1), 0, (s, i) -> if(i = 0, s, s | shiftleft(1, instr('{FILTERS}', substr(filter_order, i, 1)) - 1)))"))
    )
    bit = F.expr("shiftleft(1, filter)")
    here = lambda of, what="n": F.coalesce(F.element_at("sums", of)[what], F.lit(0).cast("long"))
    before, after, everything = F.col("before"), F.col("before").bitwiseOR(bit), F.lit((1 << n) - 1)
    lost = lambda what: here(before, what) - here(after, what)
    # a set of s other filters comes just before a filter in s! (n - 1 - s)! of the orders
    ways = {0: 24, 1: 6, 2: 4, 3: 6, 4: 24}
    value = sum(
        (F.when(F.lit(s).bitwiseAND(bit) == 0, F.lit(ways[s.bit_count()]) * (here(F.lit(s)) - here(F.lit(s).bitwiseOR(bit)))).otherwise(F.lit(0).cast("long")) for s in range((1 << n) - 1)),
        F.lit(0).cast("long"),
    )
    # by part and filter alone, so that 5 rows a part work out the 31 terms, not 600
    shapley = whole.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("part", "filter", value.alias("shapley"))
    alone = here(everything.bitwiseXOR(bit)) - here(everything)
    return steps.join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", here(after).alias("kept"), lost("n").alias("removed"), (here(F.lit(0)) - here(bit) - lost("n")).alias("redundant"), alone.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over docs (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    return report(written(counters(judged(docs), labels), "filter-counters"))


#: The same audit in DuckDB's SQL.
SQL = """
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM w
), l AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(CASE WHEN good THEN 1 ELSE 0 END) AS good, sum(CASE WHEN toxic THEN 1 ELSE 0 END) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), x AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x AS a, x AS b, x AS c, x AS d, x AS e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS done FROM o, range(1, 6) AS r(step)
), a AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
    CAST(sum(CASE WHEN mask & (done | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & done <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM a
"""
