"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Every document of a source has the same expected number of copies, the source's target over its size.  With the documents of the source in a
fixed order, the prefix sum of the expected copies runs from 0 to their total; one offset in [0, 1) is added, and a document is emitted once for
each integer that its own stretch crosses.  Ordering by size makes the sample stratified by size, so the words taken come near the target.

The prefix sum is hierarchical, because one source may hold a third of all rows: ranks are taken inside (source, size, slot) groups, where the
slot deals rows of one size, copies for instance, over ``SLOTS`` groups; the sizes' group counts are summed inside (source, size class), of which
each holds a bounded range of sizes, and the classes, some hundred a source at most, inside the source.  No window sees all rows of a source.

Edge cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 get copies but add no words; a source
of size 0 has target 0; equal rows are ordered by doc_id and hence share a rank only if the ids are equal too, when either order gives the same
words; an empty table gives an empty result; columns named like the ones added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Groups over which documents of one source and size are dealt.
SLOTS = 64
#: Weights by place of the source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
SEED = "mix-1"
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def size_class(size: Column) -> Column:
    """Number of binary digits, and the next three of them: eight classes an octave, as an integer."""
    digits = F.length(F.bin(size))
    return digits * 8 + F.when(digits > 4, F.pmod(F.floor(size / F.pow(F.lit(2.0), digits - 4)), F.lit(8)).cast("int")).otherwise(F.lit(0))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """source, source_size -> with target, rate (expected copies of a document) and offset.

    Water filling in closed form: sources in ascending order of most * size / weight reach their limit first; with the first k at their limits
    the others' common level is (total - limits of k) / (weight of the rest).  The right k is the first whose level no further source exceeds.
    There is a row a source, so the unpartitioned windows see few rows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * most
    filling = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source")
    before, all_rows = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        ranked.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("full", F.coalesce(F.sum(limit).over(before), F.lit(0).cast("long")))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0).cast("long")))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("place", F.row_number().over(filling))
        .withColumn("fits", F.when(F.col("level") <= limit / F.col("weight"), F.struct("place", "level")))
        .withColumn("common", F.min("fits").over(all_rows)["level"])
    )
    target = F.when(F.col("common").isNull() | (F.col("common") * F.col("weight") >= limit), limit.cast("double")).otherwise(F.col("common") * F.col("weight"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return level.select("source", "source_size", target.cast("double").alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"), offset.alias("offset"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, id_column: str = "doc_id") -> DataFrame:
    """docs with size, source_size, target, copies and taken (words taken, repeats counted)."""
    docs = docs.drop(*[c for c in ADDED if c in docs.columns])
    slot = F.coalesce(F.pmod(F.col(id_column), F.lit(SLOTS)), F.lit(0)).cast("int")
    # the row's place in its group needs no text: only ids and counts are shuffled, the text joins nothing before it is asked for
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("__slot", slot).withColumn("__class", size_class(F.col("size")))
    groups = sized.groupBy("source", "__class", "size", "__slot").agg(F.count(F.lit(1)).alias("__n"))
    classes = groups.groupBy("source", "__class").agg(F.sum("__n").alias("__class_n"), F.sum(F.col("__n") * F.col("size")).alias("__class_size"))
    in_source = Window.partitionBy("source").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("__class_before", F.coalesce(F.sum("__class_n").over(in_source), F.lit(0).cast("long")))
    rates = targets(classes.groupBy("source").agg(F.sum("__class_size").alias("source_size")), weights, most, seed)
    in_class = Window.partitionBy("source", "__class").orderBy("size", "__slot").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__in_class", F.coalesce(F.sum("__n").over(in_class), F.lit(0).cast("long")))
    same = lambda a, b, *more: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) if not more else F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.{more[0]}") == F.col(f"{b}.{more[0]}"))
    places = (
        groups.alias("g")
        .join(classes.alias("c"), same("g", "c", "__class"))
        .join(rates.alias("r"), same("g", "r"))
        .select("g.source", "g.size", "g.__slot", (F.col("c.__class_before") + F.col("g.__in_class")).alias("__before"), "r.source_size", "r.target", "r.rate", "r.offset")
    )
    in_group = Window.partitionBy("source", "size", "__slot").orderBy(id_column)
    ranked = sized.drop("__class").withColumn("__rank", F.row_number().over(in_group))
    joined = ranked.alias("d").join(places.alias("p"), same("d", "p", "size") & (F.col("d.__slot") == F.col("p.__slot")))
    place = F.col("p.__before") + F.col("d.__rank")
    copies = F.floor(F.col("p.offset") + place * F.col("p.rate")) - F.floor(F.col("p.offset") + (place - 1) * F.col("p.rate"))
    return joined.select("d.*", "p.source_size", "p.target", copies.cast("long").alias("copies")).drop("__slot", "__rank").withColumn("taken", F.col("copies") * F.col("size"))


def emitted(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixed.withColumn("__copy", F.explode(F.expr("sequence(1L, copies)"))).drop("__copy") if "copies" in mixed.columns else mixed


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself, in the columns of docs, whatever their names: each row as often as it is taken."""
    columns = docs.columns
    away = {c: f"__own_{c}" for c in ADDED if c in columns}
    taken = mix(docs.withColumnsRenamed(away), **options).where(F.col("copies") > 0)
    return emitted(taken).select(*[F.col(away.get(c, c)).alias(c) for c in columns])


#: The same mix in DuckDB's SQL.
SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)) AS BIGINT) AS weight FROM s
), f AS (
  SELECT *, 3 * source_size AS lim,
    CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(3 * source_size) OVER p, 0) AS BIGINT) AS filled,
    CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER p, 0) AS BIGINT) AS open
    , row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source IS NULL, source) AS place
  FROM w WINDOW p AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, CAST(total - filled AS DOUBLE) / open AS level FROM f
), c AS (
  SELECT *, (SELECT m.level FROM l AS m WHERE m.level <= CAST(m.lim AS DOUBLE) / m.weight ORDER BY m.place LIMIT 1) AS common FROM l
), t AS (
  SELECT source, source_size,
    CASE WHEN common IS NULL OR common * weight >= lim THEN CAST(lim AS DOUBLE) ELSE common * weight END AS target,
    CAST(CAST('0x' || substr(md5('mix-1' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM c
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, coalesce(d.doc_id % 64, 0), d.doc_id NULLS FIRST) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(floor(u + place * rate) - floor(u + (place - 1) * rate) AS BIGINT) * size AS taken
FROM r
"""
